"""Jaccard self-join on word shingles by vertical partitioning.

The global order of the shingles is the order of their hashes, and it is cut
into fragments.  If two sets reach the threshold, they differ in no more
shingles than a bound that their sizes give.  Cut into more fragments than that
bound, they agree in at least one whole fragment: documents that share a
fragment are candidates.  Sizes fall in classes; a set is cut once for its own
class and once for the next, so every pair within reach is cut alike.

As there are ``SLACK`` fragments more than needed, partners share several, and
those that most sets have can be left out: sets that have only a common passage
in common drop out.  For candidates, the parities of the counts in very many narrow
fragments bound the difference from below, and pairs that it rules out go.  For
the rest the overlap is counted in each of ``COUNT_FRAGMENTS`` wide fragments
separately and summed per pair.  Equal sets are one node from the
start.  Within a shared fragment, the sketches of blocks of sets are compared at
once, and only the most alike pairs that would connect the fragment are counted.
Of the fragments that a pair shares only the least one answers for it, which is
told by the ``LEAST_KEYS`` least fragments of either set, so near copies, which
share most of theirs, are proposed once.  A fragment is done when its sets are
in one component or every pair across components that it answers for and its
sketches allow has been counted, so no link between components is missed.  Links
within a component are not all counted: the result has components, no number of
links.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, bounded_broadcast, discard, drop_shuffles, in_parts, small_batches, written
from .components import ROWS, components
from .texthash import mix, shingle_sets
from .tokens import text_slices
from .workers import tidy

#: Fragments beyond the bound, of which as many may be empty in both sets.
SLACK = 8
COUNT_FRAGMENTS = 4
#: Bytes of sketches of a fragment's sets that are compared at once, about.
BLOCK_BYTES = 1 << 16
#: A sketch goes along with each fragment of its set, of which a long text has
#: thousands.  A short sketch of a large set rules out less, and nothing wrongly.
SKETCH_BITS = 4096
#: Fragments of each set that are looked at first, the most shared; and how
#: many pairs of two labels are counted at once, in the first round after.
FIRST_FRAGMENTS, PAIRS = 3, 64
#: Rows, blocks and pairs that a part of a table between has.
BLOCKS, PAIRS_PER_PART = 2000, 20_000
#: Of each set's fragments, how many of the least go along with its sketch.  Two
#: sets that have none of these in common are proposed by each fragment they share.
LEAST_KEYS = 6
#: Shares of the fragments that are looked at one after another: the sketches
#: that go along with fragments are on disk for one share at a time.
SHARES = 3
_U = np.uint64


def size_classes(num: int, den: int, most: int) -> list[int]:
    """Upper bounds of the size classes: sets within reach of each other are in
    one class or in neighbours."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num))
    return bounds + [bounds[-1] * den // num + 1]


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + _U(len(s))]))[0].view(np.int64))


def fragment_keys(s: np.ndarray, bounds: list[int], num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, shared keys that a partner needs at least, keys) for both cuts of
    the sorted set ``s``."""
    c = int(np.searchsorted(bounds, len(s)))
    mixed, out = mix(s), []
    for cls in (c, c + 1):
        differ = (den - num) * 2 * bounds[cls] // (den + num)
        if differ == 0:
            continue
        parts = differ + 1 + SLACK
        at = ((s >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        mark = mix(np.array([cls], np.uint64))
        keys, empty = mix(np.add.reduceat(mixed, first) + mix(at[first].astype(np.uint64) + mark)), parts - len(first)
        need = SLACK + 1 - empty
        if need < 1:  # two sets may agree in empty fragments alone, so these take part
            none = np.setdiff1d(np.arange(parts), at[first]).astype(np.uint64)
            keys, need = np.concatenate([keys, mix(mix(none + mark))]), 1
        out.append((cls, need, keys))
    return out


def parity_sketch(s: np.ndarray) -> bytes:
    """One bit per narrow fragment (low bits of the hash, of one to two fragments
    per hash, up to ``SKETCH_BITS``): whether its count is odd."""
    bits = min(SKETCH_BITS, max(64, 1 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def ngram_join(
    docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id
    that links reach).  Texts link when den * shared >= num * joint.

    Null, empty and blank texts have no shingles, link with nothing and are
    their own component; a null id is the component of nothing but rows
    without any id; rows that repeat an id or a text are in one component with
    their copies; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def nodes_of(batches):
        for b in batches:
            texts, digests, sizes = b.column(2).to_pylist(), [], []
            for i, j in text_slices(texts):
                for s in shingle_sets(texts[i:j], k):
                    digests.append(set_digest(s) if len(s) else None)
                    sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "h", "node", "n"])

    with small_batches(spark, TEXT_ROWS):
        nodes = written(d.mapInArrow(tidy(nodes_of), "doc_id long, h long, node long, n long"), "nodes")
    most = nodes.agg(F.max("n")).first()[0] or 0
    bounds = size_classes(num, den, most)

    def keys_of(batches):
        seen: set[int] = set()
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in text_slices(texts):
                keys, node, meta = [], [], []
                for s in shingle_sets(texts[i:j], k):
                    if not len(s) or (own := set_digest(s)) in seen:
                        continue
                    seen.add(own)  # copies that this task has seen bring nothing new
                    for cls, need, got in fragment_keys(s, bounds, num, den):
                        keys.append(got)
                        node.append(np.full(len(got), own, np.int64))
                        meta.append(np.full(len(got), len(s) << 32 | need << 16 | cls, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), pa.array(np.concatenate(node)), pa.array(np.concatenate(meta))], names=["key", "node", "meta"])

    shared = d.select("text").mapInArrow(tidy(keys_of), "key long, node long, meta long")
    w = Window.partitionBy("key").orderBy("node")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Of a node that several tasks sent, one row stays; keys of one node go.
    with small_batches(spark, TEXT_ROWS):
        met = written(
            shared.select("*", F.lag("node").over(w).alias("before"), F.min("node").over(whole).alias("lo"), F.max("node").over(whole).alias("hi"), F.count("*").over(whole).alias("size"))
            .where("lo < hi and (before is null or before <> node)").select("key", "node", "meta", "size"), "met")
    # Partners share ``need`` keys, so without the need - 1 most frequent ones of
    # each, in an order that is the same for all, they still share one.
    rare = Window.partitionBy("node", "meta").orderBy("size", "key")
    need = F.shiftright("meta", 16).bitwiseAND(0xFFFF)
    ranked = met.withColumn("rank", F.row_number().over(rare)).withColumn("c", F.count("*").over(Window.partitionBy("node", "meta")))
    kept = written(ranked.where(F.col("rank") <= F.col("c") - need + 1).select(
        "key", "node", F.shiftright("meta", 32).cast("int").alias("n")), "buckets")
    discard(spark, met)
    label = None
    if kept.limit(1).count():
        sets = _sets(d, nodes, kept, k)
        label = _settle(kept, sets, num, den)
        discard(spark, sets)
    discard(spark, kept)
    by_class = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    if label is not None:
        linked = by_class.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = linked.groupBy("label").agg(F.min("own").alias("least"), F.sum("copies").alias("members")).where("members > 1")
        where = linked.join(least, "label").select("node", "least")
    else:
        where = by_class.where("copies > 1").select("node", F.col("own").alias("least"))
    return nodes.join(where, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _sets(d: DataFrame, nodes: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(node, part, n, hashes) of the nodes that share enough fragments; part -1
    is the parity sketch.

    A node is read from one text: that of the least id and hash among its own.
    Rows are found by both, so ids may be null or repeat; only where a row
    repeats in id and text, too, are nodes met twice and then told apart."""
    own = nodes.join(kept.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.count("*").alias("c"))
    ids = written(own.select(F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"), "node", "c"), "wanted")
    again = ids.where("c > 1").join(nodes.select("doc_id", "h", F.col("node").alias("_node")), F.col("node") == F.col("_node")).where(
        nodes["doc_id"].eqNullSafe(ids["doc_id"]) & (nodes["h"] == ids["h"])).groupBy("node").count().where("count > 1").limit(1).count()

    def parts_of(batches):
        seen: set[int] = set()
        for b in batches:
            texts, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in text_slices(texts):
                rows = []
                for node, s in zip(own[i:j], shingle_sets(texts[i:j], k), strict=True):
                    if node in seen or not len(s) or set_digest(s) != node:  # texts that share a hash
                        continue
                    seen.add(node)
                    rows.append((node, -1, len(s), parity_sketch(s)))
                    for p, x in enumerate(np.split(s, np.searchsorted(s, np.arange(1, COUNT_FRAGMENTS, dtype=np.uint64) << _U(62)))):
                        rows.append((node, p, len(s), x.astype("<u8").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["node", "part", "n", "hashes"])

    found = d.join(bounded_broadcast(ids.drop("c")), d["doc_id"].eqNullSafe(ids["doc_id"]) & (d["h"] == ids["h"])).select("text", "node")
    out = found.mapInArrow(tidy(parts_of), "node long, part int, n long, hashes binary")
    with small_batches(d.sparkSession, TEXT_ROWS):
        return written(out.dropDuplicates(["node", "part"]) if again else out, "sets")


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


class _Members:
    """Some sets of a fragment: node, size, label, sketch and least fragments of each."""

    def __init__(self, rows: pa.StructArray):
        self.node, self.n, self.label = (rows.field(k).to_numpy() for k in range(3))
        sketches = rows.field(3).to_pylist()
        least = rows.field(4)
        lengths = pc.list_value_length(least).to_numpy()
        self.least = np.zeros((len(lengths), LEAST_KEYS), np.int64)
        self.filled = np.arange(LEAST_KEYS) < lengths[:, None]
        self.least[self.filled] = least.flatten().to_numpy()
        lengths = np.array([len(x) for x in sketches])
        self.groups = [
            (at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1))
            for at in (np.flatnonzero(lengths == n) for n in np.unique(lengths))
        ]


def within_reach(x: _Members, y: _Members, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``x`` and ``y`` of sets of different labels that the sketches
    and sizes let link, and by how many elements they differ at least."""
    out = []
    for at, rows in x.groups:
        for to, others in y.groups:
            words = min(rows.shape[1], others.shape[1])
            left, right = _fold(rows, words), _fold(others, words)
            step = max(1, (1 << 21) // (len(to) * words))
            for k in range(0, len(at), step):
                i = at[k : k + step]
                least = np.bitwise_count(left[k : k + step, None, :] ^ right[None, :, :]).sum(2, dtype=np.int64)
                total = x.n[i][:, None] + y.n[to][None, :]
                # a + b - 2 o differ, and o * (num + den) >= num * (a + b) is asked for.
                good = ((total - least) * (num + den) >= 2 * num * total) & (x.label[i][:, None] != y.label[to][None, :])
                if same:
                    good &= i[:, None] < to[None, :]
                a, b = np.nonzero(good)
                out.append((i[a], to[b], least[a, b]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def answers(x: _Members, y: _Members, i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Which of the pairs (i in ``x``, j in ``y``) the fragment ``key`` proposes:
    those of which it is the least common fragment, and those whose least
    fragments don't tell.  The least key in both lists is the least of all that
    both sets have, as a lesser one would be in both lists, too."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        both = (x.least[a][:, :, None] == y.least[b][:, None, :]) & x.filled[a][:, :, None] & y.filled[b][:, None, :]
        lesser = both.any(2) & (x.least[a] < key)
        out[k : k + (1 << 16)] = ~lesser.any(1)
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges (a, b), taken in order, join what isn't joined yet."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = x = top.get(y, y)
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            top[x] = y
            out.append(k)
    return out


def _propose(most: int, num: int, den: int):
    """Pairs (a, b) to count, from pairs of blocks (key, x, y; y null: x with
    itself): with ``most`` 0 the most alike ones that span all labels, else the
    ``most`` most alike ones of each two labels.  ``more``: some are left out."""
    def run(batches):
        for batch in batches:
            keys, xs, ys = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for r in range(batch.num_rows):
                x = _Members(xs[r].values)
                same = not ys[r].is_valid
                y = x if same else _Members(ys[r].values)
                i, j, least = within_reach(x, y, num, den, same)
                if most:
                    own = answers(x, y, i, j, keys[r])
                    i, j, least = i[own], j[own], least[own]
                if not len(i):
                    continue
                a, b = np.minimum(x.node[i], y.node[j]), np.maximum(x.node[i], y.node[j])
                p, q = np.minimum(x.label[i], y.label[j]), np.maximum(x.label[i], y.label[j])
                if most == 0:
                    order = np.lexsort((b, a, least))
                    some = order[spanning(p[order], q[order])]
                else:
                    order = np.lexsort((b, a, least, q, p))
                    first = np.concatenate([[True], (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)])
                    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                    some = order[np.arange(len(order)) - start < most]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, keys[r])), pa.array(a[some]), pa.array(b[some]), pa.array(np.full(n, n < len(order)))], names=["key", "a", "b", "more"])

    return run


def _overlaps(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: overlaps by fragment, summed per pair."""
    def count(batches):
        for b in batches:
            n = [
                len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "part"])

    side = lambda n, m, h: sets.where("part >= 0").select(F.col("node").alias(n), "part", F.col("n").alias(m), F.col("hashes").alias(h))
    parts = []
    for p in range(COUNT_FRAGMENTS):  # one after another, so a part's hashes alone are shuffled at a time
        both = pairs.join(side("a", "na", "x").where(F.col("part") == p), "a").join(side("b", "nb", "y").where(F.col("part") == p).drop("part"), "b").select("a", "b", "na", "nb", "x", "y")
        with small_batches(pairs.sparkSession, TEXT_ROWS):
            parts.append(written(both.mapInArrow(tidy(count), "a long, b long, na long, nb long, part long"), "overlaps"))
        drop_shuffles(pairs.sparkSession)
    total = reduce(DataFrame.unionAll, parts).groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
    return total.where(F.col("o") * den >= (F.col("na") + F.col("nb") - F.col("o")) * num).select("a", "b")


def _block_pairs(left: DataFrame, label: DataFrame | None, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of unsettled fragments, of about ``BLOCK_BYTES`` each, and
    pairs of them (key, x, y) that may hold two labels.  Sets of a fragment's
    most frequent label have blocks of their own.  Without labels yet, a block
    meets itself and the fragment's first only."""
    if label is None:
        now, single = left.withColumn("label", F.col("node")), True
    else:
        now, single = left.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), False
    per = now.groupBy("key", "label").agg(F.sum("bytes").alias("c")).groupBy("key").agg(
        F.sum("c").alias("size"), F.count("*").alias("kinds"), F.max_by("label", F.struct("c", "label")).alias("main")).where("kinds > 1")
    deal = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_BYTES).cast("long"))
    if not single:
        deal = deal * 2 + (F.col("label") != F.col("main")).cast("int")
    rows = now.join(per.select("key", "size", "main"), "key").select("key", "node", "label", deal.alias("block")).join(sketches, "node")
    blocks = written(rows.groupBy("key", "block").agg(
        F.collect_list(F.struct("node", "n", "label", "hashes", "least_keys")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi")), "blocks")
    drop_shuffles(left.sparkSession)
    # Only fragments of several blocks meet; most have one.
    counted = blocks.groupBy("key").agg(F.min("block").alias("least"), F.count("*").alias("n"))
    several = bounded_broadcast(written(counted.where("n > 1").select("key", "least"), "several"))
    other = blocks.join(several.select("key"), "key", "left_semi").select("key", F.col("block").alias("to"), F.col("x").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    own = blocks.where("lo < hi").select("key", "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    cross = blocks.join(several, "key").join(other, "key").where("block < to and (lo < least(hi, lo2, hi2) or lo2 < greatest(lo, hi, hi2) or lo <> lo2)")
    if single:
        cross = cross.where("block = least")
    n = counted.agg(F.sum(F.col("n") * (2 if single else (F.col("n") + 1) / 2))).first()[0]
    return blocks, in_parts(own.union(cross.select("key", "x", "y")), int(n or 0), BLOCKS)


def _settle(kept: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, label): the components of the nodes by all links.

    First, in the fragments that each set shares with most others, the most
    alike sets that would connect the fragment are counted.  Then, of each two
    labels that still meet in any fragment, the most alike pairs, ever more of
    them, until each pair that the sketches allow has been counted or its sets
    are connected."""
    spark = kept.sparkSession
    # Fragments of the same sets are one.
    digest = kept.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    one = digest.groupBy("c", "h").agg(F.min("key").alias("key")).select("key", "c")
    size = (64 + F.least(F.col("n") / 4, F.lit(SKETCH_BITS / 8))).cast("long").alias("bytes")
    drop_shuffles(spark)
    left = written(in_parts(kept.select("key", "node", size).join(one, "key"), kept.count(), ROWS), "fragments")
    n = left.count()
    order = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    least = left.withColumn("rank", order).where(F.col("rank") <= LEAST_KEYS).groupBy("node").agg(F.collect_list("key").alias("least_keys"))
    sketches = written(in_parts(sets.where("part < 0").select("node", "n", "hashes").join(least, "node"), n, ROWS), "sketches")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "key"))
    near = written(in_parts(left.withColumn("rank", rank).where(F.col("rank") <= FIRST_FRAGMENTS).drop("rank"), n, ROWS), "fragments")
    links = tested = label = None
    most = 0
    while True:
        made = []
        for k in range(SHARES):
            share = (left if most else near).where(F.pmod(F.xxhash64("key"), F.lit(SHARES)) == k)
            blocks, pairs = _block_pairs(share, label, sketches)
            with small_batches(spark, 256):
                made.append(written(pairs.mapInArrow(tidy(_propose(most, num, den)), "key long, a long, b long, more boolean"), "proposed"))
            discard(spark, blocks)
        found = reduce(DataFrame.unionAll, made)
        new = found.select("a", "b").distinct()
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new = written(in_parts(new, found.count(), ROWS), "pairs")
        good = written(in_parts(_overlaps(new, sets, num, den), new.count(), PAIRS_PER_PART), "links")
        drop_shuffles(spark)
        if most == 0 or good.limit(1).count():
            links = good if links is None else links.union(good)
            label = components(links)
        if most and found.where("more").limit(1).count() == 0:
            discard(spark, sketches)
            return label
        if most == 0:
            discard(spark, near)
        else:  # a fragment of which no pair was left out has all its pairs counted
            rest = written(in_parts(left.join(found.where("more").select("key").distinct(), "key", "left_semi"), n, ROWS), "fragments")
            discard(spark, left)
            left = rest
        for x in made:
            discard(spark, x)
        tested = new if tested is None else tested.union(new)
        most = max(PAIRS, most * PAIRS)
