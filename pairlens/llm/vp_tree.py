"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm, an anchor
q becomes (q, 0).  Then |q' - x'|^2 = |q|^2 + M - 2 <q, x>: higher scores are
nearer, and a window of scores is an annulus around the anchor.

A top tree, fitted on a bounded sample, deals all rows to leaves, and large
leaves are split into blocks; each block has a tree of its own.  An anchor
visits the leaf that promises most, which bounds its k-th distance, and then
the leaves that may hold something nearer.  In a block, buckets are visited
nearest first within the annulus, many anchors in step, until the next bucket
is farther than the k-th row found.  Bounds are those of the triangle
inequality with some slack, so the search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Rows that the top tree is fitted on, its leaves at most, rows of a block and
#: of a bucket, and anchors that meet a block at once, about.
SAMPLE_ROWS, LEAVES, BLOCK_ROWS, BUCKET_ROWS, QUERIES = 8192, 256, 2048, 64, 8192
#: Of distances, which are of the order of the vectors' norms.
SLACK = 1e-3
_FAR, _NO_ID = np.int64(1) << np.int64(60), np.iinfo(np.int64).max


class Tree:
    """A perfect tree of splits by rank, nodes in heap order.

    ``order`` has the rows bucket by bucket; a child's ``lo`` and ``hi`` are its
    rows' least and largest distance to its parent's vantage point."""

    def __init__(self, aug: np.ndarray, buckets: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(buckets).bit_length() - 1)
        inner = (1 << self.depth) - 1
        self.vantage, self.cut = np.zeros(inner, np.int64), np.zeros(inner)
        self.lo, self.hi = np.full(2 * inner + 1, np.inf), np.zeros(2 * inner + 1)
        parts = [np.arange(len(aug))]
        for node in range(inner):
            rows = parts[node]
            if len(rows):
                v = rows[rng.integers(len(rows))]
                d = distances(aug[[v]], aug[rows])[0]
                o, half = np.argsort(d, kind="stable"), (len(rows) + 1) // 2
                self.vantage[node], self.cut[node] = v, d[o[half - 1]]
                for child, own in ((2 * node + 1, o[:half]), (2 * node + 2, o[half:])):
                    parts.append(rows[own])
                    if len(own):
                        self.lo[child], self.hi[child] = d[own].min(), d[own].max()
            else:
                parts += [rows, rows]
        leaves = parts[inner:]
        self.order = np.concatenate(leaves)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` to each of ``y``."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def augment(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]])


def bounds(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From distances to vantage points, the least and the largest possible
    distance to the rows of each bucket."""
    inner = d.shape[1]
    near, far = np.zeros((len(d), 2 * inner + 1)), np.full((len(d), 2 * inner + 1), np.inf)
    for node in range(inner):
        x = d[:, node]
        for c in (2 * node + 1, 2 * node + 2):
            near[:, c] = np.maximum(near[:, node], np.maximum(lo[c] - x, x - hi[c]) - SLACK)
            far[:, c] = np.minimum(far[:, node], hi[c] + x + SLACK)
    return near[:, inner:], far[:, inner:]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dims).astype(np.float64)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, v): components as floor(256 x) in 32-bit integers,
    without the rows that have a null or non-finite one, or no label."""
    whole = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & whole.isNotNull() & F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 4e6))
    bad = vectors.where(F.exists(whole, lambda x: (F.abs(x.cast("double")) >= 4e6) & (F.abs(x.cast("double")) < float("inf"))))
    if bad.limit(1).count():
        raise ValueError("components of four million and more make no exact scores")
    d = vectors.where(fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(whole, lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("v"))

    def pack(batches):
        for b in batches:
            lists = b.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            out = [flat[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["row", "vec_id", "label", "v"])

    return d.mapInArrow(pack, "row long, vec_id long, label long, v binary")


class Index:
    """The rows of ``rows`` (row, vec_id, label, v) in blocks with trees, as a
    table in the shared folder; the driver has the top tree alone."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        self.dims = dims = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4

        def pad(batches):
            for b in batches:
                v = [x.ljust(4 * dims, b"\0") for x in b.column(3).to_pylist()]
                m = np.frombuffer(b"".join(v), "<i4").reshape(len(v), dims).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(v, pa.binary()), pa.array((m * m).sum(1))], names=["row", "vec_id", "label", "v", "square"])

        self.rows = written(rows.mapInArrow(pad, "row long, vec_id long, label long, v binary, square double"), "vectors")
        self.count, most = self.rows.agg(F.count("*"), F.max("square")).first()
        self.most = most = float(most or 0)
        if most >= 2.0**51:
            raise ValueError("vectors this long make no exact scores")
        some = self.rows.orderBy(F.xxhash64("v", "vec_id"), "row").limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks()
        leaves = 1
        while leaves < LEAVES and leaves * BLOCK_ROWS < self.count:
            leaves *= 2
        sample = augment(_matrix(some, dims), most) if len(some) else np.zeros((0, dims + 1))
        tree = Tree(sample, leaves if len(some) >= leaves else 1)
        self.vantage, self.cut = vantage, cut = sample[tree.vantage], tree.cut
        depth = tree.depth

        def route(batches):
            for b in batches:
                aug = augment(_matrix(b.column(3), dims), most)
                d = distances(aug, vantage) if len(vantage) else np.zeros((len(aug), 0))
                node, path = np.zeros(len(aug), np.int64), []
                for _ in range(depth):
                    x = d[np.arange(len(aug)), node]
                    path.append(x)
                    node = 2 * node + 1 + (x > cut[node])
                leaf = node - ((1 << depth) - 1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(path).ravel() if path else np.zeros(len(aug))), max(1, depth)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(leaf), lists], names=["row", "vec_id", "label", "v", "leaf", "path"])

        dealt = written(self.rows.select("row", "vec_id", "label", "v").mapInArrow(route, "row long, vec_id long, label long, v binary, leaf long, path array<double>"), "leaves")
        # As many rows as there are leaves, of LEAVES at most, come to the driver.
        ranges = dealt.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("path")[k]).alias(f"{name}{k}") for k in range(depth) for name, f in (("lo", F.min), ("hi", F.max))]).collect()
        inner = (1 << depth) - 1
        self.lo, self.hi = np.full(2 * inner + 1, np.inf), np.full(2 * inner + 1, -np.inf)
        self.blocks = [0] * (inner + 1)
        for r in ranges:
            node = r["leaf"] + inner
            self.blocks[r["leaf"]] = -(-r["n"] // BLOCK_ROWS)
            for k in range(depth - 1, -1, -1):
                self.lo[node], self.hi[node] = min(self.lo[node], r[f"lo{k}"]), max(self.hi[node], r[f"hi{k}"])
                node = (node - 1) // 2
        parts = F.array(*map(F.lit, self.blocks))[F.col("leaf").cast("int")]
        block = (F.shiftleft("leaf", 32) + F.pmod(F.xxhash64("row"), parts)).alias("block")

        def build(t: pa.Table) -> pa.Table:
            v = _matrix(t["v"].combine_chunks(), dims)
            # Rows in order of the id, so a stable choice of the best has the least ids.
            o = np.lexsort((pc.fill_null(t["vec_id"], int(_NO_ID)).to_numpy(),))
            v = v[o]
            aug = augment(v, most)
            own = Tree(aug, max(1, len(v) // BUCKET_ROWS))
            at, inside = own.order, np.repeat(np.arange(len(own.starts) - 1), np.diff(own.starts))
            at = at[np.lexsort((at, inside))]
            ids = pc.fill_null(t["vec_id"], int(_NO_ID)).to_numpy()[o][at]
            blob = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
            return pa.table([
                t["block"].slice(0, 1).combine_chunks(), blob(v[at], "<i4"), blob(ids, "<i8"), blob(t["label"].to_numpy()[o][at], "<i8"), blob(t["row"].to_numpy()[o][at], "<i8"),
                blob(own.starts, "<i8"), blob(aug[own.vantage], "<f8"), blob(own.lo, "<f8"), blob(own.hi, "<f8")],
                names=["block", "v", "ids", "labels", "rows", "starts", "vantage", "lo", "hi"])

        schema = "block long, v binary, ids binary, labels binary, rows binary, starts binary, vantage binary, lo binary, hi binary"
        self.table = written(dealt.select(block, "row", "vec_id", "label", "v").groupBy("block").applyInArrow(build, schema), "blocks")
        discard(self.spark, dealt)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, rank, id, score) of each query's ``k`` best rows.

        ``queries`` (query, row, label, v, least, most): rows of the same label,
        or of another, with scores from ``least`` to ``most``, without the row
        itself; higher scores first, ties by the smaller id, null ids last."""
        queries = written(queries.select("query", "row", "label", "v", "least", "most"), "queries")
        first = written(self._step(queries, k, same, None), "found")
        best = _ranked(first, k)
        bound = best.groupBy("query").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        rest = self._step(queries.join(bound, "query", "left"), k, same, "kth")
        out = written(_ranked(first.union(rest), k), "best")
        discard(self.spark, queries)
        discard(self.spark, first)
        return out

    def _step(self, queries: DataFrame, k: int, same: bool, kth: str | None) -> DataFrame:
        """The best rows of each query by blocks: of the leaf that promises most,
        or with ``kth`` of all others that may hold a row as good."""
        dims, most, vantage, lo, hi, blocks = self.dims, self.most, self.vantage, self.lo, self.hi, np.array(self.blocks)
        inner = len(vantage)

        def route(batches):
            for b in batches:
                v, least, top = _matrix(b.column(3), dims), b.column(4).to_numpy(), b.column(5).to_numpy()
                reach = (v * v).sum(1) + most
                d = distances(np.hstack([v, np.zeros((len(v), 1))]), vantage) if inner else np.zeros((len(v), 0))
                near, far = bounds(d, lo, hi)
                able, low = _scores(near, far, reach)
                able = np.minimum(able, top[:, None].astype(np.float64))
                able[:, blocks == 0] = -np.inf
                fits = (able >= least[:, None]) & (low <= top[:, None])
                home = np.argmax(np.where(fits, able, -np.inf), 1)
                if kth is None:
                    go = np.zeros_like(fits)
                    go[np.arange(len(v)), home] = fits[np.arange(len(v)), home]
                else:
                    go = fits & (able >= pc.fill_null(b.column(6), -int(_FAR)).to_numpy()[:, None])
                    go[np.arange(len(v)), home] = False
                q, leaf = np.nonzero(go)
                n = blocks[leaf]
                q, leaf = np.repeat(q, n), np.repeat(leaf, n)
                part = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                for i in range(0, len(q), 4096):
                    at = pa.array(q[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array((leaf[i : i + 4096] << 32) + part[i : i + 4096]), *(b.column(c).take(at) for c in range(len(b.columns)))], names=["block", *b.schema.names])

        bound = F.lit(-int(_FAR)).alias("kth") if kth is None else F.coalesce("kth", F.lit(-int(_FAR))).alias("kth")
        groups = max(1, -(-queries.count() // QUERIES))
        routed = queries.select("query", "row", "label", "v", "least", "most", bound).mapInArrow(
            route, "block long, query long, row long, label long, v binary, least long, most long, kth long").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(groups)))
        tables = self.table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("long"))

        def visit(block: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["query", "id", "score"]
            if not block.num_rows or not asked.num_rows:
                return pa.table([pa.array([], pa.int64())] * 3, names=names)
            get = lambda c, kind: np.frombuffer(block[c][0].as_py(), kind)
            x, ids, labels, rows = get("v", "<i4").reshape(-1, dims).astype(np.float64), get("ids", "<i8"), get("labels", "<i8"), get("rows", "<i8")
            starts, points = get("starts", "<i8"), get("vantage", "<f8").reshape(-1, dims + 1)
            out = [[], [], []]
            for i in range(0, asked.num_rows, 2048):
                t = asked.slice(i, 2048)
                score, found = _nearest_first(
                    _matrix(t["v"].combine_chunks(), dims), *(t[c].to_numpy() for c in ("label", "row", "least", "most", "kth")),
                    x, ids, labels, rows, starts, points, get("lo", "<f8"), get("hi", "<f8"), most, k, same)
                q, r = np.nonzero(score > -np.inf)
                out[0].append(t["query"].to_numpy()[q])
                out[1].append(found[q, r])
                out[2].append(score[q, r].astype(np.int64))
            return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

        keys = ["block", "part"]
        return tables.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(visit, "query long, id long, score long")


def _scores(near: np.ndarray, far: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and lowest scores that distances between ``near`` and ``far`` allow."""
    high = (reach[:, None] - np.square(np.maximum(near, 0))) / 2 + 1
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(near), high, -np.inf), (reach[:, None] - np.square(far)) / 2 - 1


def _nearest_first(v, label, row, least, most, kth, x, ids, labels, rows, starts, points, lo, hi, largest, k, same):
    """(scores, ids), n x k, of the best rows of one block for ``n`` queries."""
    n = len(v)
    reach = (v * v).sum(1) + largest
    d = distances(np.hstack([v, np.zeros((n, 1))]), points) if len(points) else np.zeros((n, 0))
    high, low = _scores(*bounds(d, lo, hi), reach)
    high = np.minimum(high, most[:, None])  # no nearer than the annulus
    high[low > most[:, None]] = -np.inf  # wholly within its hole
    order = np.argsort(-high, axis=1, kind="stable")
    score, found = np.full((n, k), -np.inf), np.full((n, k), _NO_ID)
    floor = np.maximum(least, kth).astype(np.float64)
    active = np.arange(n)
    for turn in range(high.shape[1]):
        bucket = order[active, turn]
        go = high[active, bucket] >= np.maximum(floor[active], score[active, k - 1])
        active, bucket = active[go], bucket[go]  # the next bucket is farther still
        if not len(active):
            break
        by = np.argsort(bucket, kind="stable")
        kinds, at = np.unique(bucket[by], return_index=True)
        for c, own in zip(kinds.tolist(), np.split(active[by], at[1:]), strict=True):
            i, j = starts[c], starts[c + 1]
            s = v[own] @ x[i:j].T
            fits = (s >= np.maximum(floor[own], score[own, k - 1])[:, None]) & (s <= most[own, None]) & (row[own, None] != rows[None, i:j])
            fits &= (labels[None, i:j] == label[own, None]) == same
            hit = fits.any(1)
            if not hit.any():
                continue
            own, s = own[hit], np.where(fits[hit], s[hit], -np.inf)
            s, who = np.hstack([score[own], s]), np.hstack([found[own], np.broadcast_to(ids[i:j], (len(own), j - i))])
            o = np.lexsort((who, -s), axis=1)[:, :k]
            score[own], found[own] = np.take_along_axis(s, o, 1), np.take_along_axis(who, o, 1)
    return score, found


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.select("query", "id", "score", rank.alias("rank")).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 50 = 0", relabel: str = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, and the rank of the positive.

    ``anchors`` and ``relabel`` are conditions and expressions over vec_id and
    label.  Of each anchor's first ``positives`` other rows of its label, the
    first ``negatives`` rows of other labels with scores of ``low`` to ``high``
    per cent of the positive's.  Rows with a null or non-finite component, or
    without vector or label, take no part; a short vector counts as filled up
    with zeros.  Rows are told apart by themselves: one that repeats an id is
    another row, an anchor too, and its equal's positive.  A null id is never
    an anchor and comes last among ties.  An empty table gives an empty result;
    other columns are ignored."""
    rows = prepared(vectors, id_col, vector_col, label_col).withColumn("label", F.expr(relabel).cast("long"))
    index = Index(rows.select("row", "vec_id", "label", "v"))
    own = index.rows.where(F.expr(anchors)).select("row", "vec_id", "label", "v")
    far = F.lit(int(_FAR))
    found = index.search(own.select(F.col("row").alias("query"), "row", "label", "v", (-far).alias("least"), far.alias("most")), positives, True)
    pairs = written(found.select(F.col("query").alias("row"), F.col("id").alias("positive"), F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank")).join(own, "row").withColumn(
        "query", F.monotonically_increasing_id()), "windows")
    # low * p <= 100 * s <= high * p, in whole numbers.
    over = f"(positive_score * {high})"
    under = f"(-positive_score * {low})"
    most, least = (F.expr(f"({x} - pmod({x}, 100)) div 100") for x in (over, under))
    windows = pairs.select("query", "row", "label", "v", (-least).alias("least"), most.alias("most")).where("least <= most")
    best = index.search(windows, negatives, False)
    value = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c))
    return best.join(pairs.select("query", F.col("vec_id").alias("anchor_id"), "positive", "positive_score", "positive_rank"), "query").select(
        "anchor_id", value("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), value("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank")
