"""Mixing, hard negatives and alignment against brute force, with edge cases."""

import bisect
import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.llm import alignment, mixing, ngram_join, queries, vp_tree
from pairlens.llm.tokens import byte_alphabet, tokenizer_path

# op11 --------------------------------------------------------------------------------------


def highest_quotients(votes: dict, limits: dict, seats: int) -> dict:
    """One seat at a time, to the highest votes / (2 * seats so far + 1)."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        left = [p for p in votes if got[p] < limits[p]]
        if not left:
            break
        top = max(votes[p] / (2 * got[p] + 1) for p in left)
        got[min(p for p in left if votes[p] / (2 * got[p] + 1) == top)] += 1
    return got


@pytest.mark.parametrize("kind", ["mixed", "few seats", "ties", "limited"])
def test_apportion(spark, kind):
    rng = random.Random(kind)
    groups = {}
    for g in range(4):
        votes = {p: rng.uniform(0.2, 50) for p in range(rng.randint(1, 30))}
        if kind == "ties":
            votes = {p: float(rng.choice([1, 3, 9])) for p in range(20)}
        most = {p: rng.randint(1, 3) if kind == "limited" else 1000 for p in votes}
        groups[g] = votes, most, rng.randint(0, 3) if kind == "few seats" else rng.randint(10, 300)
    parties = spark.createDataFrame([(g, p, x, m[p]) for g, (v, m, _) in groups.items() for p, x in v.items()], "group int, party int, votes double, limit long")
    seats = spark.createDataFrame([(g, n) for g, (_, _, n) in groups.items()], "group int, seats long")
    got = {(r.group, r.party): r.quota for r in mixing.apportion(parties, seats).collect()}
    assert got == {(g, p): n for g, (v, m, s) in groups.items() for p, n in highest_quotients(v, m, s).items()}


def shared(sizes: dict, weights, share, most) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * unit >= most * sizes[s]}
        if not above:
            return target | {s: weight[s] * unit for s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 7, 60, 400]))), rng.choice(["hot"] * 6 + ["a", "b", "é", None, ""])) for i in range(300)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (5, None, "b"), (5, " \n\t", "b"), (6, "one word \x1f two", "alone"), (7, "w " * 30_000, "a"), (8, "", "nothing")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, party int")
    got = mixing.mix(d.repartition(7), block_words=8, shard_words=3000).collect()
    size_of = lambda t: len([w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size_of(t)
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in got) == collections.Counter((i, s, size_of(t)) for i, t, s in rows)
    want = shared(sizes, (5, 2, 1), 1.5, 2)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
        assert r.taken == sum((t["to"] - t["from"]) * t["times"] for t in r.takes) and all(0 <= t["from"] < t["to"] <= r["size"] for t in r.takes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * 8 for s in sizes)
    again = mixing.mix(d.repartition(3), block_words=8, shard_words=3000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixing.mix(d, seed=1, block_words=8, shard_words=3000).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    assert mixing.mix(d.where("false")).count() == 0
    assert [r.taken for r in mixing.mix(d.where("text is null")).collect()] == [0]


def test_count_words():
    texts = ["", None, " a", "a", "a b", "　 x y ", "end ", "\n\n", "x"]
    a = pa.array(texts)
    assert mixing.count_words(a).tolist() == [0, 0, 1, 1, 2, 2, 1, 0, 1]
    assert mixing.count_words(a.slice(3, 4)).tolist() == [1, 2, 2, 1]


# op12 --------------------------------------------------------------------------------------


def brute_negatives(rows, anchors=50, positives=5, negatives=3):
    dims = max((len(v) for _, v, _ in rows if v), default=0)
    fine = [(i, np.floor(256 * np.array(list(v) + [0.0] * (dims - len(v)))), (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows
            if v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    key = lambda s: lambda k: (-s[k], fine[k][0] is None, fine[k][0] or 0)
    for a, (i, q, y) in enumerate(fine):
        if i is None or i % anchors:
            continue
        s = [int(q @ v) for _, v, _ in fine]
        near = sorted((k for k in range(len(fine)) if k != a and fine[k][2] == y), key=key(s))[:positives]
        for p in near:
            far = sorted((k for k in range(len(fine)) if fine[k][2] != y and 50 * s[p] <= 100 * s[k] <= 95 * s[p]), key=key(s))[:negatives]
            out += [(i, fine[p][0], r + 1, fine[k][0], s[p], s[k]) for r, k in enumerate(far)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(vp_tree, "BLOCK_ROWS", 60)  # several leaves, blocks and buckets
    monkeypatch.setattr(vp_tree, "BUCKET_ROWS", 8)
    monkeypatch.setattr(vp_tree, "QUERIES", 5)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = []
    for i in range(500):
        c = int(rng.integers(6))
        v = (centres[c] + rng.normal(size=5) * 0.4) / 2
        rows.append((i, [float(np.float32(x)) for x in v], int(c if rng.random() < 0.6 else rng.integers(10))))
    hot = rows[3][1]
    rows += [(1000 + i, hot, int(i % 10)) for i in range(200)]  # one vector holds a third of the rows
    rows += [(50, rows[8][1], 3), (50, rows[8][1], 3), (None, rows[9][1], 2), (None, hot, 1), (2000, None, 1), (2050, [1.0, None, 0.0, 0.0, 0.0], 1),
             (2100, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (2150, [float("inf")] + [0.0] * 4, 1), (2200, [0.5] * 5, None), (2250, [], 4), (2300, [0.5, 0.25], 4), (2350, [0.0] * 5, 5)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, query int").repartition(5)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in vp_tree.hard_negatives(d).select(*cols).collect()), key=str)
    assert got == brute_negatives(rows) and len(got) > 100
    assert vp_tree.hard_negatives(d.where("false")).count() == 0
    assert vp_tree.hard_negatives(d.where("vec_id = 100")).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(4)
    x = vp_tree.augment(rng.integers(-200, 200, (300, 6)).astype(float), 4e5)
    x[50:150] = x[3]
    tree = vp_tree.Tree(x, 16)
    assert sorted(tree.order.tolist()) == list(range(300)) and len(tree.starts) == 17
    q = rng.integers(-200, 200, (40, 7)).astype(float)
    near, far = vp_tree.bounds(vp_tree.distances(q, x[tree.vantage]), tree.lo, tree.hi)
    d = vp_tree.distances(q, x[tree.order])
    for k in range(16):
        own = d[:, tree.starts[k] : tree.starts[k + 1]]
        assert (near[:, k] <= own.min(1) + 1e-9).all() and (far[:, k] >= own.max(1) - 1e-9).all()


def test_hard_negatives_refuses_what_it_cannot_score(spark):
    d = spark.createDataFrame([(50, [1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        vp_tree.hard_negatives(d)


# op13 --------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    back = {c: b for b, c in byte_alphabet().items()}
    bytes_a = {k: bytes(back[c] for c in t) for t, k in one.get_vocab().items() if t != "<|endoftext|>"}
    byte_b = lambda k: bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()
    made, held = [], collections.Counter()
    for i, t in rows:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(bytes_a[x] for x in a) != raw or b"".join(map(byte_b, b)) != raw:
            made.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(f(x)) for x in ids]).tolist() for f, ids in ((bytes_a.get, a), (byte_b, b))]
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if max(s, u) < min(e, v)] if len(a) < 3000 else [
            (a[bisect.bisect_right(ends[0], p)], b[bisect.bisect_right(ends[1], p)]) for p in sorted({0, *ends[0][:-1], *ends[1][:-1]})]
        groups, at = [], [0, 0]
        for c in sorted(set(ends[0]) & set(ends[1])):
            to = [bisect.bisect_right(e, c) for e in ends]
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        made.append((i, a, b, groups, links))
        held.update(set(links))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    text = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return collections.Counter(
        (i, len(a), len(b), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text(g)) for i, a, b, g, links in made)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 700)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    rng = random.Random(2)
    words = ["the", "tokenization", "Übergröße", "naïve", "x=1;", "don't", "日本語", "á", "🤗", "über,", "<s>", "<|endoftext|>", "<0x0A>", "</s>", "<unk>", "(e.g.)", "1234567", "İ", " ", "tab\there"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", " \n", "\r\n", "    ", "\t", "　"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "\n"), (105, "\nx"), (106, " lead"), (107, "a▁b c"), (108, "x\x1fy z"), (109, "a \nb"), (110, "\x00 ﻿z"), (None, rows[0][1]), (3, rows[3][1]), (3, "again")]
    d = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, chunk int, n_a int").repartition(4)
    got = collections.Counter(tuple(r[c] for c in COLUMNS) for r in alignment.align(d).collect())
    assert got == brute_alignment(rows)
    assert next(r for r in alignment.align(d.where("doc_id = 107")).collect()).n_a == 0
    assert alignment.align(d.where("false")).count() == 0


def test_alignment_of_a_long_text_and_digests(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(1, " ".join(rng.choice(["alpha", "beta,", "gammadelta", "x9"]) for _ in range(20_000))), (2, "alpha beta"), (3, "q" * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in alignment.align(d).collect()}
    short = {r.doc_id: r for r in alignment.align(d, digest=True).collect()}
    assert all(short[i].groups == hashlib.sha256(whole[i].groups.encode()).hexdigest() for i in whole)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in whole.values()) == brute_alignment(rows)


def test_union_find():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, m = int(rng.integers(1, 60)), int(rng.integers(0, 60))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        least = list(range(n))
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert alignment.components(n, a, b).tolist() == least


# op3, rows without ids ---------------------------------------------------------------------


@pytest.mark.parametrize("ids", ["none", "one", "few"])
def test_ngram_join_of_rows_that_repeat_ids(spark, ids):
    """Near copies whose ids say nothing: as many rows as there are, sizes and links by the texts."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base) if i % 3 else [f"v{rng.randrange(10**6)}" for _ in range(30)]
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append(({"none": None, "one": 7, "few": i % 4}[ids], " ".join(w)))
    rows += [rows[1], rows[1], (rows[1][0], "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(d).collect())
    shingles = [frozenset(zip(*[t.split()[k:] for k in range(4)], strict=False)) for _, t in rows]
    linked = [{j for j in range(len(rows)) if shingles[i] and shingles[j] and 100 * len(shingles[i] & shingles[j]) >= 85 * len(shingles[i] | shingles[j])} | {i} for i in range(len(rows))]
    least = [min((rows[j][0] for j in s if rows[j][0] is not None), default=None) for s in linked]
    for _ in range(10):
        least = [min((least[j] for j in linked[i] if least[j] is not None), default=None) for i in range(len(rows))]
    assert got == collections.Counter((i, len(s), c) for (i, _), s, c in zip(rows, shingles, least, strict=True))


# queries -----------------------------------------------------------------------------------


def test_new_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    types = {
        "op11_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op12_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    }
    for name, kinds in types.items():
        out = queries.QUERIES[name](spark, sf)
        assert sorted(f"{c} {t}" for c, t in out.dtypes) == sorted(kinds.split(", "))
        assert out.count() == docs or name.startswith("op12")
    assert queries.op11_mixing(spark, sf).agg(F.sum("taken")).first()[0] > 0


def test_links_of_any_ends():
    """One link per stretch between neighbouring ends, by marks as by search,
    tokens without a byte included."""
    rng = np.random.default_rng(3)
    for least in (1, 0):
        for _ in range(50):
            a, b = (np.cumsum(rng.integers(least, 5, rng.integers(1, 30))) for _ in range(2))
            end = max(a[-1], b[-1]) + 1
            a, b = np.append(a, end), np.append(b, end)
            x, y = alignment.links_of(a, b)
            want = [(sum(e < s for e in a), sum(e < s for e in b)) for s in sorted({*a.tolist(), *b.tolist()} - {0})]
            assert [p for p, s in zip(zip(x.tolist(), y.tolist(), strict=True), np.union1d(a, b), strict=True) if s] == want
    assert [z.tolist() for z in alignment.links_of(a[:0], b[:0])] == [[], []]


@pytest.mark.parametrize("most", [9, (1 << 31) - 1])
def test_pairs_of_texts(most):
    """Each text's distinct pairs and their links, of small ids and of any."""
    rng = np.random.default_rng(6)
    a, b = (np.append(rng.integers(0, 9, 400), most) for _ in range(2))
    text = np.sort(np.append(rng.integers(0, 7, 400), 7))
    pair, of, times = alignment.pairs_of_texts(a, b, text)
    got = list(zip(of.tolist(), (pair >> 32).tolist(), (pair & (1 << 32) - 1).tolist(), times.tolist(), strict=True))
    want = collections.Counter(zip(text.tolist(), a.tolist(), b.tolist(), strict=True))
    assert got == [(*k, want[k]) for k in sorted(want)]
    empty = np.zeros(0, np.int64)
    assert [len(x) for x in alignment.pairs_of_texts(empty, empty, empty)] == [0, 0, 0]


def test_group_texts_of_ids_of_any_width():
    digits = alignment._digits(1001)
    a, b, of = np.array([0, 1000, 7, 10]), np.array([5, 60, 999]), lambda *x: np.array(x)
    got = alignment.group_texts(a, b, of(0, 0, 1, 2), of(0, 1, 2), of(0, 2, 2, 3), digits)
    assert got == [b"0,1000|5;7|60", b"", b"10|999"]
