"""The operators of ``llm`` against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.llm import decontaminate as dc
from pairlens.llm import language, line_dedup, ngram_join, packing, quality_model, quality_rules, suffix_dedup, texthash, token_store, tokens, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=7, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties and a long one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "été", "#x", "İ", "the", "a"]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passage, rows = text(60), []
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 7 == 1:
            t = f"{text(5)}\n{passage}\n{text(8)}"
        if i % 5 == 2 and rows:
            w = (rows[i - 2][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "new"
            t = " ".join(w)
        if i % 11 == 3 and rows:
            t = rows[i - 1][1]
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "One"), (n + 5, text(4000)), (None, passage), (0, rows[0][1]), (0, text(30))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2) for i, t in corpus()]
    # Further columns have names that the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, k string, w int, row int").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_row(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# op1 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_token_store_round_trip(spark, docs, empty, tmp_path, small, monkeypatch):
    if small:  # several frames a partition, and several files
        monkeypatch.setattr(token_store, "LANES", 1)
        monkeypatch.setattr(token_store, "BLOCK_TOKENS", 64)
        monkeypatch.setattr(token_store, "FRAMES_PER_FILE", 2)
    tok = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json")).tok
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    path = str(tmp_path / "t")
    token_store.write_tokens(docs, path)
    got = token_store.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    want = collections.Counter()
    for i, t in rows:
        want[i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert token_store.token_store(empty).count() == 0


def test_coder_blocks_are_checked():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 50257, 5000), np.tile(rng.integers(0, 900, 50), 200), [65535, 0]]).astype(np.uint32)
    frame = token_store.encode_frame([1, None], np.array([15000, 2]), ids) + b"\n"
    got = list(token_store.decode_frames(frame))
    assert got[0][0] == [1, None] and (got[0][2] == ids).all() and len(frame) < 2 * len(ids)
    bad = bytearray(frame)
    bad[len(bad) // 2] ^= 255
    with pytest.raises(ValueError):
        list(token_store.decode_frames(bytes(bad)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(name):
    odd = ["it's John's. I'LL go,, 'tis..", "a  b\n\n c\t\te ", "", "¿Qué? x<|endoftext|>y <|startoftext|>.", "ΑΣ ΣΑΣ. 12.5, ½. ²!", " x  y", "é. ́a", "\x1c\x1d a", "c). (d)."]
    odd += [None, "plain words, Twice. twice", "\nfoo\nBar.\n.", "ends. ", "a.b.c, 3.14! x:y;z?", "<|ENDOFTEXT|> A", "ÀÉÎ İstanbul ſ œuvre.", "日本語。 test", "x\x1fy z"]
    e = tokens.Encoder(tokens.tokenizer_path(name), drop_space=name.startswith("word"))
    for _ in range(2):  # learnt, then remembered
        got = [x.tolist() for i, j, ids, n in e.encode(pa.array(odd, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.tok.encode(t or "", add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_in_small_steps(name, monkeypatch):
    monkeypatch.setattr(tokens, "NUMBERED", 300)
    monkeypatch.setattr(tokens, "JOINED", 60)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 5)
    texts = [t for _, t in corpus()]
    e = tokens.Encoder(tokens.tokenizer_path(name), drop_space=name.startswith("word"))
    got, rows = [], []
    for i, j, ids, n in e.encode(pa.array(texts, pa.string())):
        rows += range(i, j)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert rows == list(range(len(texts)))
    assert got == [e.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_parts_words_and_marks(name, monkeypatch):
    """A word with marks after it is no piece of its own, and ids stay the library's."""
    e, words, seen = tokens.Encoder(tokens.tokenizer_path(name), drop_space=name.startswith("word")), ["onan", "whtish", "né", "x1"], []
    monkeypatch.setattr(e, "_ids_of_new", lambda new, f=e._ids_of_new: seen.extend(new) or f(new))
    texts = [" " + w + m for w in words for m in ["$$$", "***", "&&&", "###", "%%%", '"', ")"]]
    list(e.encode(pa.array(texts)))
    assert len([x for x in seen if x]) == len(words) + 7
    odd = [f"a{c}b{c}{c} é{c}1{c}'s it{c}s ß{c}'ll{c}'" for c in map(chr, range(33, 127)) if not c.isalnum()]
    got = [x.tolist() for i, j, ids, n in e.encode(pa.array(odd)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_remembered_pieces():
    known = tokens.Remembered(4)
    long = "x" * (tokens.CACHE_LONGEST + 1)
    assert known.find(pa.array(["a"])).tolist() == [-1]
    known.add(pa.array(["a", long, "b"]), np.arange(6, dtype=np.uint32), np.array([0, 1, 4]), np.array([1, 3, 2]))
    known.add(pa.array(["c"]), np.array([7], np.uint32), np.array([0]), np.array([1]))
    at = known.find(pa.array(["c", long, "b", "a"]))
    assert at.tolist() == [2, -1, 1, 0]
    assert tokens.gathered(known.flat, known.start[at[[0, 2, 3]]], known.length[at[[0, 2, 3]]]).tolist() == [7, 4, 5, 0]
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    e.known = tokens.Remembered(2)
    for words in (["one two"], ["three four five"], ["five one"]):  # beyond its bound the last call's stay
        assert next(e.encode(pa.array(words)))[2].tolist() == e.tok.encode(words[0], add_special_tokens=False).ids
    assert e.known.pieces.to_pylist() == ["five", " one"]


def test_coder_knows_a_frames_ids():
    """Order 0 goes by the ids of the frame: an id that is new to a block takes
    no more than others, and any ids come back."""
    ids = np.random.default_rng(4).integers(40000, 43000, 40960).astype(np.uint32)
    frame = token_store.encode_frame([7], np.array([len(ids)]), ids)
    assert 8 * len(frame) < 13 * len(ids)
    assert (next(token_store.decode_frames(frame + b"\n"))[2] == ids).all()
    bad = bytearray(frame + b"\n")
    bad[45] ^= 255  # of the table
    with pytest.raises(ValueError):
        list(token_store.decode_frames(bytes(bad)))
    rng = np.random.default_rng(5)
    for some in (np.array([2], np.uint32), rng.integers(0, (1 << 24) - 2, 70000).astype(np.uint32), rng.zipf(1.3, 9000).clip(0, 1 << 22).astype(np.uint32)):
        got = next(token_store.decode_frames(token_store.encode_frame([None], np.array([len(some)]), some) + b"\n"))
        assert got[0] == [None] and (got[2] == some).all()


def test_coder_on_text_and_on_runs():
    """Blocks of unequal length and of any ids come back; a text's ids take far
    fewer than their 16 bits, and long carries are passed on."""
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = next(e.encode(pa.array([" ".join(t or "" for _, t in corpus())] * 3, pa.string())))[2]
    rng = np.random.default_rng(9)
    blocks = [ids[:4096], np.zeros(3000, np.uint32), rng.integers(0, 65536, 2500).astype(np.uint32), np.array([50256], np.uint32), np.zeros(0, np.uint32)]
    blocks.sort(key=len, reverse=True)
    parts = token_store.encode_blocks(blocks, 16)
    back = token_store.decode_blocks(parts, np.array([len(b) for b in blocks]), 16)
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(blocks, back, strict=True))
    text = next(len(p) for p, b in zip(parts, blocks, strict=True) if len(b) == len(ids[:4096]))
    assert 8 * text < 12 * len(ids[:4096])
    large = [np.array([1 << 20, 5, 1 << 20], np.uint32)]
    assert (token_store.decode_blocks(token_store.encode_blocks(large, token_store.id_bits(large)), np.array([3]), 21)[0] == large[0]).all()
    with pytest.raises(ValueError):
        token_store.id_bits([np.array([1 << 24], np.uint32)])


# op2 ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choices("abcdefgh", k=1 << 20)) * 17  # beyond 16 MiB
    rows = [(1, "http://a", "<p>é\r\n\r\nWARC/1.1"), (2, None, None), (3, "u\r\nx", ""), (4, "v", "same"), (5, "v", "same"), (6, "w", big), (None, "n", "same"), (5, "z", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.archive(pages)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        top = max((j for j, _, u in rows if (u or "") == (t or "") and j is not None), default=None)
        again = sum((u or "") == (t or "") for _, _, u in rows) > 1 and top is not None and (i is None or i < top)
        want.append((i, len((t or "").encode()), digest(t), "revisit" if again else "response", top if again else None))
    assert by_row(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert {r.html for r in got.where("page_id in (1, 6)").collect()} == {rows[0][2], big}
    assert warc.archive(pages.where("false")).count() == 0
    small = warc.archive(pages, min_revisit_bytes=5)
    assert small.where("record_type = 'revisit'").count() == 0


def test_warc_normaliser_reads_any_streams():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one = zlib.compress(record * 3, 6, 31)
    assert list(warc.records(one)) == [record] * 3
    assert list(warc.records(one + one)) == [record] * 6
    members = b"".join(zlib.compress(record, 6, 31) for _ in range(4))
    assert [m[2] for m in warc.members(members)] == [record] * 4
    with pytest.raises(ValueError):
        list(warc.records(zlib.compress(record[:-5], 6, 31)))


# op3 ---------------------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 60, 100)])
def test_ngram_join(docs, empty, k, num, den):
    got = ngram_join.ngram_join(docs, k, num, den)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_components(corpus(), k, num, den)
    if k == 4:
        assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_of_chains(spark):
    """Near copies of which neighbours link and the ends don't, and a hub that
    links with neither side, settle in several rounds."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(45):
        if i % 3 == 0:
            base = [f"v{i}_{j}" if rng.random() < 0.012 else w for j, w in enumerate(base)]
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(ngram_join.ngram_join(d), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2**63, rng.integers(5, 400), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, len(x) * 3 // 4, False), rng.integers(0, 2**63, rng.integers(0, 90), dtype=np.uint64)]))
        a, b = (np.frombuffer(ngram_join.parity_sketch(z), np.uint64)[None, :] for z in (x, y))
        words = min(a.shape[1], b.shape[1])
        assert np.bitwise_count(ngram_join._fold(a, words) ^ ngram_join._fold(b, words)).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("block_bytes", [1 << 16, 600])
def test_ngram_join_of_large_families(spark, monkeypatch, block_bytes):
    """Families of texts about the threshold apart, in one block each and in many."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block_bytes)
    rng = random.Random(8)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(120)]
        for i in range(70):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                own[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
            rows.append((family * 100 + i, " ".join(own)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(ngram_join.ngram_join(d), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)


def _members(rows):
    return ngram_join._Members(pa.array(rows, pa.struct([
        ("node", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("hashes", pa.binary()), ("least_keys", pa.list_(pa.int64()))])))


def test_one_fragment_answers_for_a_pair():
    """Of the fragments that two sets share, the least one proposes them; where
    the least keys of both have none in common, each does."""
    rng = random.Random(5)
    keys = [rng.sample(range(-20, 20), rng.randint(1, 25)) for _ in range(40)]
    all_of = _members([(i, 10, i, bytes(8), sorted(x)[: ngram_join.LEAST_KEYS]) for i, x in enumerate(keys)])
    for a in range(40):
        for b in range(a):
            both = sorted({*keys[a]} & {*keys[b]})
            said = [k for k in both if ngram_join.answers(all_of, all_of, np.array([a]), np.array([b]), k)[0]]
            told = {*sorted(keys[a])[: ngram_join.LEAST_KEYS]} & {*sorted(keys[b])[: ngram_join.LEAST_KEYS]}
            assert said == (both[:1] if told else both)


def test_ngram_join_proposes_near_copies_once(spark, monkeypatch):
    """Texts that share many fragments and don't link: proposals are about as
    many as pairs, not as pairs times shared fragments, and what has been counted
    doesn't come again."""
    rows, seen, written = [], [], ngram_join.written
    base = [f"w{i}" for i in range(120)]
    for i in range(38):  # each two have 107 of 127 shingles in common, one less than asked for
        own = list(base)
        own[3 * i + 4 : 3 * i + 6] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(own)))

    def keeping(df, name):
        out = written(df, name)
        if name in ("proposed", "pairs"):
            seen.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "written", keeping)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(ngram_join.ngram_join(d), "doc_id", "n_shingles", "component_id") == brute_components(rows, 4, 85, 100)
    first = ngram_join.SHARES
    later = [n for name, n in seen[first + 1 :] if name == "proposed"]
    pairs = [n for name, n in seen[first + 1 :] if name == "pairs"]
    assert sum(pairs) and sum(later) <= 1.5 * sum(pairs) + 20


def test_join_and_lines_read_texts_in_small_batches(spark, docs, monkeypatch):
    """A batch holds some of a task's texts, and a task's memory goes with it."""
    from pairlens.llm import workers
    from pairlens.llm.common import TEXT_ROWS

    sizes = {}
    for module in (ngram_join, line_dedup):
        def noting(df, name, of=module.__name__.rpartition(".")[2], written=module.written):
            sizes[of, name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
            return written(df, name)

        monkeypatch.setattr(module, "written", noting)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ngram_join.ngram_join(docs).count()
    line_dedup.line_dedup(docs).count()
    texts = [("ngram_join", x) for x in ("nodes", "met", "sets", "overlaps")] + [("line_dedup", x) for x in ("lines", "variants", "words")]
    assert {sizes[x] for x in texts} == {TEXT_ROWS}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    keep = lambda batches: (workers.per_stage("powers", list) for _ in batches)
    assert list(workers.tidy(keep)([1, 2])) == [[], []] and not workers._kept


def test_spanning():
    assert ngram_join.spanning(np.array([1, 2, 1, 5, 3]), np.array([2, 3, 3, 6, 5])) == [0, 1, 3, 4]


# op4 ---------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p : p + window] for b in raw for p in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        gone = gone[: len(b)]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram"), [(400, 64), (60, 8)])
def test_suffix_dedup(spark, docs, empty, window, gram):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept"))
    got = sorted(((*r[:4], bytes(r[4])) for r in suffix_dedup.suffix_dedup(docs, window=window, gram=gram).select(*cols).collect()), key=str)
    assert got == brute_repeats(corpus(), window)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_periods(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abé ", k=900))
    rows = [(1, "x" * 300), (2, "x" * 40 + base[:300] + "y" + base[301:700]), (3, base), (4, "ab" * 120), (5, base[500:560] * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((100, 16), (40, 8)):
        got = sorted(((*r[:4], bytes(r[4])) for r in suffix_dedup.suffix_dedup(d, window=window, gram=gram).collect()), key=str)
        assert got == brute_repeats(rows, window)


def test_repeated_passages(spark, docs, empty):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    text = lambda n: [word() for _ in range(n)]
    inner = text(30)
    rows = [
        (1, " ".join(text(80) + passage + text(9))), (2, "\n".join(passage[5:56]) + " end"), (3, " ".join(text(4) + passage[:50] + text(9))),
        (4, " ".join(passage)), (None, " ".join(text(3) + passage[9:])), (6, " ".join(text(70))), (7, None), (8, ""), (9, " ".join(inner * 4)),
        (10, " ".join(["u"] * 51)), (10, " ".join(["u"] * 51)), (11, " ".join(["v"] * 50)), (12, " ".join(["v"] * 50)),
    ]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), passage_words=51)
    assert by_row(got, "doc_id", "repeats") == sorted(((i, i in (1, 2, 4, None, 10)) for i, _ in rows), key=str)
    words = [(t or "").split() for _, t in corpus()]
    seen = collections.defaultdict(set)
    for r, w in enumerate(words):
        for p in range(len(w) - 11):
            seen[tuple(w[p : p + 12])].add(r)
    want = [(i, any(len(seen[tuple(w[p : p + 12])]) > 1 for p in range(len(w) - 11))) for (i, _), w in zip(corpus(), words, strict=True)]
    got = suffix_dedup.suffix_dedup(docs, passage_words=12)
    assert by_row(got, "doc_id", "repeats") == sorted(want, key=str)
    assert suffix_dedup.suffix_dedup(empty, passage_words=51).columns[-1] == "repeats"


# op5 ---------------------------------------------------------------------------------------


def test_quality_rules(docs, empty, spark):
    got = quality_rules.quality_rules(docs)
    want = []
    for i, t in corpus():
        t = t or ""
        w = WORDS.findall(t)
        n = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {j + o for j in range(len(w) - 7) if n[tuple(w[j : j + 8])] > 1 for o in range(8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert got.where("base_failed and kept").count() == 0 and got.where("kept").count() > 20
    assert quality_rules.quality_rules(empty).count() == 0
    bad = spark.createDataFrame([(1, "### " * 3 + "word " * 40 + " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"W{i}A" for i in range(40))), (3, "\n".join(["one two three four five six seven"] + [f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(9)]))], "doc_id long, text string")
    assert {r.doc_id: r.rejected_by for r in quality_rules.quality_rules(bad).collect()} == {1: "base", 2: "upper_case", 3: None}


def test_rule_order_changes_no_verdict(docs):
    rules = quality_rules.RULES
    a = by_row(quality_rules.quality_rules(docs, rules=rules), "doc_id", "kept")
    assert a == by_row(quality_rules.quality_rules(docs, rules=dict(reversed(rules.items()))), "doc_id", "kept")


def test_rule_order_goes_by_rejection_per_step(spark, docs):
    rules = {"long": lambda: F.col("n_words") > 50, "same": lambda: F.col("n_words") > 50, "never": lambda: F.lit(False), "more": lambda: F.col("n_words") > 40}
    order = lambda rows, n: quality_rules.cascade_order(docs, "doc_id", "text", rules, rows, n)
    assert order(500, {}) == ["more", "long", "same", "never"]
    assert order(500, {"more": lambda: F.lit(1000)}) == ["long", "same", "more", "never"]
    assert order(500, {"long": lambda: F.lit(3)}) == ["more", "same", "long", "never"]
    assert quality_rules.cascade_order(docs.repartition(7), "doc_id", "text", rules, 9, {}) == quality_rules.cascade_order(docs.coalesce(1), "doc_id", "text", rules, 9, {})
    assert quality_rules.cascade_order(docs.where("false"), "doc_id", "text", rules, 9, {}) == list(rules)
    with_reason = lambda d: by_row(quality_rules.quality_rules(d), "doc_id", "rejected_by")
    assert with_reason(docs.repartition(6)) == with_reason(docs.coalesce(2))


# op6 ---------------------------------------------------------------------------------------


def test_decontaminate(spark, docs, empty):
    rows = corpus()
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: split.findall((t or "").translate(LOWER))
    items = [(3, " ".join((rows[1][1] or "").split()[8:30])), (10, rows[4][1]), (2, "one"), (7, None), (8, ""), (5, "w1 w2"), (11, rows[1][1]), (10, rows[4][1])]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, f int")
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(10, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    got = dc.decontaminate(docs, bench)
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == sorted(want, key=str)
    assert sum(x[5] for x in want) > 3
    assert dc.decontaminate(empty, bench).count() == 0
    assert dc.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontaminate_by_items_without_id(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "short one z"), (3, f"{passage} q r s"), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "short one"), (5, "r s")], "item_id long, text string")
    got = dc.decontaminate(docs, bench)
    want = [(1, 14, 12, 0, [], True), (2, 3, 2, 0, [], True), (3, 15, 14, 1, ["5"], True), (4, 1, 0, 0, [], False)]
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == want


# op7 ---------------------------------------------------------------------------------------


def test_packing(docs, empty):
    tok = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")).tok
    for most in (2048, 16):
        got = packing.pack(docs, max_length=most).collect()
        assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & r.length - 1 == 0 and r.length <= most for r in got)
        want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in corpus())
        # Pieces of a row follow each other, so a row starts where start is 0.
        made, parts = collections.Counter(), []
        for r in [*got, None]:
            if parts and (r is None or r.start == 0):
                assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1]) and sum(p.length for p in parts) == parts[0].doc_tokens
                made[parts[0].doc_id, tuple(np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist())] += 1
                parts = []
            parts.append(r)
        assert made == want
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, max_length=1000)


# op8 ---------------------------------------------------------------------------------------


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality_model.fit_trees(x[:1000], y[:1000])
    p = m.score(x[1000:])
    assert ((p > 0.5) == y[1000:]).mean() > 0.93 and p.min() >= 0 and p.max() <= 1
    flat = []
    for row in m.binned(x[:20]):  # row by row, as a plain walk
        total = m.base
        for f, t, leaf in zip(m.feature, m.bin, m.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        flat.append(1 / (1 + np.exp(-total)))
    assert np.allclose(m.score(x[:20]), flat)
    assert quality_model.fit_trees(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert len(set(quality_model.fit_trees(x[:9], np.ones(9)).score(x[:5]))) == 1


def plain_features(t):
    raw = (t or "").encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    if not words:
        return [0.0] * len(quality_model.FEATURES)
    n, size = len(words), len(raw)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    lines, triples = [x for x in raw.split(b"\n") if x], [tuple(words[i : i + 3]) for i in range(n - 2)]
    return [
        np.log1p(size), np.log1p(n), sum(map(len, words)) / n, max(map(len, words)), count(b"#*$%&|<>") / n, count(b"|") / n, count(b"!?") / n,
        count(b".") / n, count(b",") / n, count(range(65, 91)) / size, count(range(48, 58)) / size, count(range(128, 256)) / size,
        count(b" \t\n\x0b\x0c\r") / size, n / (count(b"\n") + 1), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / n,
        len(set(triples)) / max(1, len(triples)), max(collections.Counter(words).values()) / n]


def test_features_against_plain_ones():
    texts = [t for _, t in corpus()] + ["A b!? 12\n\nA b!? 12\nÜ|#", "x", "a b", "x y x y x y", "\n\n . , \t", "w " * 9000]
    assert np.allclose(quality_model.features(texts), [plain_features(t) for t in texts])


def test_trees_against_plain_boosting():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    x[:, 2] = x[:, 0]  # gains tie
    y = ((x[:, 0] + x[:, 1] + rng.integers(0, 4, 80)) > 6).astype(float)
    m = quality_model.fit_trees(x, y, trees=3, depth=2)
    b, total = m.binned(x), np.full(80, m.base)
    for tree in range(3):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(80, int)
        for at in range(3):
            rows = np.flatnonzero(node == at)
            part = lambda k: g[k].sum() ** 2 / (h[k].sum() + quality_model.L2)
            best, choice = 1e-9, (0, quality_model.BINS)
            for f in range(3):
                for t in range(quality_model.BINS):
                    left, right = rows[b[rows, f] <= t], rows[b[rows, f] > t]
                    gain = part(left) + part(right) - part(rows)
                    if gain > best + 1e-12:
                        best, choice = gain, (f, t)
            assert (m.feature[tree, at], m.bin[tree, at]) == choice
            node[rows] = 2 * at + 1 + (b[rows, choice[0]] > choice[1])
        leaf = np.array([-quality_model.RATE * g[node == k].sum() / (h[node == k].sum() + quality_model.L2) for k in range(3, 7)])
        assert np.allclose(m.leaf[tree], leaf)
        total += leaf[node - 3]


def test_quality_model_of_repeats(spark):
    """Repeated labels and ids, both labels of an id, a long text and clashing names."""
    rows = [(i, " ".join(["good words here."] * (i % 7 + 1)) if i % 2 else "|| ## " * (i % 5 + 1), "a", 7) for i in range(40)]
    rows += [(1, "zzz", "a", 7)] * 30 + [(None, "x", None, None), (90, "long " * 50_000, "a", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string, score int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3 + [(3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    model = quality_model.fit(d, labels)
    once = spark.createDataFrame([r for r in rows[:40]] + rows[-1:], d.schema)
    other = quality_model.fit(once, labels.distinct())
    assert (model.leaf == other.leaf).all() and (model.edges == other.edges).all()
    got = quality_model.score(d, model).collect()
    assert len(got) == len(rows) and sum((r.score > 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40) >= 38
    assert len({r.score for r in got if r.doc_id == 1}) <= 2


def test_quality_model(spark, docs, empty):
    labels = docs.select("doc_id", (F.length("text") > 100).cast("int").alias("quality"))
    model = quality_model.fit(docs, labels)
    got = quality_model.score(docs, model).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(empty, model).count() == 0
    nothing = quality_model.fit(docs, labels.where("false"))
    assert {r.score for r in quality_model.score(docs, nothing).collect()} == {0.5}
    assert quality_model.features([None, "", " \n"]).tolist() == [[0.0] * len(quality_model.FEATURES)] * 3


# op9 ---------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    vocab = {"a": 0, "b": 1, "ab": 2, "aba": 3}
    p = np.array([[0.3, 0.1], [0.2, 0.1], [0.2, 0.4], [0.2, 0.3], [0.1, 0.1]])

    def brute(word, lang):
        if not word:
            return 1.0
        total = sum(p[vocab[word[:n]], lang] * brute(word[n:], lang) for n in range(1, len(word) + 1) if word[:n] in vocab)
        return total + (p[-1, lang] * brute(word[1:], lang) if word[0] not in vocab else 0)

    words = ["abab", "abba", "xa", "aaba", "b"]
    assert np.allclose(language.word_scores(words, p, vocab), np.log([[brute(w, k) for k in (0, 1)] for w in words]))


def test_training_counts_all_segmentations():
    vocab, unknown = {"a": 0, "b": 1, "ab": 2, "aba": 3}, 4
    counts = {"x": {"abab": 3, "ba": 1, "qa": 2}, "y": {"aab": 5}}

    def segmentations(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in vocab or n == 1:
                for rest in segmentations(w[n:]):
                    yield [vocab.get(w[:n], unknown), *rest]

    table = np.full((5, 2), 0.2)
    for _ in range(3):
        new = np.full((5, 2), language.SMOOTH)
        for k, lang in enumerate("xy"):
            for w, n in counts[lang].items():
                every = [(s, np.prod(table[s, k])) for s in segmentations(w)]
                for s, p in every:
                    for piece in s:
                        new[piece, k] += n * p / sum(q for _, q in every)
        table = new / new.sum(0)
    langs, got = language.train(counts, vocab, rounds=3)
    assert langs == ["x", "y"] and np.allclose(got, table)


def test_language_totals(spark, monkeypatch):
    """Scores of whole texts: mean log-likelihoods of words, ties to the first
    language, long and repeated texts, clashing names."""
    vocab = {"a": 0, "b": 1}
    monkeypatch.setattr(language, "vocabulary", lambda path: vocab)
    table = np.array([[0.6, 0.2], [0.2, 0.6], [0.2, 0.2]])
    rows = [(1, "a b aab"), (2, "B b! 7 ab"), (2, "B b! 7 ab"), (None, "ab"), (3, "c"), (4, "a " * 30_000 + "b" * 95), (5, " 12 ")]
    d = spark.createDataFrame([(*r, "z", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double").coalesce(1)
    p = {"a": table[0], "b": table[1], "c": table[2]}
    want = []
    for i, t in rows:
        words = [x for w in re.findall("[a-z]+", t.lower()) for x in (w[k : k + 40] for k in range(0, len(w), 40))]
        mean = np.mean([np.sum([np.log(p[c]) for c in w], 0) for w in words], 0) if words else None
        share = np.exp(mean) / np.exp(mean).sum() if words else [0.0]
        want.append((i, ["en", "fr"][int(np.argmax(mean))] if words else "und", pytest.approx(max(share))))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(d, (["en", "fr"], table)).collect()]
    assert got == want


def test_language(spark, docs, empty):
    rng = random.Random(5)
    own = {"en": "the of and to ing tion with that".split(), "de": "der und nicht keit schaft ung ein über".split()}
    rows = [(i, " ".join("".join(rng.choices(own[lang], k=rng.randint(1, 2))) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 60)]
    d = spark.createDataFrame([*rows, (200, None, "en"), (201, "12 !?", "de"), (202, "the", None)], "doc_id long, text string, lang string")
    model = language.fit(d.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in language.predict(d, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 119
    assert got[200].lang_pred == got[201].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(d, language.fit(d.where("false"))).collect()} == {"und"}
    assert language.predict(d, model, keep_row=True).select("row.*").columns == ["doc_id", "text", "lang"]


def test_language_learns_from_distinct_texts(spark, monkeypatch):
    """A text of many copies neither fills a language's sample nor takes another language's place."""
    learnt = {}
    monkeypatch.setattr(language, "train", lambda counts, vocab: learnt.update(counts))
    texts = [(f"alpha{chr(97 + i)}", "en") for i in range(4)] + [("beta", "de"), ("gamma", "fr")]
    rows = [("copied", "en")] * 3000 + texts
    language.fit(spark.createDataFrame(rows, "text string, lang string").coalesce(1), sample=50)
    assert learnt == {lang: {t: 1 for t, x in rows if x == lang} for lang in ("en", "de", "fr")}


# op10 --------------------------------------------------------------------------------------


def brute_lines(rows, min_words, near_words):
    lines, kept = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = []
        for line in (t or "").split("\n"):
            w = tuple(WORDS.findall(line.translate(LOWER)))
            near = lambda v: v == w or min(len(v), len(w)) >= near_words and line_dedup.within_one(np.array(v, object), np.array(w, object))  # noqa: B023, E731
            own.append(len(w) < min_words or not any(near(v) for v in lines if abs(len(v) - len(w)) < 2))
            if len(w) >= min_words:
                lines.append(w)
        kept[i] = "\n".join(x for x, s in zip((t or "").split("\n"), own, strict=True) if s)
    return kept


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    rows, made = [], []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choices([f"w{j}" for j in range(40)], k=rng.choice([1, 4, 6, 7, 8, 9, 12]))
            if made and rng.random() < 0.6:
                w = list(rng.choice(made))
                p = rng.randrange(len(w))
                w = rng.choice([w, w[:p] + w[p + 1 :], w[:p] + ["z"] + w[p:], w[:p] + ["Q"] + w[p + 1 :], [x.upper() for x in w]])
            made.append(w)
            lines.append("  ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n\n")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int").repartition(4)
    got = {r["row"].doc_id: r for r in line_dedup.line_dedup(d).collect()}
    want = brute_lines(rows, line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS)
    assert {i: r.text or "" for i, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 30 and got[70].text is None and got[72].n_lines == 3
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_compares_short_lines(spark):
    rows = [(1, "les.\nand ornd.\none two three four five\n-\n\n\n"), (2, "LES.\nand  ornd.\nand orn.\n-"), (3, "les.\none two three four six\none two three four\none two three four five six\nnew")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"].doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(d).collect()}
    assert got == {1: (rows[0][1], 7, 0), 2: ("and orn.", 4, 3), 3: ("one two three four\nnew", 5, 3)}
    # A higher floor stays an option.
    assert sum(r.n_removed for r in line_dedup.line_dedup(d, min_words=5, near_words=8).collect()) == 0


@pytest.mark.parametrize("near_words", [2, 5, 30])
def test_line_dedup_of_long_lines(spark, near_words):
    rng = random.Random(near_words)
    rows = []
    for i in range(70):
        w = [f"w{rng.randrange(3 if i % 7 == 0 else 500)}" for _ in range(i + 1)]
        lines = [w]
        for p in {0, i, i // 2, rng.randrange(i + 1), max(i // 2 - 1, 0)}:
            lines += [w[:p] + w[p + 1 :], w[:p] + [f"x{p}"] + w[p + 1 :], w[:p] + [f"y{p}"] + w[p:]]
        rng.shuffle(lines)
        rows += [(3 * i + k, "\n".join(" ".join(x) for x in lines[k::3])) for k in range(3)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["row"].doc_id: r.text for r in line_dedup.line_dedup(d, near_words=near_words).collect()}
    assert got == brute_lines(rows, 1, near_words)


def test_line_dedup_makes_few_variants_and_carries_a_text_once(spark, monkeypatch, tmp_path):
    """Lines that share their first words emit no deletions among these, only
    variants of several lines are compared, and the last join has the columns
    that are asked for, each once."""
    seen, written = {}, line_dedup.written

    def noting(df, name):
        out = written(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", noting)
    words = lambda i: [f"w{i}x{j}" for j in range(39)]
    rows = [(2 * i + k, " ".join([*words(i), end]), "xx") for i in range(20) for k, end in enumerate(("one", "two"))]
    rows += [(100 + i, " ".join([*words(100 + i), "three"]), "xx") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, tongue string").write.parquet(str(tmp_path / "d"))
    out = line_dedup.line_dedup(spark.read.parquet(str(tmp_path / "d")))
    assert seen["variants"] <= 40 * 28 and seen["meeting"] == 40
    assert {r["row"].doc_id for r in out.where("n_removed = 1").collect()} == set(range(1, 40, 2))
    plan = out.select("row.doc_id", "text", "n_removed")._jdf.queryExecution().optimizedPlan().toString()
    assert "tongue" not in plan.split("Relation")[0] and plan.count("ArrowEvalPython") == 1
    # A predicate on what is found is no second call.
    plan = out.where("n_removed = 0 or text rlike 'a'").select("row.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("x", "y", "near"), [("abc", "abc", True), ("abc", "ac", True), ("abc", "abxc", True), ("abc", "abd", True), ("abcd", "acbd", False), ("ab", "abcd", False), ("aab", "ab", True)])
def test_within_one(x, y, near):
    assert line_dedup.within_one(np.array(list(x)), np.array(list(y))) is near


def test_shingle_sets():
    a = texthash.shingle_sets(["A b c d e", "a  b\nc d e", "x", "", None], 4)
    assert [len(x) for x in a] == [2, 2, 1, 0, 0] and (a[0] == a[1]).all()


# pipeline ----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    vocab = {"en": "the of and with that tion ing".split(), "de": "der und nicht keit ung ein".split()}
    text = lambda lang, k: " ".join("".join(rng.choices(vocab[lang], k=3)) for _ in range(k))
    rows = [(i, text("en" if i % 2 else "de", 60), "en" if i % 2 else "de", "s", 0) for i in range(30)]
    item = text("en", 20)
    rows += [(40, None, None, "s", 0), (41, "1 2 3", None, "s", 0), (42, rows[0][1], "de", "s", 0), (43, text("en", 30) + " " + item, "en", "s", 0)]
    near = rows[2][1].split(" ")
    near[30:32] = ["undein", "dereinung"]
    rows += [(44, " ".join(near), "de", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = []
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        d = spark.read.parquet(str(tmp_path / f"s{k}"))
        left.append({r.doc_id for r in d.select("doc_id").collect()})
    whole = {r[0] for r in rows}
    assert left == [whole - {40, 41}, whole - {40, 41, 42}, whole - {40, 41, 42, 44}, whole - {40, 41, 42, 43, 44}]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left[-1]


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    """Null and repeated ids: of linked rows exactly one stays, and exactly the contaminated rows go."""
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda k: " ".join(f"w{rng.randrange(4000)}" for _ in range(k))
    copied, near, alone, item, other = text(60), text(60), text(60), text(20), text(60)
    close = near.split(" ")
    close[30] = "new"
    rows = [(1, copied), (1, copied), (1, copied), (None, near), (7, " ".join(close)), (None, alone), (None, alone), (2, other), (2, text(30) + " " + item)]
    rows += [(None, text(30) + " " + item), (None, text(60)), (3, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    once = collections.Counter(rows) - collections.Counter([rows[0], rows[0], (None, near), (None, alone)])
    got = corpus_pipeline.near_copy_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and left(got) == once
    got = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and left(got) == collections.Counter(rows) - collections.Counter([rows[8], rows[9]])


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null texts and ids, and clashing names at every stage."""
    import corpus_pipeline

    rng = random.Random(21)
    text = lambda k: " ".join(rng.choice("the of and with that tion ing".split()) + rng.choice("ab cd ef".split()) for _ in range(k))
    rows = [(i, text(40), "en", "s", 0, "x", 1, 2, 3, True) for i in range(12)] + [(None, None, None, None, None, None, None, None, None, None)] * 2
    rows += [(5, "", "en", "s", 0, "x", 1, 2, 3, False), (None, text(3000), "en", "s", 0, "x", 1, 2, 3, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, node long, row int, label int, contaminated boolean"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    none = spark.createDataFrame([], "item_id long, text string")
    none.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.agg(F.count_distinct("doc_id")).first()[0] == 12
            continue
        assert out.columns == docs.columns
        got = collections.Counter(tuple(r) for r in out.collect())
        gone = {"language": 3, "lines": 0, "near_copies": 0, "benchmark": 0}[name]
        assert sum(got.values()) == len(rows) - gone
        assert got - collections.Counter(rows) == collections.Counter()


def test_pipeline_against_a_recount(spark, tmp_path):
    """Lines, near copies and benchmark of some documents, stage by stage, against plain sets."""
    import corpus_pipeline

    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    lines = [text(9) for _ in range(6)]
    items = [(i, text(15)) for i in range(3)]
    rows = []
    for i in range(50):
        t = text(rng.randint(10, 60))
        if i % 6 == 1:
            t += "\n" + rng.choice(lines)
        if i % 7 == 2:
            t += " " + rng.choice(items)[1]
        if i % 5 == 4 and rows:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = lambda x: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in x], "doc_id long, text string, lang string, source string, n_chars long")
    read = lambda d: sorted((r.doc_id, r.text) for r in d.collect())
    kept = brute_lines(rows, line_dedup.MIN_WORDS, line_dedup.NEAR_WORDS)
    left = [(i, t) for i, t in sorted(kept.items()) if t.strip()]
    got = corpus_pipeline.line_stage(spark, frame(rows), str(tmp_path))
    assert read(got) == left and all(r.n_chars == len(r.text) for r in got.collect())
    least = {i: c for i, _, c in brute_components(rows, 5, 80, 100)}
    assert read(corpus_pipeline.near_copy_stage(spark, frame(rows), str(tmp_path))) == [(i, t) for i, t in rows if least[i] == i] != rows
    cut = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t.lower())
    grams = {tuple(w[p : p + 10]) for _, t in items for w in [cut(t)] for p in range(len(w) - 9)}
    clean = [(i, t) for i, t in rows if not any(tuple(cut(t)[p : p + 10]) in grams for p in range(len(cut(t)) - 9))]
    assert read(corpus_pipeline.benchmark_stage(spark, frame(rows), str(tmp_path))) == clean != rows
