"""Stateful streams, nested definitions, listings, quantiles, intervals in one pass, and the English form."""

import http.server
import itertools
import json
import math
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions.english import normalize_english
from pairlens.operators import definitions, quantiles, resample
from pairlens.plans import reports, verdicts
from pairlens.sources import listing, provenance, readers, writers
from pairlens.streaming import states

# streams -----------------------------------------------------------------------------------

CALL = "batch long, pos long, rows int, temperature double, needs boolean, at timestamp"


def calls_of(batch, plan, second, drop_last=False):
    """Calls of a batch from how many more temperatures each row needs."""
    levels, out = (0.0, 0.2, 0.4), []
    for k, t in enumerate(levels):
        if not drop_last or k < 2:
            out += [(t, n > k) for n in plan if n >= k]
    return [(batch, p, len(plan), t, needs, f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}") for p, (t, needs) in enumerate(out)]


def put(spark, rows, path):
    d = spark.createDataFrame(rows, CALL.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at"))
    d.coalesce(1).write.mode("append").parquet(path)


def test_retry_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(4)
    plans = {b: [rng.choice([0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 12))] for b in range(12)}
    plans[11] = [2, 0]
    rows = [c for b, p in plans.items() for c in calls_of(b, p, 10 * b, drop_last=b == 2)]
    want = {(b, r): (min(n, 2) * 0.2, n > 2, False) for b, p in plans.items() for r, n in enumerate(p)}
    plans2, waiting = plans[2], max(plans[2]) >= 2
    for r, n in enumerate(plans2):
        if waiting:
            want[2, r] = (min(n, 1) * 0.2, n > 1, True)
    got = {}
    for kind, cuts in {"at once": [rows], "in two": [rows[::2], rows[1::2]], "in many": [rows[k::3] for k in range(3)]}.items():
        path = str(tmp_path / kind.replace(" ", "-"))
        for part in [*cuts, calls_of(90, [0], 3000), calls_of(91, [0], 3100)]:
            put(spark, part, f"{path}/in")
            # Each part is a run of its own, that is stopped and goes on from its checkpoint.
            stream = states.retry_stream(spark.readStream.schema(CALL).parquet(f"{path}/in"), (0.0, 0.2, 0.4), 300_000, "600 seconds")
            out = states.drained(stream, f"{path}/checkpoint", f"{path}/out")
        found = [r for r in out.collect() if r.batch < 90]
        got[kind] = {(r.batch, r.row): (round(r.temperature, 1), r.exhausted, r.expired) for r in found}
        assert len(found) == len(got[kind])  # nothing twice
    assert all(x == {k: (round(t, 1), e, p) for k, (t, e, p) in want.items()} for x in got.values())
    assert waiting


def test_walk():
    assert states.walk([], 2, 0.4) == ([(0.0, False)] * 2, False)
    assert states.walk([(0.0, True), (0.0, False)], 2, 0.4) == ([(0.0, True), (0.0, False)], False)
    assert states.walk([(0.0, True), (0.0, False), (0.4, True)], 2, 0.4) == ([(0.4, True), (0.0, False)], True)
    for wrong in ([(0.0, False), (0.2, False)], [(0.0, False), (0.0, False), (0.2, False)], [(0.0, True), (0.0, False), (0.8, True)]):
        with pytest.raises(ValueError):
            states.walk(wrong, 2, 0.4)


def test_last_line_stream(spark, tmp_path):
    rng = random.Random(2)
    lines = [(rng.randrange(20), k, rng.random(), None if k % 7 else "x") for k in range(200)]
    rng.shuffle(lines)
    path = str(tmp_path)
    for part in (lines[:90], lines[90:120], lines[120:]):
        spark.createDataFrame(part, "step long, seen long, loss double, note string").coalesce(2).write.mode("append").parquet(f"{path}/in")
        stream = states.last_line_stream(spark.readStream.schema("step long, seen long, loss double, note string").parquet(f"{path}/in"))
        out = states.drained(stream, f"{path}/checkpoint", f"{path}/out", "update")
    last = {}
    for r in out.orderBy("step", "seen").collect():
        last[r.step] = (r.step, r.seen, r.loss, r.note)
    assert sorted(last.values()) == sorted({s: max(x for x in lines if x[0] == s) and max((x for x in lines if x[0] == s), key=lambda x: x[1]) for s in {x[0] for x in lines}}.values())


def test_steps_are_forgotten(spark, tmp_path):
    kind = "step long, seen long, loss double"
    put_lines = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put_lines([(1, 5, 0.5)])
    got = []
    stream = states.last_line_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ttl_ms=500)
    run = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda b, _: got.extend(r.seen for r in b.collect())).start()
    try:
        end = time.time() + 60
        while not got and time.time() < end:
            time.sleep(0.2)
        time.sleep(1.5)
        put_lines([(1, 3, 0.7)])  # an older line, but nothing is known of the step any more
        while len(got) < 2 and time.time() < end:
            time.sleep(0.2)
    finally:
        run.stop()
    assert got == [5, 3]


# definitions -------------------------------------------------------------------------------


def flat(x, path="", shape="", sets=()):
    """Leaves of a parsed document, plainly."""
    if isinstance(x, dict) and x:
        return {k: v for n, y in x.items() for k, v in flat(y, f"{path}.{n}", f"{shape}.{n}", sets).items()}
    if isinstance(x, list) and x:
        name = lambda i, y: json.dumps(y, ensure_ascii=False) if shape in sets else str(i)
        o, c = "{}" if shape in sets else "[]"
        return {k: v for i, y in enumerate(x) for k, v in flat(y, f"{path}{o}{name(i, y)}{c}", f"{shape}[]", sets).items()}
    return {path: json.dumps(int(x) if isinstance(x, float) and x == int(x) else x, ensure_ascii=False)}


def test_definitions(spark):
    rng = random.Random(9)

    def made(depth):
        k = rng.random()
        if depth == 0 or k < 0.3:
            return rng.choice([1, 2.5, True, False, None, "a", "é\"x", "", 3, 12345678901])
        if k < 0.7:
            return {rng.choice("abcd"): made(depth - 1) for _ in range(rng.randint(0, 4))}
        return [made(depth - 1) for _ in range(rng.randint(0, 4))]

    docs = [{"top": made(5), "ids": [rng.randint(0, 5) for _ in range(4)], "n": i} for i in range(30)]
    def other(x):
        if isinstance(x, dict):
            items = [*x.items()]
            rng.shuffle(items)
            return {k: other(v) for k, v in items}
        return [other(v) for v in x] if isinstance(x, list) else float(x) if type(x) is int and rng.random() < 0.5 else x

    rows = [(i, json.dumps(d), json.dumps({**other(d), "ids": rng.sample(d["ids"], 4)})) for i, d in enumerate(docs)]
    d = spark.createDataFrame([*rows, (90, None, None), (91, "no json", "no json")], "id int, a string, b string")
    a, b = d.select("id", F.col("a").alias("json")), d.select("id", F.col("b").alias("json"))
    got = {}
    for r in definitions.leaves(a, "json", ["id"], [".ids"]).collect():
        got.setdefault(r.id, {})[r.path] = r.value
    assert got.pop(91) == {"": "invalid"} and got == {i: flat(x, sets=(".ids",)) for i, x in enumerate(docs)}
    assert definitions.diff(a, b, "json", ["id"], [".ids"]).count() == 0
    definitions.require_equal(a, b, "json", ["id"], [".ids"])
    both = definitions.canonical(a, "json", ["id"], [".ids"]).union(definitions.canonical(b, "json", ["id"], [".ids"]))
    assert both.groupBy("id").agg(F.count_distinct("digest").alias("n")).agg(F.max("n")).first()[0] == 1
    changed = spark.createDataFrame([(0, json.dumps({**docs[0], "n": 77, "new": {"x": []}}))], "id int, json string")
    found = sorted((r.path, r.before, r.after) for r in definitions.diff(a.where("id = 0"), changed, "json", ["id"], [".ids"]).collect())
    assert found == [(".n", "0", "77"), (".new.x", None, "[]")]
    with pytest.raises(ValueError, match=r"\(n, new\)"):
        definitions.require_equal(a.where("id = 0"), changed, "json", ["id"], [".ids"])


def test_sets_of_nested_elements(spark):
    rows = [('{"s":[{"b":1.0,"a":[1,2]},{"a":[]}]}', '{"s":[{"a":[]},{"a":[1,2.0],"b":1},{"a":[]}]}', 0), ('{"s":[{"b":1}]}', '{"s":[{"b":2}]}', 2)]
    for x, y, n in rows:
        a, b = (spark.createDataFrame([(1, v)], "id int, json string") for v in (x, y))
        assert definitions.diff(a, b, "json", ["id"], [".s"]).count() == n


# HTTP --------------------------------------------------------------------------------------


class Server(http.server.BaseHTTPRequestHandler):
    files = {f"/f{k}.bin": bytes([k]) * (10_000 * k) for k in range(4)}
    failures: dict = {}
    asked: list = []
    lock = threading.Lock()

    def log_message(self, *_):
        pass

    def answer(self, body, **headers):
        with self.lock:
            self.asked.append((self.command, self.path))
            left = self.failures.get(self.path, [])
            how = left.pop(0) if left and self.command == "GET" else None
        if isinstance(how, int):
            self.send_error(how)
            return
        start = int(self.headers["Range"][6:-1]) if "Range" in self.headers and how != "no ranges" else 0
        part = body[start:]
        self.send_response(206 if start else 200)
        self.send_header("Content-Length", str(len(part)))
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(part[: len(part) // 2] if how == "short" else part)

    def do_GET(self):
        if self.path.startswith("/list/"):
            k = int(self.path[6:])
            entries = [{"type": "file", "path": f"p{k}/{j}.parquet", "size": 100 * k + j, "oid": f"git{j}", "lfs": {"oid": f"sha{k}{j}"}} for j in range(3)] + [{"type": "directory", "path": f"p{k}", "size": 0, "oid": "d"}]
            self.answer(json.dumps(entries).encode(), **({"Link": f'<http://{self.headers["Host"]}/list/{k + 1}>; rel="next"'} if k < 4 else {}))
        elif self.path in self.files:
            self.answer(self.files[self.path])
        else:
            self.send_error(404)

    do_HEAD = do_GET


@pytest.fixture
def server():
    Server.failures, Server.asked = {}, []
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_listing(spark, server):
    Server.failures = {"/list/1": [503, "short"], "/list/3": [500]}
    want = [(k, j, f"p{k}/{j}.parquet", "file", 100 * k + j, f"sha{k}{j}") for k in range(5) for j in range(3)] + [(k, 3, f"p{k}", "directory", 0, "d") for k in range(5)]
    for pages in (5, None):
        d = listing.read_listing(spark, f"{server}/list/{{page}}" if pages else f"{server}/list/0", pages, wait="0.01")
        assert d.rdd.getNumPartitions() == 5  # a task a page
        assert sorted(map(tuple, d.collect())) == sorted(want)
    Server.failures = {"/list/2": ["short"] * 9}
    with pytest.raises(Exception, match="IncompleteRead|ShortBody"):
        listing.read_listing(spark, f"{server}/list/{{page}}", 5, wait="0.01", tries="3").collect()
    before = len(Server.asked)
    with pytest.raises(Exception, match="404"):
        listing.read_listing(spark, f"{server}/none/{{page}}", 1, wait="0.01").collect()
    assert len(Server.asked) == before  # what can't pass isn't tried again by the source


def test_files(spark, server, monkeypatch):
    Server.failures = {"/f3.bin": ["short", "no ranges", 502], "/f2.bin": ["short"], "/f1.bin": [429]}
    urls = [f"{server}{n}" for n in Server.files]
    d = listing.read_files(spark, urls, wait="0.01")
    assert d.rdd.getNumPartitions() == 4
    got = {}
    for r in sorted(d.collect(), key=lambda r: (r.url, r.number)):
        assert r.offset == len(got.get(r.url, b""))
        got[r.url] = got.get(r.url, b"") + bytes(r.content)
    assert got == {f"{server}{n}": x for n, x in Server.files.items() if x}
    assert {r.url: r.bytes for r in listing.remote_sizes(spark, urls).collect()} == {f"{server}{n}": len(x) for n, x in Server.files.items()}
    Server.failures = {"/f2.bin": ["short"] * 99}
    with pytest.raises(Exception, match="IncompleteRead|ShortBody"):
        listing.read_files(spark, urls[2:3], wait="0.01", tries="2").collect()


def test_proven_revision(spark):
    entries = [(f, f"{k}.parquet", f"h{f}{k}", "file") for f in "abcd" for k in range(3)] + [("a", "readme", "z", "file"), ("a", "x.parquet", "z", "directory")]
    local = [(f, k, f"h{f}{k}") for f in "abce" for k in range(3) if (f, k) != ("c", 2)]
    local[4] = ("b", 1, "other")
    out = listing.proven_revision(
        spark.createDataFrame(entries, "folder string, path string, digest string, kind string"), spark.createDataFrame(local, "folder string, place int, digest string"),
        spark.createDataFrame([(f, f"r{f}") for f in "abcdef"], "folder string, revision string"))
    got = {r.folder: (r.revision, r.remote, r.local) for r in out.collect()}
    assert got == {"a": ("ra", 3, 3), "b": (None, 3, 3), "c": (None, 3, 2), "d": (None, 3, 0), "e": (None, 0, 3), "f": (None, 0, 0)}


# quantiles and intervals -------------------------------------------------------------------


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    groups = np.where(rng.random(n) < 0.6, "hot", np.where(rng.random(n) < 0.5, "few", "none"))
    values = np.where(groups == "few", rng.integers(0, 3, n) * 1.0, rng.lognormal(0, 4, n))
    rows = [(None if g == "none" else g, float(v)) for g, v in zip(groups, values, strict=True)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("nan", float("nan")), ("null", None), ("two", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(6)
    at = [0, 0.025, 0.5, 0.9, 1]
    got = {(r.g, r.quantile): r.result for r in quantiles.quantiles(d, "v", ["g"], at, most_rows=200).collect()}
    own = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            own.setdefault(g, []).append(v)
    assert set(got) == {(g, float(q)) for g in own for q in at}
    assert all(got[g, float(q)] == pytest.approx(np.quantile(v, q), rel=1e-12) for g, v in own.items() for q in at)
    whole = quantiles.wide_quantiles(d, "v", [], {"m": 0.5}, most_rows=300).first()
    assert whole.m == pytest.approx(np.quantile([v for x in own.values() for v in x], 0.5))
    assert quantiles.quantiles(d.where("false"), "v", ["g"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles.quantiles(d, "v", [], [1.2])


def test_one_pass_intervals(spark):
    rng = np.random.default_rng(5)
    rows = [(f"u{i:04d}", f"b{i % 37}", int(rng.integers(0, 5)), int(rng.integers(0, 5)), int(rng.integers(5, 20))) for i in range(900)]
    d = spark.createDataFrame(rows, "id string, block string, edits_a long, edits_b long, length long")
    sums = lambda x, unit: {r.rep: (r.edits_a, r.length) for r in resample.resampled_sums(x, ["edits_a", "length"], unit, samples=60, mode="poisson").collect()}
    one = sums(d, "id")
    assert one == sums(d.repartition(7), "id") and len(one) == 60
    by_block = d.groupBy("block").agg(*[F.sum(c).alias(c) for c in ("edits_a", "length")])
    assert sums(d, "block") == sums(by_block, "block")  # rows of a block weigh alike
    plan = resample.resampled_sums(d, ["edits_a"], "id", samples=60, mode="poisson")._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
    w = resample.poisson_weights(np.arange(3000), np.arange(3000)[::-1] * 7, 400, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2
    low, high = resample.difference_interval(d, "id", samples=400, mode="poisson").first()
    exact = resample.difference_interval(d, "id", samples=400, mode="parity").first()
    assert abs(low - exact.low) < 0.006 and abs(high - exact.high) < 0.006
    assert sums(d.where("false"), "id") == {}


# the English form --------------------------------------------------------------------------

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "x x twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell(n, with_and=False):
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (" " + _ONES[n % 10] if n % 10 else "")
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            rest = n % size
            link = " and " if with_and and rest and rest < 100 else " "
            return f"{spell(n // size, with_and)} {name}" + (link + spell(rest, with_and) if rest else "")


def ordinal(n):
    head, _, last = spell(n).rpartition(" ")
    odd = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
    last = odd.get(last, last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return f"{head} {last}".strip()


def test_numbers_are_read_as_they_are_spelled():
    rng = random.Random(3)
    numbers = [*range(0, 1200), *(rng.randrange(10 ** rng.randint(3, 15)) for _ in range(3000))]
    for n, link in itertools.product(numbers, (False, True)):
        assert normalize_english(f"About {spell(n, link)}, he said.") == f"about {n} he said"
    for n in numbers[1:]:
        end = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
        if n != 2 and n > 0:
            assert normalize_english(f"the {ordinal(n)} of them") == f"the {n}{end} of them"
    for n in numbers[1:600]:
        cents = rng.randrange(1, 100)
        assert normalize_english(f"{spell(n)} dollars") == f"${n}" == normalize_english(f"{n} dollars")
        assert normalize_english(f"{spell(n)} pounds and more") == f"£{n} and more"
        assert normalize_english(f"{spell(n)} percent") == f"{n}%" == normalize_english(f"{n} per cent")
        assert normalize_english(f"{spell(n)} dollars and {spell(cents)} cents") == f"${n}.{cents:02d}"
        digits = "".join(rng.choices("0123456789", k=3))
        assert normalize_english(f"{spell(n)} point {' '.join(_ONES[int(c)] for c in digits)}") == f"{n}.{digits}"
        assert normalize_english(f"minus {spell(n)} degrees") == f"-{n} degrees"
    for y in range(1100, 2000):
        if y % 100 > 9:
            assert normalize_english(f"in {spell(y // 100)} {spell(y % 100)}") == f"in {y}"
        elif y % 100:
            assert normalize_english(f"in {spell(y // 100)} oh {spell(y % 100)}") == f"in {y}"


@pytest.mark.parametrize(("said", "form"), [
    ("seven million dollars", "$7000000"), ("$5 million and 20 cents", "$5000000.20"), ("fifty cents", "¢50"), ("the sixties", "the 60s"), ("two and a half hours", "2.5 hours"),
    ("point nine", "0.9"), ("double seven", "77"), ("triple o one", "0001"), ("one two three", "123"), ("nine and ten", "9 and 10"), ("a second chance", "a second chance"),
    ("forty second street", "42nd street"), ("twenty-five", "25"), ("3.5 percent of it", "3.5% of it"), ("% and $ alone", "and alone"), ("a café (closed) [noise]", "a cafe"),
    ("1,234,567 things", "1234567 things"), ("won't can't it's", "will not can not it is"), ("um the uh end", "the end"), ("", ""), ("and", "and"), ("o", "o"), ("point", "point"),
    ("hundreds of them", "100s of them"), ("plus ten", "+10"),
])
def test_english_forms(said, form):
    assert normalize_english(said) == form


@pytest.mark.parametrize(("said", "form"), [
    ("the second time", "the 2nd time"), ("The second, of two", "the 2nd of 2"), ("a second chance", "a second chance"), ("the seconds", "the seconds"), ("second", "second")])
def test_a_second_behind_the_is_an_ordinal(said, form):
    assert normalize_english(said) == form


# rules, readers and writers ----------------------------------------------------------------


@pytest.mark.parametrize(("relative", "previous", "other", "label"), [
    (-0.20, 0.003, 0.010, "general"), (-0.20, 0.003, 0.0101, "spelling is not enough"), (-0.19, 0.0, 0.0, "loses the gain"), (-0.5, 0.0031, 0.0, "loses the gain"), (float("nan"), 0.0, 0.0, "loses the gain")])
def test_respelled_rule(spark, relative, previous, other, label):
    d = spark.createDataFrame([(relative, previous, other)], "relative double, previous_delta double, other_delta double")
    assert verdicts.verdict(d, "respelled").first().verdict == label


@pytest.mark.parametrize(("gap", "empty", "nonfinite", "label"), [(0.002, 0, 0, "half precision"), (0.0021, 0, 0, "full precision"), (0.0, 1, 0, "full precision"), (0.0, 0, 1, "full precision")])
def test_precision_gate(spark, gap, empty, nonfinite, label):
    d = spark.createDataFrame([(gap, empty, nonfinite)], "abs_delta double, empty long, nonfinite long")
    assert verdicts.verdict(d, "precision_gate").first().verdict == label


def test_interval_rules(spark):
    d = spark.createDataFrame([(-0.2, -0.1), (-0.1, 0.0), (0.0, 0.0005), (0.0005, 0.001), (0.001, 0.01), (0.005, 0.02)], "low double, high double")
    got = {n: [r[0] for r in d.select(rule.holds().alias("x")).collect()] for n, rule in reports.INTERVAL_RULES.items()}
    assert got == {
        "upper < 0": [True] + [False] * 5, "upper <= +0.1%p": [True] * 4 + [False] * 2, "upper < +0.10%p": [True] * 3 + [False] * 3, "upper <= +1.0%p": [True] * 5 + [False],
        "contains 0": [False, True, True, False, False, False], "excludes 0": [True, False, False, True, True, True]}


def test_nothing_that_is_not_finite_is_written(spark, tmp_path):
    kind = "id int, s struct<x: double, y: array<struct<z: float>>>, m map<string, double>, `a.b` double, t string"
    good = (1, (1.0, [(2.0,), None]), {"k": 1.0, "n": None}, 3.0, "NaN")
    writers.write_new(spark.createDataFrame([good, (2, None, None, None, None)], kind), str(tmp_path / "good"))
    assert spark.read.json(str(tmp_path / "good")).count() == 2
    nan, inf = float("nan"), float("-inf")
    for k, bad in enumerate([(1, (nan, []), {}, 0.0, ""), (1, (1.0, [(1.0,), (inf,)]), {}, 0.0, ""), (1, (1.0, []), {"k": 1.0, "n": nan}, 0.0, ""), (1, (1.0, []), {}, inf, "")]):
        with pytest.raises(Exception, match="is not finite"):
            writers.write_new(spark.createDataFrame([bad], kind), str(tmp_path / f"bad{k}"))


def test_lists_and_definitions_are_read(spark, tmp_path):
    (tmp_path / "own-val.json").write_text(json.dumps({"set": "own-val", "count": 2, "of": 9, "ids": ["b", "a"], "rule": "x", "per_model": {"m": 2}}))
    (tmp_path / "short.json").write_text(json.dumps({"count": 3, "ids": ["b"]}))
    for name in ("own-val", "own-val@telephone"):
        assert sorted(r.id for r in readers.read_listed(spark, str(tmp_path), name).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="cut short"):
        readers.read_listed(spark, str(tmp_path), "short").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_listed(spark, str(tmp_path), "other")
    record = {"percent": 15, "held_out": 2, "held_out_sha256": ["h1", "h2"], "subsets": {"v-unseen": {"of": "v", "utterances": 2, "ids": ["a", "b"], "never_trained": ["b"]}, "v-seen": {"of": "v", "utterances": 1, "ids": ["c"], "never_trained": []}}}
    (tmp_path / "def.json").write_text(json.dumps(record))
    got = sorted((r.kind, r.name or "", r.id) for r in readers.read_definition(spark, str(tmp_path / "def.json")).collect())
    assert got == [("held out", "", "h1"), ("held out", "", "h2"), ("never trained", "v-unseen", "b"), ("subset", "v-seen", "c"), ("subset", "v-unseen", "a"), ("subset", "v-unseen", "b")]


def test_provenance(spark, tmp_path):
    import hashlib

    folder = tmp_path / "adapter"
    (folder / "sub").mkdir(parents=True)
    files = {"config.json": b"{}", "sub/weights.bin": b"\0\1", "notes.txt": b"x"}
    for n, b in files.items():
        (folder / n).write_bytes(b)
    got = {r.name: (r.bytes, r.sha256) for r in provenance.folder_digests(spark, str(folder), r".*\.(json|bin)").collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items() if not n.endswith("txt")}
    one = provenance.folder_digest(spark, str(folder))
    assert len(one) == 64 and one == provenance.folder_digest(spark, str(folder))
    (folder / "notes.txt").write_bytes(b"y")
    assert provenance.folder_digest(spark, str(folder)) != one
    (tmp_path / ".git" / "refs").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/main\n")
    assert provenance.commit_of(str(tmp_path)) is None
    (tmp_path / ".git" / "packed-refs").write_text("# pack\nabc123 refs/main\n")
    assert provenance.commit_of(str(tmp_path)) == "abc123"
    (tmp_path / ".git" / "refs" / "main").write_text("def456\n")
    assert provenance.commit_of(str(tmp_path)) == "def456" and provenance.commit_of(str(tmp_path / "none")) is None
    assert provenance.stamped(spark.range(1), {"commit": "c", "model": None}).first().provenance == {"commit": "c", "model": None}
