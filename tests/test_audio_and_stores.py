"""Decoding, filters, the blob store, and rebuilds, against plain recounts."""

import math
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import audio, signal, wav
from pairlens.sources import readers, rebuild, store

# WAV ---------------------------------------------------------------------------------------


def riff(data: bytes, code=1, channels=1, rate=16_000, bits=16, extensible=False, extra=b"", size=None) -> bytes:
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 0, code) + b"\0" * 14
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def convolved(x, rate, to):
    """The resampler's sum as it is written: every tap, every input."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    h = signal.lowpass(up, down)
    half = len(h) // 2
    return np.array([sum(v * h[n * down + half - k * up] for k, v in enumerate(x) if 0 <= n * down + half - k * up < len(h)) for n in range(-(-len(x) * up // down))])


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (16000, 8000), (44100, 16000), (11025, 16000), (16000, 16000), (48000, 16000), (22050, 8000)])
def test_resample(rate, to):
    x = np.random.default_rng(rate).normal(0, 0.2, 173)
    got = signal.resample(x, rate, to)
    want = x if rate == to else convolved(x, rate, to)
    assert len(got) == -(-len(x) * to // rate) and np.allclose(got, want, atol=1e-12)
    assert len(signal.resample(np.zeros(0), rate, to)) == 0
    tone = np.sin(2 * np.pi * 440 * np.arange(4000) / rate)
    assert np.abs(signal.resample(tone, rate, to)[200:-200] - np.sin(2 * np.pi * 440 * np.arange(-(-4000 * to // rate)) / to)[200:-200]).max() < 5e-3


def test_decode(spark):
    rng = np.random.default_rng(1)
    ints = rng.integers(-32768, 32768, 200).astype("<i2")
    wide = rng.integers(-(1 << 23), 1 << 23, 100)
    stereo = rng.integers(-32768, 32768, (90, 2)).astype("<i2")
    floats = rng.uniform(-1.5, 1.5, 70).astype("<f4")
    slow = rng.integers(-20000, 20000, 120).astype("<i2")
    blobs = {
        "pcm16": (riff(ints.tobytes()), ints),
        "pcm8": (riff(bytes(range(256)), bits=8), (np.arange(256) - 128) * 256),
        "pcm24": (riff(b"".join(int(v).to_bytes(3, "little", signed=True) for v in wide), bits=24), np.clip(np.rint(wide / 256), -32768, 32767)),
        "pcm32": (riff((wide.astype("<i4") * 256).tobytes(), bits=32), np.clip(np.rint(wide / 256), -32768, 32767)),
        "float": (riff(floats.tobytes(), code=3, bits=32), np.clip(np.rint(floats.astype(float) * 32768), -32768, 32767)),
        "double": (riff(floats.astype("<f8").tobytes(), code=3, bits=64), np.clip(np.rint(floats.astype(float) * 32768), -32768, 32767)),
        "stereo": (riff(stereo.tobytes(), channels=2), np.clip(np.rint(stereo.astype(float).mean(1)), -32768, 32767)),
        "extensible": (riff(ints.tobytes(), extensible=True), ints),
        "chunks": (riff(ints.tobytes(), extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"), ints),
        "slow": (riff(slow.tobytes(), rate=8000), np.clip(np.rint(convolved(slow / 32768, 8000, 16000) * 32768), -32768, 32767)),
        "cut short": (riff(ints.tobytes() + b"x", size=1 << 30), ints),
        "no samples": (riff(b""), ints[:0]),
    }
    bad = {
        "null": (None, "no audio"), "empty": (b"", "not a RIFF/WAVE file"), "text": (b"RIFFxxxxAVI nothing", "not a RIFF/WAVE file"), "no format": (b"RIFF\4\0\0\0WAVE", "no format chunk"),
        "no data": (riff(b"")[:36], "no data chunk"), "law": (riff(b"abc", code=7, bits=8), "format 7 of 8 bits"), "no rate": (riff(b"ab", rate=0), "no rate or no channels"),
        "nan": (riff(np.array([np.nan], "<f4").tobytes(), code=3, bits=32), "samples that aren't finite"),
    }
    rows = [(n, b) for n, (b, _) in blobs.items()] + [(n, b) for n, (b, _) in bad.items()]
    got = {r.n: r.a for r in spark.createDataFrame(rows, "n string, b binary").repartition(3).select("n", wav.decode("b").alias("a")).collect()}
    for n, (_, want) in blobs.items():
        assert got[n].reason is None and got[n].samples == [int(v) for v in want], n
    assert got["stereo"].channels == 2 and got["slow"].rate == 8000
    for n, (_, why) in bad.items():
        assert got[n].samples is None and got[n].reason == why, n


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_encode_is_read_back(spark, bits):
    x = [0.0, 0.25, -1.0, 1.0, 2.0, 0.1]
    blob = spark.createDataFrame([(x,)], "x array<double>").select(wav.encode("x", bits, 8000).alias("b")).first().b
    samples, rate, reason = wav.parse(bytes(blob))
    top = 2.0 ** (bits - 1)
    assert rate == 8000 and reason is None and samples.ravel().tolist() == [max(-top, min(top - 1, np.rint(v * top))) / top for v in x]
    assert blob[:4] == b"RIFF" and struct.unpack_from("<I", blob, 4)[0] == len(blob) - 8


# the telephone -----------------------------------------------------------------------------


def recursion(x, sections):
    """The filter's definition: one sample after another, having met x[0] forever before."""
    for g, a1, a2 in sections:
        u1 = u2 = x[0]
        y1 = y2 = 0.0
        out = []
        for v in x:
            y = g * (v - u2) - a1 * y1 - a2 * y2
            u1, u2, y1, y2 = v, u1, y, y1
            out.append(y)
        x = out
    return np.array(x)


def test_band_and_both_ways():
    sections = signal.bandpass(4, 300.0, 3400.0, 16_000.0)
    gain = lambda f: abs(np.prod([g * (1 - z**-2) / (1 + a1 / z + a2 / z**2) for g, a1, a2 in sections for z in [np.exp(2j * np.pi * f / 16_000)]]))
    assert gain(300) == pytest.approx(0.5**0.5, abs=1e-9) and gain(3400) == pytest.approx(0.5**0.5, abs=1e-9)
    assert gain(1000) == pytest.approx(1, abs=1e-3) and gain(100) < 0.02 and gain(6500) < 0.02
    for n in (64, 255, 256, 257, 1999):
        x = np.random.default_rng(n).normal(0, 0.1, n) + 0.3
        pad = 27
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        for _ in range(2):
            y = recursion(y, sections)[::-1]
        assert np.abs(signal.filter_both_ways(x, sections) - y[pad:-pad]).max() < 1e-9


def test_telephone(spark):
    t = np.arange(11_680) / 16_000
    tones = {f: np.sin(2 * np.pi * f * t) * 0.5 for f in (100, 1000, 6000)}
    noise = np.random.default_rng(0).normal(0, 0.1, 16_000)
    rows = [(f, x.astype(np.float32).tolist()) for f, x in tones.items()] + [(1, noise.tolist())]
    out = {r.f: np.array(r.y) for r in spark.createDataFrame(rows, "f int, x array<float>").select("f", audio.telephone("x").alias("y")).collect()}
    energy = lambda x, low, high: float((np.abs(np.fft.rfft(x)) ** 2)[(np.fft.rfftfreq(len(x), 1 / 16_000) >= low) & (np.fft.rfftfreq(len(x), 1 / 16_000) < high)].sum())
    assert len(out[1000]) == 11_680 and np.corrcoef(tones[1000], out[1000])[0, 1] > 0.98
    assert all(energy(out[f], 0, 8000) < 0.02 * energy(tones[f], 0, 8000) for f in (100, 6000))
    assert energy(out[1], 4200, 8000) < 0.001 * energy(out[1], 300, 3400)
    # Step by step as the channel is defined.
    x = noise[:700]
    sections, pad = signal.bandpass(4, 300.0, 3400.0, 16_000.0), 27
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        y = recursion(y, sections)[::-1]
    narrow = convolved(y[pad:-pad], 2, 1)
    want = convolved(audio._mu_law(narrow), 1, 2)[:700]
    assert np.abs(audio.telephone_samples(x) - want).max() < 1e-6


def test_windows_and_lengths(spark):
    d = spark.createDataFrame([([1, 2, 3, 4],), ([1],), ([],), (None,)], "x array<int>")
    assert [r[0] for r in d.select(audio.first_window("x", 1, 3)).collect()] == [[1, 2, 3], [1], [], None]
    t = spark.createDataFrame([([5, 7, 2, 9],), ([5, 6],), ([2],), ([],)], "t array<int>").select(audio.generated_length("t", [9, 2]).alias("g")).collect()
    assert [tuple(r.g) for r in t] == [(2, False), (2, True), (0, False), (0, True)]
    x = spark.createDataFrame([([-32768, 0, 16384],)], "x array<short>").select(audio.pcm_to_float("x").alias("f"))
    assert x.first().f == [-1.0, 0.0, 0.5] and x.select(audio.float_to_pcm("f")).first()[0] == [-32768, 0, 16384]


# the store ---------------------------------------------------------------------------------


def test_store_and_slices(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [rng.integers(-32768, 32768, int(n)).astype("<i2").tobytes() for n in rng.integers(0, 3000, 120)]
    d = spark.createDataFrame([(i, x, "t") for i, x in enumerate(data)], "id long, data binary, text string").repartition(6)
    path = str(tmp_path / "s")
    store.write_store(d, path, ["id"], blob_bytes=100_000)
    index = store.read_index(spark, path)
    rows = {r.id: r for r in index.collect()}
    assert len(rows) == 120 and len({r.blob for r in rows.values()}) > 3 and "text" in index.columns
    files = {f: open(f.removeprefix("file:"), "rb").read() for f in {r.file for r in rows.values()}}  # noqa: SIM115
    assert all(files[r.file][r.offset : r.offset + r.length] == data[i] for i, r in rows.items())
    assert all(len(f) <= 100_000 + 6002 for f in files.values())
    order = sorted(rows.values(), key=lambda r: r.id)
    assert [(r.blob, r.offset) for r in order] == sorted((r.blob, r.offset) for r in order)
    with pytest.raises(Exception, match="already exists"):
        store.write_store(d, path, ["id"])
    whole = {r.id: bytes(r.data) for r in store.read_slices(index).collect()}
    assert whole == dict(enumerate(data))
    # A few small slices: no blob is read whole.
    asked = [(i, r.file, r.offset + 2 * k, 40) for i, r in rows.items() for k in (3, 40, 41, 45) if r.length > 200 and i % 4 == 0]
    some = spark.createDataFrame(asked, "id long, file string, offset long, length long").repartition(5)
    got = store.read_slices(some).collect()
    assert sorted((r.id, r.offset, bytes(r.data)) for r in got) == sorted((i, o, files[f][o : o + n]) for i, f, o, n in asked)
    distinct = {(f, b) for _, f, o, n in asked for b in range(o, o + n)}
    read = sum(r.bytes_read for r in got)
    assert read <= 1.2 * len(distinct) < 0.2 * sum(map(len, files.values()))


def test_slices_of_edges(spark, tmp_path):
    f = tmp_path / "a b.bin"
    f.write_bytes(bytes(range(100)))
    name = f.as_uri()
    rows = [(1, name, 0, 10), (2, name, 95, 50), (3, name, 200, 5), (4, name, 10, 0), (5, None, 0, 1), (6, name, None, 1), (7, name, 3, None), (8, name, 0, 10), (9, name, 0, 100)]
    d = spark.createDataFrame(rows, "k int, file string, offset long, length long")
    got = {r.k: None if r.data is None else list(r.data) for r in store.read_slices(d).collect()}
    assert got == {1: list(range(10)), 2: list(range(95, 100)), 3: [], 4: [], 5: None, 6: None, 7: None, 8: list(range(10)), 9: list(range(100))}
    assert store.read_slices(d.where("false")).count() == 0
    with pytest.raises(Exception, match="missing"):
        store.read_slices(spark.createDataFrame([(1, (tmp_path / "missing").as_uri(), 0, 1)], d.schema)).collect()


@pytest.mark.parametrize("slack", [0.0, 0.15, 1.0])
def test_merged_ranges_stay_within_slack(slack):
    rng = np.random.default_rng(6)
    low = np.sort(rng.integers(0, 20_000, 300))
    high = low + rng.integers(0, 60, 300)
    starts = store.merged(low, high, slack)
    groups = np.split(np.arange(300), starts[1:])
    for g in groups:
        asked = len({b for k in g for b in range(low[k], high[k])})
        assert high[g].max() - low[g[0]] <= (1 + slack) * asked + 1e-9
    assert starts[0] == 0 and (slack == 0 or len(groups) < 300)


def test_scan_in_file_order(spark, tmp_path):
    for n in (10, 2, 0):
        spark.createDataFrame([(f"{n}-{k}", "x") for k in range(3)], "id string, other string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next(p for p in os.listdir(tmp_path / f"w{n}") if p.startswith("part"))
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(tmp_path / f"w{n}" / part, tmp_path / "in" / f"{n}.parquet")
    got = readers.scan(spark, str(tmp_path / "in"), ["id"]).orderBy("file", "row")
    assert [r.id for r in got.collect()] == [f"{n}-{k}" for n in (0, 2, 10) for k in range(3)]
    assert got.columns == ["id", "file", "row"]


# rebuilds ----------------------------------------------------------------------------------


def write_source(spark, path, name, rows):
    spark.createDataFrame(rows, "id long, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/tmp-{name}")
    part = next(p for p in os.listdir(f"{path}/tmp-{name}") if p.startswith("part"))
    os.makedirs(f"{path}/in", exist_ok=True)
    os.replace(f"{path}/tmp-{name}/{part}", f"{path}/in/{name}.parquet")


def parts(path):
    return {d: max(os.stat(f"{path}/data/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/data/{d}")) for d in os.listdir(f"{path}/data") if d.startswith("part=")}


def test_one_changed_file_rewrites_one_partition(spark, tmp_path):
    path, source, to = str(tmp_path), str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(8):
        write_source(spark, path, k, [(10 * k + j, j) for j in range(5)])
    make = lambda d: d.select("id", (F.col("v") * 2).alias("w"), "_source")
    read = lambda: sorted((r.id, r.w) for r in spark.read.parquet(f"{to}/data").collect())
    first = rebuild.rebuild(spark, source, to, make)
    assert {r.change for r in first.collect()} == {"new"} and first.count() == 8
    before = parts(to)
    assert len(before) == 8 and read() == [(10 * k + j, 2 * j) for k in range(8) for j in range(5)]
    assert rebuild.rebuild(spark, source, to, make).count() == 0 and parts(to) == before
    time.sleep(0.05)
    write_source(spark, path, 3, [(30 + j, j) for j in range(50)])
    with pytest.raises(rebuild.Stale, match="changed"):
        rebuild.rebuild(spark, source, to, make, mode="check")
    assert [r.change for r in rebuild.rebuild(spark, source, to, make).collect()] == ["changed"]
    after = parts(to)
    assert sorted(after) == sorted(before) and sum(after[p] != before[p] for p in before) == 1
    assert read() == sorted((i, 2 * j) for k in range(8) for i, j in [(10 * k + j, j) for j in range(50 if k == 3 else 5)])
    # A file that goes takes its partition along, a new one brings its own; a forced one is made again.
    os.remove(f"{source}/5.parquet")
    write_source(spark, path, 11, [(110, 1)])
    time.sleep(0.05)
    forced = next(r.path for r in first.collect() if r.path.endswith("/0.parquet"))
    made = {r.path.rsplit("/", 1)[1]: r.change for r in rebuild.rebuild(spark, source, to, make, forced=[forced]).collect()}
    assert made == {"5.parquet": "gone", "11.parquet": "new", "0.parquet": "forced"}
    last = parts(to)
    assert len(last) == 8 and sum(last.get(p) != t for p, t in after.items()) == 2
    write_source(spark, path, 2, [])
    rebuild.rebuild(spark, source, to, make)
    assert len(parts(to)) == 7 and not [i for i, _ in read() if 20 <= i < 30]
    assert rebuild.rebuild(spark, source, to, make, mode="all").count() == 8 and len(parts(to)) == 7


def test_adopting_a_table_without_a_record(spark, tmp_path):
    path, source, to = str(tmp_path), str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(Exception, match="(?i)path_not_found|no source files"):
        rebuild.rebuild(spark, source, to, lambda d: d)
    write_source(spark, path, 1, [(1, 1), (2, 2)])
    make = lambda d: d.select("id", "_source")
    rebuild.rebuild(spark, source, to, make, hashes=True)
    import shutil

    shutil.rmtree(f"{to}/sources")
    before = parts(to)
    with pytest.raises(rebuild.Stale, match="no record"):
        rebuild.rebuild(spark, source, to, make)
    with pytest.raises(rebuild.Stale):
        rebuild.rebuild(spark, source, to, make, adopt=lambda d: d.count() == 7)
    assert [r.change for r in rebuild.rebuild(spark, source, to, make, adopt=lambda d: d.count() == 2, hashes=True).collect()] == ["adopted"]
    assert parts(to) == before and rebuild.rebuild(spark, source, to, make, hashes=True).count() == 0
    # Of the same size, but of other content: only a hash tells.
    recorded = spark.createDataFrame([("a", 5, "x"), ("b", 5, "y"), ("c", 5, None)], rebuild.SOURCES)
    current = spark.createDataFrame([("a", 5, "x"), ("b", 5, "z"), ("c", 5, "w"), ("d", 1, None)], rebuild.SOURCES)
    assert sorted(map(tuple, rebuild.differences(recorded, current).collect())) == [("b", "changed"), ("d", "new")]
