"""Functions against given values and plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.functions import audio, text
from pairlens.functions.distance import score, score_rows, word_edits
from pairlens.functions.english import normalize_english
from pairlens.functions.letters import letters_to_latin
from pairlens.functions.numerals import harmonize, harmonize2, split_attached, to_digits

ONES = ["", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]


def _places(n: int) -> list[str]:
    """The pieces of the Sino-Korean numeral of a number below 10,000."""
    out = []
    for unit, size in (("천", 1000), ("백", 100), ("십", 10), ("", 1)):
        d = n // size % 10
        if d:
            out.append(unit if d == 1 and unit else ONES[d] + unit)
    return out


def _numeral(n: int) -> list[str]:
    """The same below 10 ** 8: a group of four places, its letter, the rest."""
    high, low = divmod(n, 10_000)
    return [*_places(high), *["만"] * (high > 0), *_places(low)]


def _shown(n: int) -> str:
    high, low = divmod(n, 10_000)
    return " ".join([f"{high}만"] * (high > 0) + [str(low)] * (low > 0))


def test_numerals_of_any_size():
    rng = random.Random(3)
    for n in [*range(1, 1200), *(rng.randrange(1, 10**8) for _ in range(1500))]:
        spelled, shown = _numeral(n), _shown(n)
        if shown.endswith("만"):  # the letter is then the counted unit itself
            continue
        assert to_digits(" ".join(["약", *spelled, "퍼센트가", "늘었다"])) == f"약 {shown}퍼센트가 늘었다"
        assert harmonize(" ".join([*spelled, "%"])) == f"{shown}퍼센트"
        assert split_attached("".join(spelled) + "년도") in (" ".join(spelled) + " 년도", "".join(spelled) + "년도")
        assert harmonize2("".join(spelled) + "개월, 뒤!") == f"{shown}개월 뒤"


@pytest.mark.parametrize(("text", "out"), [
    ("시 월 말과 유 월 초", "10월 말과 6월 초"), ("시월에", "시월에"), ("서른 두 개를 샀다", "32개를 샀다"), ("일흔 살쯤", "70살쯤"), ("여덟 가지", "8가지"),
    ("세 사람이 한 번 갔다", "세 사람이 한 번 갔다"), ("이 사람과 오 사람", "이 사람과 오 사람"), ("사 년 뒤", "4년 뒤"), ("사 명이", "사 명이"),
    ("삼 개국", "삼 개국"), ("칠 삼 년", "칠 3년"), ("3월 12일", "3월 12일"), ("", ""),
])
def test_to_digits(text, out):
    assert to_digits(text) == out


@pytest.mark.parametrize(("attached", "out"), [
    ("마흔두살에", "42살에"), ("시월에는", "10월에는"), ("백이십층까지", "120층까지"), ("사과를", "사과를"), ("오늘은", "오늘은"), ("구번", "구번"), ("팔번", "8번"), ("이백만원", "200만원"),
])
def test_harmonize2(attached, out):
    assert harmonize2(attached) == out


@pytest.mark.parametrize(("spelled", "latin"), [
    ("케이비에스 뉴스", "KBS 뉴스"), ("제이 피 지로", "JPG로"), ("엑스 와이, 제트", "XY, 제트"), ("큐알이라는 것", "QR이라는 것"), ("아이가 오", "아이가 오"), ("브이 모양", "브이 모양"), ("유 에프 오! 에스 엠", "UFO! SM"), ("", ""),
])
def test_letters(spelled, latin):
    assert letters_to_latin(spelled) == latin


def test_english_form():
    assert normalize_english("It's seven o'clock, um, [noise] won't") == "it is 7 oclock will not"
    assert normalize_english("ten thousand percent") == "10000%"
    assert normalize_english("colour", {"colour": "color"}) == "color"
    assert normalize_english("twenty five, one hundred and two") == "25 102"
    assert normalize_english("one hundred and all") == "100 and all"
    assert normalize_english("") == normalize_english("um [x]") == ""


def test_normalize(spark):
    d = spark.createDataFrame([("할 수 있다, '희망'을!", "It's  a   Test._x"), (None, "")], "k string, e string")
    got = d.select(text.normalize("k", "ko"), text.normalize("e")).collect()
    assert [tuple(r) for r in got] == [("할수있다희망을", "it's a test x"), (None, "")]
    raw = spark.createDataFrame([(" assistant\nlang<asr_text> so \n",), ("plain ",)], "t string").select(text.raw_transcription("t")).collect()
    assert [r[0] for r in raw] == ["so", "plain"]


def _model(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits_against_a_model(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("a b c dd é 한".split(), k=rng.randint(0, 9))), " ".join(rng.choices("a b c dd é 한".split(), k=rng.randint(0, 9)))) for _ in range(120)]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", word_edits("r", "h").alias("n")).collect()
    assert all(x.n == (_model(x.r.split(), x.h.split()) if x.r.split() else None) for x in got)


def test_score(spark):
    d = spark.createDataFrame([("할 수 있다", "할수 없다", "ko"), ("the cat sat", "the cat sat down", "en"), ("...", "x", "en")], "reference string, hypothesis string, lang string")
    got = score(d, language=F.col("lang")).select("edits", "length").collect()
    assert [tuple(r) for r in got] == [(1, 4), (1, 3), (None, None)]
    rows = spark.createDataFrame([("오는 오 월", "오는 5월"), ("!", "5")], "reference string, hypothesis string")
    assert [tuple(r) for r in score_rows(rows, "ko").select("edits", "length", "has_digit").collect()] == [(1, 4, True), (0, 0, None)]


def test_channel(spark):
    x = np.linspace(-1.2, 1.2, 4001)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(audio.mu_law_roundtrip("x")).collect()]
    assert len(set(got)) <= 256
    assert abs(spark.range(1).select(audio.mu_law_roundtrip(F.lit(0.01))).first()[0] - 0.01) < 0.002
    short = spark.createDataFrame([([0.5] * 10,), ([0.1] * 200,), (None,)], "a array<float>").select(audio.telephone("a")).collect()
    assert short[0][0] == [0.5] * 10 and len(short[1][0]) == 200 and short[2][0] is None
