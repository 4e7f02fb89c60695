"""Comparisons of result sets row by row."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import score, word_count, word_edits
from ..functions.english import normalize_english
from ..functions.letters import letters_to_latin
from ..functions.numerals import as_column, harmonize, harmonize2, to_digits
from ..functions.text import _c, has_digit, normalize, strip
from .rates import rate, relative

_hm = lambda c: as_column(harmonize, c)
_digits = lambda c: as_column(to_digits, c)
_latin = lambda c: as_column(lambda t: letters_to_latin(to_digits(t)), c)
_plain = lambda c: as_column(lambda t: letters_to_latin(harmonize(t)), c)
#: name -> (rewrite of the reference, of the hypothesis); none: as it is.
SCORINGS = {
    "harmonized": (_hm, _hm),
    "harmonized2": tuple([lambda c: as_column(harmonize2, c)] * 2),
    "itn": (None, _digits),
    "itn-harmonized": (_hm, lambda c: as_column(lambda t: harmonize(to_digits(t)), c)),
    "itn-latin": (None, _latin),
    "agnostic": (_plain, _plain),
    "en-standard": tuple([lambda c: as_column(normalize_english, c)] * 2),
}


#: Scorings whose rewritten texts are counted as they are, by words.
FINAL = {"en-standard"}
#: The language of the sets that a scoring is for; others are for Korean.
LANGUAGE = {"en-standard": "en"}


def scoring_language(scoring: str) -> str:
    return LANGUAGE.get(scoring, "ko")


def rescored(df: DataFrame, scoring: str, language: str | None = None) -> DataFrame:
    """``df`` with edits and length counted anew after a rewrite, in the
    scoring's language; another one is an error.  Texts and other columns stay
    as they are.  Rows whose reference vanishes get 0 and 0."""
    wanted = scoring_language(scoring)
    if language not in (None, wanted):
        raise ValueError(f"the {scoring} scoring is for sets in {wanted}, not {language}")
    ref, hyp = SCORINGS[scoring]
    d = df.select(*[c for c in df.columns if c not in ("edits", "length")], (ref("reference") if ref else F.col("reference")).alias("_r"), (hyp("hypothesis") if hyp else F.col("hypothesis")).alias("_h"))
    if scoring in FINAL:
        d = d.withColumns({"edits": word_edits("_r", "_h"), "length": word_count("_r")})
    else:
        d = score(d, "_r", "_h", wanted)
    some = F.coalesce(F.col("length"), F.lit(0)) > 0
    return d.withColumns({c: F.when(some, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("edits", "length")}).drop("_r", "_h")


def compared(text, scoring: str) -> Column:
    """A text as ``scoring`` compares it: normalised, unless the scoring is final."""
    return _c(text) if scoring in FINAL else normalize(text, scoring_language(scoring))


def require(condition: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``condition`` doesn't hold."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def paired(candidate: DataFrame, baseline: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of both: id, length, edits_a (candidate), edits_b, reference.
    Lengths that differ are an error."""
    a = candidate.select(id_col, F.col("edits").alias("edits_a"), F.col("length").alias("_l"))
    b = baseline.select(id_col, F.col("edits").alias("edits_b"), "length", "reference")
    both = a.join(b, id_col)
    same = F.when(F.col("_l") == F.col("length"), F.col("length")).otherwise(F.raise_error(F.lit("the two scorings give different reference lengths")).cast("long"))
    return both.select(id_col, same.alias("length"), "edits_a", "edits_b", "reference")


def compare(pairs: DataFrame, *by: str) -> DataFrame:
    """utterances, baseline, candidate, delta and relative change."""
    base, cand = rate("edits_b"), rate("edits_a")
    d = pairs.groupBy(*by).agg(F.count("*").alias("utterances"), base.alias("baseline"), cand.alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    return d.select("*", delta.alias("delta"), relative(delta, F.col("baseline")).alias("relative"))


def digit_split(pairs: DataFrame) -> DataFrame:
    """``pairs`` with whether the reference has a digit."""
    return pairs.withColumn("has_digit", has_digit("reference"))


def shared_ids(sets: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Ids of all sets."""
    long = reduce(DataFrame.unionAll, [s.select(id_col, F.lit(k).alias("_s")) for k, s in enumerate(sets)])
    return long.groupBy(id_col).agg(F.count_distinct("_s").alias("_n")).where(F.col("_n") == len(sets)).select(id_col)


def loops(df: DataFrame) -> DataFrame:
    """Rows with more edits than reference."""
    return df.where("edits > length")


def change_flags(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """Per row of both: what a second decoding changed."""
    a = after.select(id_col, *[F.col(c).alias(f"_{c}") for c in ("hypothesis", "edits", "length", "temperature", "fallback_exhausted")])
    j = before.join(a, id_col)
    redecoded = F.coalesce(F.col("_temperature") != 0, F.lit(False))
    changed = ~F.col("hypothesis").eqNullSafe(F.col("_hypothesis"))
    looped = F.col("edits") > F.col("length")
    return j.select(
        id_col, redecoded.alias("redecoded"), F.coalesce("_fallback_exhausted", F.lit(False)).alias("exhausted"), changed.alias("changed"),
        (changed & ~redecoded).alias("changed_not_redecoded"), (changed & ~looped).alias("changed_outside_loops"),
        looped.alias("loop_before"), (F.col("_edits") > F.col("_length")).alias("loop_after"), (strip("_hypothesis") == "").alias("empty"))


def same_rows(a: DataFrame, b: DataFrame, id_col: str = "id", position: str = "pos", value: str = "hypothesis") -> DataFrame:
    """(rows, missing, differ): whether two ordered lists have the same rows."""
    x, y = (d.select(id_col, position, F.col(value).alias(n), F.lit(True).alias("_" + n)) for d, n in ((a, "va"), (b, "vb")))
    j = x.join(y, [id_col, position], "full_outer")
    return j.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_va").isNull() | F.col("_vb").isNull()).alias("missing"),
        F.count_if(F.col("_va") & F.col("_vb") & ~F.col("va").eqNullSafe(F.col("vb"))).alias("differ"))


def changed_words(before, after) -> Column:
    """Word runs that differ between two texts, as an array of (left, right)
    that still differ once normalised."""
    @F.pandas_udf("array<struct<left:string,right:string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(a, b):
            a, b = (a or "").split(), (b or "").split()
            ops = SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
            return [{"left": " ".join(a[i:j]), "right": " ".join(b[k:m])} for op, i, j, k, m in ops if op != "equal"]

        return pd.Series([one(a, b) for a, b in zip(x, y, strict=True)])

    key = lambda c: normalize(c, "ko")
    return F.filter(run(before, after), lambda p: key(p["left"]) != key(p["right"]))


def word_pair_counts(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows have each changed pair, most first."""
    pairs = df.select(F.explode(F.array_distinct(changed_words(before, after))).alias("p")).select("p.*")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "left", "right")


def scoring_diff(df: DataFrame, first: str, second: str, language: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows that two scorings count differently."""
    a = rescored(df, first, language).select("*", F.col("edits").alias("edits_first"), F.col("length").alias("length_first")).drop("edits", "length")
    b = rescored(a, second, language)
    return b.select(id_col, "edits_first", "length_first", F.col("edits").alias("edits_second"), F.col("length").alias("length_second")).where(
        "edits_first <> edits_second or length_first <> length_second")


def scoring_totals(df: DataFrame, first: str, second: str, language: str | None = None) -> DataFrame:
    """One row: sums of edits and lengths by two scorings of the same rows, of
    which both keep the reference."""
    a = rescored(df, first, language).withColumnsRenamed({"edits": "edits_first", "length": "length_first"})
    b = rescored(a, second, language).where("length_first > 0 and length > 0")
    return b.agg(*[F.sum(c).alias(n) for c, n in (("edits_first", "edits_first"), ("length_first", "length_first"), ("edits", "edits_second"), ("length", "length_second"))])
