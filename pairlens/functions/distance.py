"""Edit distances and scores of text pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, has_digit, normalize, strip

#: Code points that stand for a pair's distinct words: a plane without
#: surrogates, far more than a pair has words.
_FIRST = 0x4E00


def char_edits(reference, hypothesis) -> Column:
    """Least insertions, deletions and replacements of characters."""
    return F.levenshtein(_c(reference), _c(hypothesis)).cast("long")


def _words(text) -> Column:
    return F.filter(F.split(strip(text), "(?U)[\\s\\x1c-\\x1f]+"), lambda w: w != "")


def word_edits(reference, hypothesis) -> Column:
    """Least edits of words; null where the reference has none.  Each of a
    pair's distinct words becomes one character, so the built-in distance of
    strings does the work."""
    def code(words, known):
        return F.array_join(F.transform(words, lambda w: F.decode(
            F.unhex(F.lpad(F.hex(F.array_position(known, w) + _FIRST), 4, "0")), "UTF-16BE")), "")

    # Arrays of one element bind values, which would else be computed per word.
    words = F.array(F.struct(_words(_c(reference)).alias("r"), _words(_c(hypothesis)).alias("h")))
    bound = F.transform(words, lambda x: F.struct(x["r"].alias("r"), x["h"].alias("h"), F.array_distinct(F.concat(x["r"], x["h"])).alias("k")))
    edits = F.transform(bound, lambda x: F.when(F.size(x["r"]) > 0, F.levenshtein(code(x["r"], x["k"]), code(x["h"], x["k"])).cast("long")))
    return F.get(edits, F.lit(0))


def word_count(text) -> Column:
    return F.size(_words(_c(text))).cast("long")


def score(df: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", language="en") -> DataFrame:
    """``df`` with edits and length after normalisation, by characters in
    ``ko``, else by words; both null where the reference is empty then.

    ``language`` is a name or a column of names.
    """
    ref, hyp = normalize(reference, language), normalize(hypothesis, language)
    d = df.select("*", ref.alias("_ref"), hyp.alias("_hyp"))
    by_char = (char_edits("_ref", "_hyp"), F.length("_ref").cast("long"))
    by_word = (word_edits("_ref", "_hyp"), word_count("_ref"))
    if isinstance(language, str):
        edits, length = by_char if language == "ko" else by_word
    else:
        edits, length = (F.when(language == "ko", a).otherwise(b) for a, b in zip(by_char, by_word, strict=True))
    some = F.col("_ref") != ""
    return d.select(*df.columns, F.when(some, edits).alias("edits"), F.when(some, length).alias("length"))


def score_rows(df: DataFrame, language="en") -> DataFrame:
    """As ``score``, with 0 and 0 for empty references, and ``has_digit`` of the
    hypothesis (null for those)."""
    scored = score(df.drop("edits", "length", "has_digit"), language=language)
    some = F.col("length").isNotNull()
    return scored.withColumn("has_digit", F.when(some, has_digit("hypothesis"))).fillna(0, ["edits", "length"])
