"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base statistics are computed for every row.  The verdict is the conjunction of
the rules in ``RULES``.  On a sample, each rule's cost (the steps that it takes
beyond the statistics, by ``STEPS``) and selectivity (share rejected) are
estimated, and the rules are tried in descending order of rejection per cost; a
rule runs only on rows that all rules before it kept (``CASE WHEN`` evaluates
lazily).  The order changes the time, never the verdict.  Steps are counted, not
timed, and the sample goes by hashes, so the order is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, row_key

SPACE = "[ \\t-\\r]"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Rows that costs and rejections are estimated on, those of least hash of all;
#: they decide the order only.
SAMPLE_ROWS = 500


def _upper_words() -> Column:
    return F.size(F.filter("w", lambda x: (F.length(x) > 1) & x.rlike("\\p{Lu}") & ~x.rlike("\\p{Ll}")))


#: name -> condition under which a row is rejected, over the columns of ``statistics``.
RULES = {
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 15),
    "duplicate_lines": lambda: F.col("n_dup_lines") * 10 > F.col("n_lines") * 4,
    "upper_case": lambda: _upper_words() * 10 > F.col("n_words") * 3,
    "few_distinct_words": lambda: F.size(F.array_distinct("w")) * 20 < F.col("n_words"),
    "bullet_lines": lambda: F.size(F.filter(F.split("t", "\n"), lambda x: x.rlike("^ *[-*•]"))) * 10 > F.col("n_lines") * 9,
}
#: name -> steps that a rule takes for a row: characters or words it looks at.
#: Rules that are not here compare two of the statistics, in one step.
STEPS = {
    "upper_case": lambda: 2 * F.col("word_chars"),
    "few_distinct_words": lambda: F.col("word_chars"),
    "bullet_lines": lambda: F.length("t"),
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base columns of each row, with its words ``w`` and text ``t``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select(
        "*",
        held(F.filter(F.split("t", f"{SPACE}+"), lambda x: x != "")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    d = d.select(
        "doc_id", "t", "w",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        held(F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - WINDOW),
                lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))).alias("h"),
    )
    # Only a text that repeats a window pays for finding where.
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select("*", held(F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).alias("s")).drop("h")
    same = lambda i, j: F.coalesce(F.get("s", i)["h"] == F.get("s", j)["h"], F.lit(False))
    starts = F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
        lambda i: F.get("s", i)["i"],
    ))
    d = d.select("*", held(F.when(F.col("s").isNotNull(), starts)).alias("starts")).drop("s")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return d.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")).drop("starts").withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT),
    )


def cascade_order(docs: DataFrame, id_col: str, text_col: str, rules: dict, sample_rows: int, steps: dict | None = None) -> list[str]:
    """The rules' names by rejection per cost on the ``sample_rows`` rows of
    least hash of id and text; ties and an empty sample keep the rules' own
    order."""
    steps = STEPS if steps is None else steps
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("h"))
    # By the number of rows, a few times the sample is sorted, not all.
    least = -(1 << 63) + (1 << 64) * min(1.0, 4 * sample_rows / max(docs.count(), 1))
    few = d if least >= 1 << 63 else d.where(F.col("h") < int(least))
    sample = statistics(few.orderBy("h", "doc_id", "text").limit(sample_rows))
    one = lambda c: F.coalesce(c, F.lit(False)) & ~F.col("base_failed")
    cost = lambda n: F.avg(F.lit(1.0) + (steps[n]() if n in steps else F.lit(0)))
    found = sample.agg(*[F.struct(F.count_if(one(rule())).alias("rejected"), cost(n).alias("cost")).alias(n) for n, rule in rules.items()]).first()
    score = {n: found[n]["rejected"] / found[n]["cost"] if found[n]["cost"] else 0.0 for n in rules}
    return sorted(rules, key=lambda n: -score[n])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rules: dict | None = None, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, rejected_by (``base``, or
    the first rule of the cascade that rejects the row).

    Null and empty texts have no words and fail the base; a null id stays null;
    repeated rows are judged each by itself; an empty table gives an empty
    result; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    order = cascade_order(docs, id_col, text_col, rules, sample_rows)
    by = F.when(F.col("base_failed"), F.lit("base"))
    for name in order:
        by = by.when(F.coalesce(rules[name](), F.lit(False)), F.lit(name))
    d = statistics(docs, id_col, text_col).withColumn("rejected_by", by)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )
