"""Verdicts: declarative rules over a table of measured numbers.

A rule set is data: conditions (name, column, comparison, bound), and labels,
each with the conditions that must hold.  The first label whose conditions all
hold is the verdict, so a label without conditions is the default.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


@dataclass(frozen=True)
class Condition:
    name: str
    column: str
    op: str
    bound: float

    def holds(self) -> Column:
        """Null and NaN don't hold."""
        c = F.col(self.column).cast("double")
        return F.coalesce(_OPS[self.op](c, F.lit(float(self.bound))) & ~F.isnan(c), F.lit(False))


@dataclass(frozen=True)
class RuleSet:
    conditions: tuple[Condition, ...]
    #: (label, conditions that hold, conditions that don't)
    labels: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with a boolean per condition and the verdict."""
        d = df.select("*", *[c.holds().alias(c.name) for c in self.conditions])
        out = F.lit(None).cast("string")
        for label, yes, no in reversed(self.labels):
            terms = [F.col(n) for n in yes] + [~F.col(n) for n in no]
            out = F.when(reduce(Column.__and__, terms, F.lit(True)), F.lit(label)).otherwise(out)
        return d.withColumn("verdict", out)


C = Condition
RULES = {
    # Better at home by a fifth, and by a tenth without digits beyond doubt; elsewhere no more than a point worse.
    "in_domain": RuleSet(
        (C("overall", "relative", "<=", -0.20), C("no_digits", "relative_no_digits", "<=", -0.10),
         C("sure", "high_no_digits", "<", 0), C("kept", "other_delta", "<=", 0.010)),
        (("no effect", (), ("overall",)), ("no effect", (), ("no_digits",)), ("no effect", (), ("sure",)),
         ("general improvement", ("kept",), ()), ("domain only", (), ()))),
    "respelled": RuleSet(
        (C("overall", "relative", "<=", -0.20), C("near_previous", "previous_delta", "<=", 0.003), C("kept", "other_delta", "<=", 0.010)),
        (("loses the gain", (), ("overall",)), ("loses the gain", (), ("near_previous",)), ("general", ("kept",), ()), ("spelling is not enough", (), ()))),
    "retry": RuleSet(
        (C("tested", "loops_untested", "==", 0), C("seen", "loops_recorded", ">", 0), C("stops", "loops_left", "==", 0), C("harmless", "worst_high", "<=", 0.001)),
        (("untested", (), ("tested",)), ("untested", (), ("seen",)), ("use", ("stops", "harmless"), ()), ("leave", (), ()))),
    "digits_after": RuleSet(
        (C("harmful", "home_delta", ">", 0.0005), C("helps", "other_high", "<", 0)),
        (("harms at home", ("harmful",), ()), ("use", ("helps",), ()), ("no gain", (), ()))),
    "precision_gate": RuleSet(
        (C("close", "abs_delta", "<=", 0.002), C("no_empty", "empty", "==", 0), C("finite", "nonfinite", "==", 0)),
        (("half precision", ("close", "no_empty", "finite"), ()), ("full precision", (), ()))),
    "sign": RuleSet(
        (C("below", "high", "<", 0), C("above", "low", ">", 0)),
        (("better", ("below",), ()), ("worse", ("above",), ()), ("undecided", (), ()))),
    "two_by_two": RuleSet(
        (C("home", "home_high", "<", 0.001), C("away", "away_high", "<", 0), C("remembers", "forgetting", "<=", 0.010)),
        (("replace", ("home", "away"), ()), ("keep, no gain away", ("home",), ()), ("away only", ("away",), ()), ("keep", (), ()))),
    "engine": RuleSet(
        (C("accurate", "high", "<=", 0.001), C("smaller", "least_memory_cut", ">", 0.20), C("faster", "least_latency_cut", ">", 0.05)),
        (("loses accuracy", (), ("accurate",)), ("switch", ("smaller",), ()), ("switch", ("faster",), ()), ("stay", (), ()))),
}


def verdict(df: DataFrame, rules: str | RuleSet) -> DataFrame:
    return (RULES[rules] if isinstance(rules, str) else rules).apply(df)
