"""Sample arrays: the mu-law channel and windows, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import bandpass, filter_both_ways, resample
from .text import _c

MU = 255.0


def mu_law_code(x) -> Column:
    """The 8-bit code (0 to 255) of a sample, which is cut to -1..1."""
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(x).cast("double")))
    pressed = F.signum(x) * F.log1p(MU * F.abs(x)) / F.log1p(F.lit(MU))
    return F.rint((pressed + 1) / 2 * 255)


def mu_law_roundtrip(x) -> Column:
    """A sample after 8-bit mu-law coding and back."""
    y = mu_law_code(x) / 255 * 2 - 1
    return F.signum(y) * F.expm1(F.abs(y) * F.log1p(F.lit(MU))) / MU


def pcm_to_float(x) -> Column:
    """16-bit samples as floats of -1..1."""
    return F.transform(_c(x), lambda v: (v / 32768.0).cast("float"))


def float_to_pcm(x) -> Column:
    """Floats as 16-bit samples, rounded half to even and cut to range."""
    return F.transform(_c(x), lambda v: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(v * 32768.0))).cast("short"))


def first_window(x, seconds: int = 30, rate: int = 16_000) -> Column:
    return F.slice(_c(x), 1, seconds * rate)


def _mu_law(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -1, 1)
    codes = np.rint((np.sign(x) * np.log1p(MU * abs(x)) / np.log1p(MU) + 1) / 2 * 255) / 255 * 2 - 1
    return np.sign(codes) * np.expm1(abs(codes) * np.log1p(MU)) / MU


def telephone_samples(x: np.ndarray, rate: int = 16_000) -> np.ndarray:
    """``x`` as a narrow telephone line would give it back, at the same rate."""
    if len(x) < 64:
        return x.astype(np.float32)
    band = filter_both_ways(x, bandpass(4, 300.0, 3400.0, float(rate)))
    narrow = _mu_law(resample(band, 2, 1))
    return resample(narrow, 1, 2)[: len(x)].astype(np.float32)


def telephone(x) -> Column:
    """16 kHz samples through a narrow telephone band: a fourth-order band-pass
    of 300 to 3400 Hz forwards and backwards, half the rate, mu-law codes, and
    the old rate again.  Below 64 samples nothing changes; null stays null."""
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if v is None else telephone_samples(np.asarray(v, float)))

    return run(_c(x))


#: Channels by name: column -> column.
CHANNELS = {"telephone": telephone}


def generated_length(tokens, end_ids: list[int]) -> Column:
    """(tokens before the first end id, whether there was none)."""
    first = F.array_min(F.filter(F.array(*[F.nullif(F.array_position(_c(tokens), F.lit(e)), F.lit(0)) for e in end_ids]), lambda p: p.isNotNull()))
    return F.struct(F.coalesce(first - 1, F.size(_c(tokens)).cast("long")).alias("n"), first.isNull().alias("hit_limit"))
