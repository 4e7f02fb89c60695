"""RIFF/WAVE blobs in binary columns as 16-bit samples of one rate."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import resample
from .text import _c

RATE = 16_000
_PCM, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def chunks(blob: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name; one that says it is longer than the blob ends with it."""
    found, at = {}, 12
    while at + 8 <= len(blob):
        size = struct.unpack_from("<I", blob, at + 4)[0]
        found.setdefault(blob[at : at + 4], blob[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def parse(blob: bytes | None) -> tuple[np.ndarray | None, int, str | None]:
    """(frames x channels of -1 to 1, rate, what is wrong): samples are null
    where the blob can't be read."""
    if blob is None:
        return None, 0, "no audio"
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        return None, 0, "not a RIFF/WAVE file"
    parts = chunks(blob)
    form, data = parts.get(b"fmt "), parts.get(b"data")
    if form is None or len(form) < 16:
        return None, 0, "no format chunk"
    if data is None:
        return None, 0, "no data chunk"
    code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
    if code == _EXTENSIBLE and len(form) >= 26:
        code = struct.unpack_from("<H", form, 24)[0]
    width = bits // 8
    if not rate or not channels:
        return None, 0, "no rate or no channels"
    if (code, bits) not in {(_PCM, 8), (_PCM, 16), (_PCM, 24), (_PCM, 32), (_FLOAT, 32), (_FLOAT, 64)}:
        return None, rate, f"format {code} of {bits} bits"
    raw = np.frombuffer(data[: len(data) // (width * channels) * width * channels], np.uint8)
    if code == _FLOAT:
        x = raw.view(f"<f{width}").astype(float)
        if not np.isfinite(x).all():
            return None, rate, "samples that aren't finite"
    elif bits == 8:  # the only unsigned width
        x = (raw.astype(float) - 128) / 128
    else:  # the samples' bytes on top of 32 bits, so the sign is in place
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.view("<i4").ravel() / 2.0**31
    return x.reshape(-1, channels), rate, None


def to_pcm(x: np.ndarray) -> np.ndarray:
    """-1 to 1 as 16-bit samples, rounded half to even and cut to range."""
    return np.clip(np.rint(x * 32768.0), -32768, 32767).astype(np.int16)


def decode(blob, rate: int = RATE) -> Column:
    """struct<samples: array<short>, rate: int, channels: int, reason: string> of
    a WAV blob: the mean of its channels, resampled to ``rate``.

    8-, 16-, 24- and 32-bit samples and floats of 32 and 64 bits are read.  A
    null or damaged blob gives null samples and a reason; a data chunk that is
    cut short gives its whole frames."""
    @F.pandas_udf("samples array<short>, rate int, channels int, reason string")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for b in batch:
            x, own, reason = parse(b)
            rows.append((None, own or None, None, reason) if x is None else (to_pcm(resample(x.mean(axis=1), own, rate)), own, x.shape[1], None))
        return pd.DataFrame(rows, columns=["samples", "rate", "channels", "reason"]).astype({"rate": "Int32", "channels": "Int32"})

    return run(_c(blob))


def _le(x: Column, width: int) -> Column:
    """The hex of an integer's lowest ``width`` bytes, least first."""
    h = F.lpad(F.hex(x.cast("long").bitwiseAND((1 << 8 * width) - 1)), 2 * width, "0")
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))])


def encode(samples, bits: int = 16, rate: int = RATE, channels: int = 1) -> Column:
    """A WAV blob of samples of -1 to 1 (channels in turn), as a built-in
    expression: 8, 16 or 24 bits, rounded half to even and cut to range."""
    top, width = 2.0 ** (bits - 1), bits // 8
    cut = lambda v: F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.rint(v.cast("double") * top))) + (128 if bits == 8 else 0)
    body = F.array_join(F.transform(_c(samples), lambda v: _le(cut(v), width)), "")
    size = F.size(_c(samples)) * width
    lit = lambda x, n: F.lit(x.to_bytes(n, "little").hex())
    head = [F.lit(b"WAVEfmt ".hex()), lit(16, 4), lit(_PCM, 2), lit(channels, 2), lit(rate, 4), lit(rate * channels * width, 4), lit(channels * width, 2), lit(bits, 2), F.lit(b"data".hex())]
    return F.unhex(F.concat(F.lit(b"RIFF".hex()), _le(size + 36, 4), *head, _le(size, 4), body))
