"""Media columns: WAV bytes, short-time Fourier transforms, peak-pair fingerprints.

``to_wav`` stores a payload losslessly as 8-bit mono samples of a RIFF/WAVE file
in a binary column.  ``from_wav`` reads such a column back with the ``wave``
module and adds the payload and its *spectral-peak pairs*: frames of
``FRAME`` samples, ``HOP`` apart, less their mean, under a Hann window; each frame's strongest
bin is a peak if it is at least the file's median peak; each peak is paired
with the next ``FAN_OUT`` peaks at most ``ZONE`` frames later.

Both are narrow maps: no shuffle, one row in, one row out, memory bounded by one
Arrow batch and, for the transform, by ``BLOCK`` frames whatever the file's length.

Defined results: a null payload gives null columns; empty bytes give an empty
WAV and no pairs; equal bytes give equal columns; other columns pass through,
and a clash with an added column's name raises ``ValueError``.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import absent, free, need

FRAME, HOP, FAN_OUT, ZONE, BLOCK = 256, 128, 3, 31, 16_384
#: Samples a second of the stored files.
RATE = 8_000
_WINDOW = np.hanning(FRAME).astype(np.float32)
#: A time code is ``frame << 22 | earlier bin << 14 | later bin << 6 | frames between``.
PAIR_BITS = 22


def wav_bytes(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def wav_payload(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and bins of the spectral peaks of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.pad(x, (0, (frames - 1) * HOP + FRAME - len(x)))
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, power = np.empty(frames, np.int64), np.empty(frames, np.float32)
    for at in range(0, frames, BLOCK):
        block = windows[at : at + BLOCK]
        spectrum = np.fft.rfft((block - block.mean(axis=1, keepdims=True)) * _WINDOW)[:, 1:]
        size = spectrum.real**2 + spectrum.imag**2
        best = size.argmax(axis=1)
        bins[at : at + BLOCK], power[at : at + BLOCK] = best + 1, size[np.arange(len(best)), best]
    kept = np.flatnonzero(power >= np.median(power))
    return kept, bins[kept]


def peak_pairs(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, ascending; a lone peak is paired with itself."""
    at, bins = peaks(samples)
    if len(at) == 1:
        return at << PAIR_BITS | bins << 14 | bins << 6
    found = []
    for step in range(1, FAN_OUT + 1):
        apart = at[step:] - at[:-step]
        near = apart <= ZONE
        found.append((at[:-step] << PAIR_BITS | bins[:-step] << 14 | bins[step:] << 6 | apart)[near])
    return np.sort(np.concatenate(found))


def to_wav(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """Add ``media``: the binary column ``payload`` as a WAV file."""
    need(df, payload)
    absent(df, media)

    @F.pandas_udf("binary")
    def store(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else wav_bytes(bytes(b)))

    return df.withColumn(media, store(F.col(payload)))


def from_wav(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``samples`` (binary, read back) and ``pairs`` (array<bigint>, time-coded)."""
    need(df, media)
    absent(df, "samples", "pairs")
    read = free(df, "_read")

    @F.pandas_udf("samples binary, pairs array<bigint>")
    def load(column: pd.Series) -> pd.DataFrame:
        samples = [None if b is None else wav_payload(bytes(b)) for b in column]
        return pd.DataFrame({"samples": samples, "pairs": [None if s is None else peak_pairs(s) for s in samples]})

    return df.withColumn(read, load(F.col(media))).select(*df.columns, f"{read}.samples", f"{read}.pairs")


def digest(pairs: Column) -> Column:
    """A fingerprint of all time-coded pairs: their number, the hash of the array, and the majority bits of the pairs'
    hashes with the times left out, which shifted copies share."""
    hashes = F.transform(pairs, lambda p: F.xxhash64(p.bitwiseAND(F.lit((1 << PAIR_BITS) - 1))))

    def often(bit: int) -> Column:
        return F.size(F.filter(hashes, lambda h: F.getbit(h, F.lit(bit)) == 1)) * 2 > F.size(hashes)

    # one count a bit: 64 passes over short arrays of numbers
    majority = F.concat(*(F.when(often(bit), F.lit("1")).otherwise(F.lit("0")) for bit in range(63, -1, -1)))
    return F.concat_ws(":", F.size(pairs), F.sha2(F.array_join(pairs, ","), 256), F.lower(F.lpad(F.conv(majority, 2, 16), 16, "0")))
