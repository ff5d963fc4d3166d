"""Sound files: their header, frames of a span, and digests of spans, in Arrow batches over ``binaryFile`` rows.

Uncompressed WAV is read by the standard library; other formats need a decoder of yours (see ``decode``).
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INFO = "struct<rate:int,channels:int,frames:bigint,error:string>"
#: Samples in the middle of a span that its digest is made of.
PROBE = 100
Decoder = Callable[[bytes], tuple[int, np.ndarray]]


def scan(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``path, length, content`` of the sound files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples as rows of channels, -1 to 1)."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels = f.getsampwidth(), f.getnchannels()
        raw = f.readframes(f.getnframes())
        rate = f.getframerate()
    if width == 3:
        bytes_ = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((bytes_[:, 0] | bytes_[:, 1] << 8 | bytes_[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.int64) - (128 if width == 1 else 0)
    return rate, (x / float(1 << (8 * width - 1))).reshape(-1, channels)


def encode_wav(rate: int, samples: np.ndarray) -> bytes:
    """16-bit WAV of rows of channels."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def info(content: Column) -> Column:
    """Rate, channels and frames of a WAV file, or an error."""

    @F.pandas_udf(INFO)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for data in files:
                try:
                    with wave.open(io.BytesIO(data)) as f:
                        rows.append((f.getframerate(), f.getnchannels(), f.getnframes(), None))
                except (wave.Error, EOFError, TypeError) as e:
                    rows.append((None, None, None, str(e) or "no sound"))
            yield pd.DataFrame(rows, columns=["rate", "channels", "frames", "error"])

    return run(content)


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=1)


def span(samples: np.ndarray, rate: int, start_ms: int, end_ms: int) -> np.ndarray:
    """Samples of a span; empty where it begins beyond the end."""
    return samples[int(round(start_ms * rate / 1000)) : int(round(end_ms * rate / 1000))]


def digest(samples: np.ndarray) -> str:
    """SHA-256 of the number of samples and of the PROBE ones in the middle."""
    middle = len(samples) // 2
    probe = samples[max(0, middle - PROBE // 2) : middle + PROBE // 2].astype("<f4")
    return hashlib.sha256(f"{len(samples)}|".encode() + probe.tobytes()).hexdigest()


def span_digests(files: DataFrame, spans: DataFrame, decode: Decoder = decode_wav) -> DataFrame:
    """``path, group, frames, digest`` of the spans (path, group, start_ms, end_ms) of files (path, content): the sound's
    part of an alignment's cache key.  A file is decoded once for all of its spans."""
    per = spans.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("group", "start_ms", "end_ms"))).alias("spans"))

    @F.pandas_udf("array<struct<group:bigint,frames:bigint,digest:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for files_, groups in batches:
            rows = []
            for data, own in zip(files_, groups, strict=True):
                rate, samples = decode(data)
                one = mono(samples)
                cut = [(x["group"], span(one, rate, x["start_ms"], x["end_ms"])) for x in own]
                rows.append([{"group": g, "frames": len(c), "digest": digest(c)} for g, c in cut])
            yield pd.Series(rows, dtype=object)

    return files.join(per, "path").select("path", F.explode(run("content", "spans")).alias("x")).select("path", "x.*")
