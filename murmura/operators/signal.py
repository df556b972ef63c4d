"""Sound: energy, speech against music, from 16-bit mono PCM in a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.session import ship

# What speech and what music measures, by feature.
ANCHORS = {"low_energy": (0.22, 0.04), "syllables": (0.34, 0.10), "crossings": (0.055, 0.012), "flux": (0.95, 0.35)}
FIELDS = "rms double, seconds double, low_energy double, syllables double, crossings double, flux double, music double, confident boolean"


def measure(pcm: bytes | None, rate: int) -> dict[str, float | bool]:
    """Energy and music score of one piece of sound; too short ones are not confident, an odd last byte is left."""
    pcm = pcm or b""
    x = np.frombuffer(pcm, "<i2", len(pcm) // 2).astype(np.float64)
    out = {"rms": float(np.sqrt(np.mean(x * x))) if len(x) else 0.0, "seconds": len(x) / rate, "confident": len(x) >= 1.5 * rate, "music": 0.0} | dict.fromkeys(ANCHORS, 0.0)
    width, hop = int(0.025 * rate), int(0.010 * rate)
    count = 1 + (len(x) - width) // hop
    if len(x) < 0.2 * rate or count < 8:
        return out | {"confident": False}
    frames = np.lib.stride_tricks.sliding_window_view(x / 32768, width)[::hop]
    energy = np.sqrt((frames**2).mean(1) + 1e-12)
    swing = np.abs(np.fft.rfft((energy - energy.mean()) * np.hanning(count)))
    hz = np.fft.rfftfreq(count, 0.010)
    around = swing[(hz >= 0.5) & (hz <= 20)].sum()
    shape = np.abs(np.fft.rfft(frames * np.hanning(width), axis=1))
    shape /= np.maximum(shape.sum(1, keepdims=True), 1e-9)
    change = np.sqrt((np.diff(shape, axis=0) ** 2).sum(1))
    found = {
        "low_energy": float((energy < 0.5 * energy.mean()).mean()),
        "syllables": float(swing[(hz >= 3) & (hz <= 6)].sum() / around) if around > 1e-9 else 0.0,
        "crossings": float((np.diff(np.sign(frames), axis=1) != 0).mean(1).std()),
        "flux": float(change.std() / change.mean()) if change.mean() > 1e-9 else 0.0,
    }
    score = np.mean([np.clip((v - ANCHORS[k][0]) / (ANCHORS[k][1] - ANCHORS[k][0]), 0, 1) for k, v in found.items()])
    return out | found | {"music": float(score)}


def features(sound: DataFrame, rate: int = 16000) -> DataFrame:
    """Adds the measures to rows with a column ``pcm``, which is left out."""
    ship(sound.sparkSession)
    kept = [c for c in sound.columns if c != "pcm"]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(p, rate) for p in batch["pcm"]], columns=names)
            yield pd.concat([batch[kept].reset_index(drop=True), found], axis=1)

    schema = ", ".join([*(f"`{c}` {sound.schema[c].dataType.simpleString()}" for c in kept), FIELDS])
    return sound.mapInPandas(run, schema)


def gate(measured: DataFrame, least_rms: float = 120.0, music: float = 0.60, mode: str = "drop") -> DataFrame:
    """What is kept: loud enough, and no music where the score is confident; mode ``off`` and ``log`` keep music."""
    is_music = F.lit(mode == "drop") & F.col("confident") & (F.col("music") >= music)
    return measured.withColumn("verdict", F.when(F.col("rms") < least_rms, "quiet").when(is_music, "music").otherwise("keep"))


def tones(spark, pieces: int, seconds: float = 2.0, rate: int = 16000) -> DataFrame:
    """Synthetic voices and notes (piece, kind, pcm): a tone that swells four times a second, a steady chord, near silence."""
    ship(spark)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.arange(int(seconds * rate)) / rate
        for batch in batches:
            rows = []
            for p in batch["id"]:
                base = 110 + 10 * (p % 9)
                kind = ("voice", "chord", "silence")[p % 3]
                if kind == "voice":
                    x = np.sin(2 * np.pi * base * t) * (0.5 + 0.5 * np.sin(2 * np.pi * 4 * t)) ** 2 + 0.05 * np.sin(2 * np.pi * 3100 * t) * (np.sin(2 * np.pi * 4 * t) < -0.5)
                else:
                    x = sum(np.sin(2 * np.pi * base * m * t) for m in (1, 1.25, 1.5)) / 3 * (1 if kind == "chord" else 1e-3)
                rows.append((p, kind, (x * 12000).astype(np.int16).tobytes()))
            yield pd.DataFrame(rows, columns=["piece", "kind", "pcm"])

    return spark.range(pieces).mapInPandas(make, "piece long, kind string, pcm binary")
