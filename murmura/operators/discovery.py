"""New voices among known ones, an online baseline, and resampled or wrapped sound."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.operators import vectors
from murmura.session import ship


@dataclass(frozen=True)
class Discovery:
    """A new voice needs so many windows and seconds that are farther than ``far`` from every known one."""

    windows: int = 4
    seconds: float = 6.0
    far: float = 0.65


#: The second, shorter path: fewer windows, but farther away.
SHORT = Discovery(windows=3, seconds=3.2, far=0.68)


def _means(df: DataFrame) -> DataFrame:
    """(session_id, path, rule, windows, mean): the duration-weighted mean, of length 1, of each session's windows of a path, where their rule has enough of them."""
    parts = df.select("session_id", "path", "rule", (F.col("end") - F.col("start")).alias("w"), F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy("session_id", "path", "i").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum("w").alias("s"), F.count("*").alias("n"), F.first("rule").alias("rule"))
    whole = sums.groupBy("session_id", "path").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), *(F.first(c).alias(c) for c in ("n", "s", "rule")))
    enough = whole.filter((F.col("n") >= F.col("rule.windows")) & (F.col("s") >= F.col("rule.seconds")))
    return vectors.normalised(enough.select("session_id", "path", "rule", F.col("n").alias("windows"), F.transform("v", lambda p: p["x"] / F.col("s")).alias("mean")), "mean")


def _found(windows: DataFrame, cents: DataFrame, rules: dict[str, Discovery]) -> DataFrame:
    """(session_id, path, windows, embedding): the new voices by each rule.

    All rules go through the same joins: a window is a row for each rule by which it is far.  A session's centroids travel as one array, so windows
    are joined with sessions and never multiplied by centroids.
    """
    known = cents.groupBy("session_id").agg(F.collect_list("embedding").alias("known"))
    unit = vectors.normalised(windows.select("session_id", "window_id", "start", "end", "embedding"))
    nearest = lambda v: F.array_min(F.transform("known", lambda c: F.round(vectors.distance(v, c), 9)))
    rule = F.explode(F.array(*(F.struct(F.lit(k).alias("path"), F.lit(r.windows).alias("windows"), F.lit(r.seconds).alias("seconds"), F.lit(r.far).alias("far")) for k, r in rules.items())))
    best = unit.join(known, "session_id").withColumn("best", nearest(F.col("embedding"))).drop("known").withColumn("rule", rule)
    far = best.filter(F.col("best") > F.col("rule.far")).select("session_id", F.col("rule.path").alias("path"), "rule", "start", "end", "embedding")
    mean = _means(far).select("session_id", "path", "mean")
    agree = far.join(mean, ["session_id", "path"]).filter(vectors.distance(F.col("embedding"), F.col("mean")) <= F.col("rule.far"))
    found = _means(agree).join(known, "session_id")
    apart = F.array_min(F.transform("known", lambda c: vectors.distance(F.col("mean"), c)))
    return found.filter(apart >= F.col("rule.far")).select("session_id", "path", "windows", F.col("mean").alias("embedding"))


def new_voices(windows: DataFrame, cents: DataFrame, rule: Discovery = Discovery()) -> DataFrame:
    """(session_id, windows, embedding) of the sessions where a voice is heard that no centroid (session_id, cluster, embedding) explains.

    The far windows must agree with their own mean, too, and those that do must still be enough; the
    mean of these is the candidate, and it must be far from every known centroid.
    """
    return _found(windows, cents, {"": rule}).drop("path")


def discover(windows: DataFrame, cents: DataFrame, strict: Discovery = Discovery(), short: Discovery = SHORT) -> DataFrame:
    """New voices by the strict path, and by the short one where the strict one finds none; ``path`` says which."""
    first = F.max_by(F.struct("windows", "embedding", "path"), F.col("path") == "strict")
    return _found(windows, cents, {"strict": strict, "short": short}).groupBy("session_id").agg(first.alias("v")).select("session_id", "v.*")


def fresh_windows(windows: DataFrame) -> DataFrame:
    """Windows that start later than every window before them, in order of arrival (``window_id``), by more than a millisecond."""
    w = Window.partitionBy("session_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("start").over(w)
    return windows.withColumn("_latest", latest).filter(F.col("_latest").isNull() | (F.col("start") > F.col("_latest") + 1e-3)).drop("_latest")


@dataclass(frozen=True)
class Greedy:
    """The online baseline: a window farther than ``match`` + ``margin`` from all opens a speaker if it is long enough."""

    cap: int = 6
    match: float = 0.55
    margin: float = 0.15
    least_new: float = 1.5
    reliable: float = 1.0


def greedy(windows: DataFrame, rule: Greedy = Greedy()) -> DataFrame:
    """(session_id, window_id, cluster): every window is labelled as it comes; a session streams through one task in order.

    Each answer depends on the centroids so far, which SQL can't say; the state is ``cap`` vectors.
    """
    ship(windows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, cents, weights = object(), [], []
        for batch in batches:
            labels = []
            for s, seconds, vector in zip(batch["session_id"], batch["end"] - batch["start"], batch["embedding"], strict=True):
                x = np.asarray(vector, float)
                x = x / max(np.linalg.norm(x), 1e-9)
                if s != session:
                    session, cents, weights = s, [], []
                apart = [1 - float(c @ x) for c in cents]
                near = int(np.argmin(apart)) if apart else -1
                if near < 0 or (len(cents) < rule.cap and seconds >= rule.least_new and apart[near] > rule.match + rule.margin):
                    labels.append(len(cents))
                    cents.append(x)
                    weights.append(seconds if seconds >= rule.reliable else 0.0)
                    continue
                if seconds >= rule.reliable:
                    mixed = cents[near] * weights[near] + x * seconds
                    weights[near] += seconds
                    cents[near] = mixed / max(np.linalg.norm(mixed), 1e-9)
                labels.append(near)
            yield pd.DataFrame({"session_id": batch["session_id"], "window_id": batch["window_id"], "cluster": labels})

    ordered = windows.select("session_id", "window_id", "start", "end", "embedding").repartition("session_id").sortWithinPartitions("session_id", "start", "window_id")
    return ordered.mapInPandas(run, "session_id long, window_id long, cluster int")


def resample(samples: DataFrame, source: int, target: int) -> DataFrame:
    """Sample arrays (key, samples) at another rate, linear between neighbours; DataFrame functions only."""
    step = source / target
    n = F.floor(F.size("samples") / F.lit(step)).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def value(i):
        place = i * F.lit(step)
        low = F.floor(place).cast("int")
        a = F.element_at("samples", low + 1)
        b = F.element_at("samples", F.least(low + 2, F.size("samples")))
        return a + (b - a) * (place - low)

    return samples.withColumn("samples", F.transform(at, value))


def _four_bytes(number):
    """A whole number as four bytes, the lowest first."""
    digits = F.lpad(F.hex(number), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def wav_bytes(sound: DataFrame, rate: int = 16000) -> DataFrame:
    """Adds wav, the bytes of a mono 16-bit WAV file, to rows with ``pcm``."""
    size = F.octet_length("pcm")
    form = F.lit(struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16))
    return sound.withColumn("wav", F.concat(F.lit(b"RIFF"), _four_bytes(size + 36), F.lit(b"WAVEfmt "), form, F.lit(b"data"), _four_bytes(size), F.col("pcm")))
