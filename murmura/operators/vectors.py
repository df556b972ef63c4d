"""Vector operators: distances, centroids, calibration, separation, votes.

Windows have session_id, window_id, start, end and embedding (an array of doubles).  Pairwise
work stays inside a session, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.session import ship


@dataclass(frozen=True)
class Band:
    """Limits of the calibrated distance band."""

    neighbours: int = 5
    margin: float = 0.05
    least: float = 0.22
    most: float = 0.65
    fallback: float = 0.50
    windows: int = 8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalised(df: DataFrame, name: str = "embedding") -> DataFrame:
    """The vectors scaled to length 1; vectors of almost no length stay."""
    size = F.col("_norm")
    return df.withColumn("_norm", norm(F.col(name))).withColumn(name, F.when(size > 1e-9, F.transform(name, lambda x: x / size)).otherwise(F.col(name))).drop("_norm")


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of vectors of length 1."""
    return 1 - dot(a, b)


def nearest_neighbours(windows: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """(session_id, a, b, distance): the ``k`` nearest other windows of each window of its session, the smaller window_id on a tie.

    A session is cut into blocks; each pair of blocks is one task's matrix product, of which only the ``k`` nearest of each
    window leave the task.  So rows grow with windows times blocks, not with pairs, and no task holds a session.
    """
    ship(windows.sparkSession)
    sizes = windows.groupBy("session_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_g"))
    rows = windows.select("session_id", "window_id", F.col("embedding").cast("array<double>").alias("embedding")).join(sizes, "session_id")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("window_id"), F.col("_g")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    rows = rows.select("session_id", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"), F.col("_own").alias("own"), "window_id", "embedding")

    def solve(group: pa.Table) -> pa.Table:
        ids, own = group.column("window_id").to_numpy(), group.column("own").to_numpy()
        v = np.array(group.column("embedding").to_pylist(), float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(size > 1e-9, v / np.maximum(size, 1e-300), v)
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        sides = [(own == x, own == y)] if x == y else [(own == x, own == y), (own == y, own == x)]
        out = []
        for left, right in sides:
            if not left.any() or not right.any():
                continue
            d = 1 - v[left] @ v[right].T
            d[ids[left][:, None] == ids[right][None, :]] = np.inf
            order = np.argsort(ids[right], kind="stable")
            near = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :k]]
            best = np.take_along_axis(d, near, 1)
            i, j = np.nonzero(np.isfinite(best))
            out.append((ids[left][i], ids[right][near[i, j]], best[i, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        session = pa.array([group.column("session_id")[0].as_py()] * len(columns[0]), pa.int64())
        return pa.table([session, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], names=["session_id", "a", "b", "distance"])

    found = rows.groupBy("session_id", "x", "y").applyInArrow(solve, "session_id long, a long, b long, distance double")
    w = Window.partitionBy("session_id", "a").orderBy("distance", "b")
    return found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def knn_spread(windows: DataFrame, k: int = 5) -> DataFrame:
    """Each window's mean distance to its ``k`` nearest neighbours."""
    return nearest_neighbours(windows, k).groupBy("session_id", F.col("a").alias("window_id")).agg(F.avg("distance").alias("spread"))


def calibration(windows: DataFrame, band: Band = Band()) -> DataFrame:
    """The distance below which two windows of a session count as one voice, with the limits that follow from it."""
    spread = knn_spread(windows, band.neighbours).groupBy("session_id").agg(F.percentile("spread", 0.7).alias("p70"), F.count("*").alias("n"))
    same = F.when(F.col("n") < band.windows, band.fallback).otherwise(F.greatest(F.lit(band.least), F.least(F.lit(band.most), F.col("p70") + band.margin)))
    clip = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))
    df = spread.withColumn("same_max", same)
    s = F.col("same_max")
    return df.select(
        "session_id", "n", "p70", "same_max",
        clip(s * 0.1, F.lit(0.03), F.lit(0.10)).alias("ambiguous_margin"),
        clip(s * 1.5, s, F.lit(0.95)).alias("outlier_max"),
        clip(s + 0.05, s, F.lit(0.95)).alias("identity_match_max"),
    )


def core_mask(windows: DataFrame, band: Band = Band(), cap: int = 8) -> DataFrame:
    """Marks the windows near enough to their neighbours to be clustered; where too few are, all."""
    spread = knn_spread(windows, band.neighbours).join(calibration(windows, band).select("session_id", "same_max", "p70", "n"), "session_id")
    core = F.col("spread") <= F.greatest("same_max", "p70")
    kept = F.count_if("core").over(Window.partitionBy("session_id"))
    return spread.withColumn("core", core).withColumn("core", F.col("core") | (kept < F.greatest(F.lit(4), F.lit(2 * cap))))


def centroids(windows: DataFrame, cluster: str) -> DataFrame:
    """The duration-weighted mean of each cluster's vectors, of length 1."""
    parts = windows.select("session_id", cluster, (F.col("end") - F.col("start")).alias("w"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("session_id", cluster, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return normalised(means.groupBy("session_id", cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")))


def nearest(windows: DataFrame, cents: DataFrame, cluster: str) -> DataFrame:
    """Each window's nearest centroid, its distance and the margin to the next; 1 where there is only one."""
    c = cents.select("session_id", F.col(cluster).alias("cluster"), F.col("embedding").alias("_c"))
    d = normalised(windows).join(c, "session_id").select("session_id", "window_id", "cluster", F.round(distance(F.col("embedding"), F.col("_c")), 9).alias("distance"))
    two = d.groupBy("session_id", "window_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "cluster"))), 1, 2).alias("two"))
    margin = F.when(F.size("two") > 1, F.get("two", F.lit(1))["distance"] - F.col("two")[0]["distance"]).otherwise(1.0)
    return two.select("session_id", "window_id", F.col("two")[0]["cluster"].alias("cluster"), F.col("two")[0]["distance"].alias("best"), margin.alias("margin"))


def separation(cents: DataFrame, cluster: str) -> DataFrame:
    """The distance of each session's two closest centroids."""
    a = cents.select("session_id", F.col(cluster).alias("a"), F.col("embedding").alias("va"))
    b = cents.select("session_id", F.col(cluster).alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, "session_id").filter("a < b").groupBy("session_id").agg(F.min(distance(F.col("va"), F.col("vb"))).alias("closest"), F.count("*").alias("pairs"))


def silhouette(windows: DataFrame, cluster: str) -> DataFrame:
    """The duration-weighted silhouette of each session's clusters.

    Means to the other clusters and to the own one (without the window itself) are weighted by
    duration.  A weighted mean of cosine distances to a cluster follows from the sum of its vectors,
    so windows meet clusters, not one another.
    """
    w = F.col("end") - F.col("start")
    unit = normalised(windows.select("session_id", "window_id", F.col(cluster).alias("own"), w.alias("weight"), "embedding"))
    parts = unit.select("session_id", F.col("own").alias("c"), "weight", F.posexplode("embedding").alias("i", "x"))
    sums = parts.groupBy("session_id", "c", "i").agg(F.sum(F.col("x") * F.col("weight")).alias("x"), F.sum("weight").alias("total"))
    sums = sums.groupBy("session_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum"), F.first("total").alias("total"))
    mine = F.col("c") == F.col("own")
    rest = F.col("total") - F.when(mine, F.col("weight")).otherwise(0.0)
    # What the window adds to its own cluster's sum is taken out again.
    near = dot(F.col("embedding"), F.col("sum")) - F.when(mine, F.col("weight") * dot(F.col("embedding"), F.col("embedding"))).otherwise(0.0)
    means = unit.join(sums, "session_id").select("session_id", "window_id", "weight", mine.alias("mine"), F.when(rest > 1e-9, (rest - near) / rest).alias("mean"))
    scored = means.groupBy("session_id", "window_id", "weight").agg(F.max(F.when(F.col("mine"), F.col("mean"))).alias("inside"), F.min(F.when(~F.col("mine"), F.col("mean"))).alias("outside"))
    s = F.when(F.col("inside").isNull() | F.col("outside").isNull(), 0.0).otherwise((F.col("outside") - F.col("inside")) / F.greatest("inside", "outside"))
    return scored.groupBy("session_id").agg((F.sum(s * F.col("weight")) / F.sum("weight")).alias("silhouette"))


def distance_curve(windows: DataFrame, stride: int) -> DataFrame:
    """Each window's distance to the one ``stride`` later."""
    w = Window.partitionBy("session_id").orderBy("start", "window_id")
    later = normalised(windows).withColumn("later", F.lead("embedding", stride).over(w)).filter("later IS NOT NULL")
    return later.select("session_id", "window_id", "start", distance(F.col("embedding"), F.col("later")).alias("distance"))


def strides(windows: DataFrame) -> DataFrame:
    """(session_id, stride): how many windows on the next one is that doesn't overlap, by the medians of a session's window lengths and hops."""
    w = Window.partitionBy("session_id").orderBy("start", "window_id")
    hops = windows.select("session_id", (F.col("end") - F.col("start")).alias("length"), (F.col("start") - F.lag("start").over(w)).alias("hop"))
    medians = hops.groupBy("session_id").agg(F.percentile("length", 0.5).alias("length"), F.percentile("hop", 0.5).alias("hop"))
    stride = F.when(F.col("hop") > 1e-6, F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("hop")))).otherwise(F.lit(1))
    return medians.select("session_id", stride.cast("int").alias("stride"))


def session_curve(windows: DataFrame, gap: float = 0.75) -> DataFrame:
    """(session_id, window_id, at, distance): each window's distance to the next that doesn't overlap it, and the time between them.

    The offset differs by session, so windows meet by rank and not by ``lead``.  Windows with a silence of over ``gap`` seconds between
    them, or that overlap after all, say nothing.
    """
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("start", "window_id"))
    ranked = normalised(windows.select("session_id", "window_id", "start", "end", "embedding")).withColumn("rank", rank)
    a = ranked.join(strides(windows), "session_id").withColumn("rank", F.col("rank") + F.col("stride"))
    b = ranked.select("session_id", "rank", F.col("start").alias("later"), F.col("embedding").alias("other"))
    met = a.join(b, ["session_id", "rank"])
    between = F.col("later") - F.col("end")
    return met.filter((between >= -1e-6) & (between <= gap)).select("session_id", "window_id", ((F.col("end") + F.col("later")) / 2).alias("at"), distance(F.col("embedding"), F.col("other")).alias("distance"))


def prune(sizes: DataFrame, least: float = 4.0, share: float = 0.02, windows: int = 3, cap: int = 8) -> DataFrame:
    """Of clusters (session_id, cluster, seconds, n) those large enough, at most ``cap``; the largest if none is."""
    whole = Window.partitionBy("session_id")
    order = whole.orderBy(F.col("seconds").desc(), "cluster")
    big = (F.col("seconds") >= F.greatest(F.lit(least), share * F.sum("seconds").over(whole))) & (F.col("n") >= windows)
    df = sizes.withColumn("big", big).withColumn("any_big", F.max("big").over(whole)).withColumn("rank", F.row_number().over(order))
    df = df.filter(F.col("big") | (~F.col("any_big") & (F.col("rank") == 1)))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("session_id", "cluster", "seconds", "n")


def frame_votes(labelled: DataFrame, step: float = 0.25, outlier: float = 0.75) -> DataFrame:
    """The winning cluster of each frame of ``step`` seconds.

    ``labelled`` has start, end, cluster, best and margin; a window votes for every frame it
    covers, more in its middle, less if it is unsure or far away.  Ties go to the smaller cluster.
    """
    a, b = F.floor(F.col("start") / step).cast("int"), F.ceil(F.col("end") / step).cast("int") - 1
    centre, half = (F.col("start") + F.col("end")) / 2, (F.col("end") - F.col("start")) / 2
    sure = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("margin") / 0.15)) * F.when(F.col("best") > outlier, 0.3).otherwise(1.0)
    frames = labelled.withColumn("frame", F.explode(F.sequence(a, F.greatest(a, b))))
    off = F.least(F.lit(1.0), F.abs((F.col("frame") + 0.5) * step - centre) / half)
    votes = frames.groupBy("session_id", "frame", "cluster").agg(F.round(F.sum((0.25 + 0.75 * (1 - off)) * sure), 9).alias("votes"))
    return votes.groupBy("session_id", "frame").agg(F.max_by("cluster", F.struct("votes", -F.col("cluster"))).alias("cluster"), F.max("votes").alias("votes"))


def mode_filter(frames: DataFrame, reach: int = 2, least: int = 3) -> DataFrame:
    """Replaces each frame's cluster by the most frequent one around it (the smaller on a tie); negative ones and edges stay."""
    w = Window.partitionBy("session_id").orderBy("frame")
    around = F.filter(F.collect_list("cluster").over(w.rowsBetween(-reach, reach)), lambda c: c >= 0)
    n = F.count("*").over(w.rowsBetween(-reach, reach))
    df = frames.withColumn("_a", F.array_sort(around)).withColumn("_n", n)
    start = F.struct(F.lit(0).alias("best"), F.lit(-1).cast("bigint").alias("which"), F.lit(0).alias("run"), F.lit(-1).cast("bigint").alias("last"))

    def step(acc: Column, c: Column) -> Column:
        run = F.when(c == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(F.greatest(acc["best"], run).alias("best"), F.when(run > acc["best"], c.cast("bigint")).otherwise(acc["which"]).alias("which"), run.alias("run"), c.cast("bigint").alias("last"))

    mode = F.aggregate("_a", start, step, lambda acc: acc["which"])
    use = (F.col("cluster") >= 0) & (F.col("_n") == 2 * reach + 1) & (F.size("_a") >= least)
    return df.withColumn("cluster", F.when(use, mode).otherwise(F.col("cluster")).cast("int")).drop("_a", "_n")
