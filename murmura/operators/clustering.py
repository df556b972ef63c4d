"""Speakers of a session from its windows: demote, sample, cluster, choose how many, refine, prune, label, clean up the timeline.

What needs one session's distances at once runs per session on a bounded sample of windows;
everything else (turn boundaries, refinement over all windows, labels, votes, runs) are DataFrame operations (see ``vectors``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions import voices
from murmura.operators import vectors
from murmura.session import ship, written


def sample(windows: DataFrame, cap: int = 800) -> DataFrame:
    """At most ``cap`` windows of each session, evenly spread over time (a stated bound of the method)."""
    w = Window.partitionBy("session_id")
    df = windows.withColumn("_r", F.row_number().over(w.orderBy("start", "window_id")) - 1).withColumn("_n", F.count("*").over(w))
    slot = F.floor(F.col("_r") * cap / F.col("_n"))
    first = F.floor((F.col("_r") - 1) * cap / F.col("_n"))
    return df.filter((F.col("_n") <= cap) | (F.col("_r") == 0) | (slot > first)).drop("_r", "_n")


def cluster_windows(windows: DataFrame, band: vectors.Band = vectors.Band(), cap: int = 8) -> DataFrame:
    """(session_id, window_id, cluster) of the sampled windows; clusters are numbered by their first start."""
    ship(windows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "window_id"]).reset_index(drop=True)
        x = voices.unit(np.stack(pdf["embedding"].to_numpy()))
        seconds = (pdf["end"] - pdf["start"]).to_numpy()
        n, lab = len(x), np.zeros(len(x), int)
        if n >= 3:
            d = np.clip(1 - x @ x.T, 0, 2)
            spread = np.sort(d + np.diag(np.full(n, np.inf)), 1)[:, : min(band.neighbours, n - 1)].mean(1)
            p70 = float(np.percentile(spread, 70))
            same = band.fallback if n < band.windows else min(band.most, max(band.least, p70 + band.margin))
            core = spread <= max(same, p70)
            if core.sum() < max(4, 2 * cap):
                core[:] = True
            found = voices.choose(x[core], seconds[core], same, cap)
            lab = voices.nearest(x, voices.Clusters.of(x[core], seconds[core], found.label, found.label.max() + 1).centres)[0]
        number = {c: i for i, c in enumerate(dict.fromkeys(lab.tolist()))}
        return pd.DataFrame({"session_id": pdf["session_id"], "window_id": pdf["window_id"], "cluster": [number[c] for c in lab.tolist()]})

    return sample(windows).groupBy("session_id").applyInPandas(run, "session_id long, window_id long, cluster int")


def turn_peaks(windows: DataFrame, band: vectors.Band = vectors.Band(), height: float = 0.45, floor: float = 1.30, least: int = 8) -> DataFrame:
    """(session_id, at, distance): where the distance to the next window peaks high enough to be a change of voice.

    A peak is no lower than either neighbour, stands above med + height * (p90 - med) of its session, and above ``floor`` times the distance that
    windows of one voice have there.  Sessions with fewer than ``least`` points, or with a flat curve, have none.
    """
    curve = vectors.session_curve(windows)
    stats = curve.groupBy("session_id").agg(F.percentile("distance", 0.5).alias("med"), F.percentile("distance", 0.9).alias("p90"), F.count("*").alias("n"))
    same = vectors.calibration(windows, band).select("session_id", "same_max")
    w = Window.partitionBy("session_id").orderBy("at", "window_id")
    peaks = curve.withColumns({"before": F.lag("distance").over(w), "after": F.lead("distance").over(w)}).join(stats, "session_id").join(same, "session_id")
    limit = F.greatest(F.col("med") + height * (F.col("p90") - F.col("med")), floor * F.col("same_max"))
    use = (F.col("n") >= least) & (F.col("p90") - F.col("med") >= 1e-6) & (F.col("distance") >= limit) & (F.col("distance") >= F.col("before")) & (F.col("distance") >= F.col("after"))
    return peaks.filter(use).select("session_id", "at", "distance")


def change_points(windows: DataFrame, apart: float = 1.0, **rules) -> DataFrame:
    """``turn_peaks`` of which, of peaks closer than ``apart`` to the last one kept, the higher stays."""
    rows = turn_peaks(windows, **rules).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "distance"))).alias("p"))

    def thin(kept, p):
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (p["at"] - last["at"] < apart)
        replaced = F.array_append(F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1)), p)
        return F.when(near & (p["distance"] > last["distance"]), replaced).when(near, kept).otherwise(F.array_append(kept, p))

    start = F.array().cast("array<struct<at:double,distance:double>>")
    return rows.select("session_id", F.explode(F.aggregate("p", start, thin)).alias("p")).select("session_id", "p.at", "p.distance")


def with_trust(windows: DataFrame, points: DataFrame, seconds: float = 1.8, least: int = 8) -> DataFrame:
    """Adds ``trusted``: long enough, and without a change of voice inside.  A session left with fewer than two goes by length alone.

    Windows and changes meet by session and the whole seconds that a window covers.  Sessions of fewer than ``least`` windows have no changes.
    """
    covered = windows.select("session_id", "window_id", "start", "end", F.explode(F.sequence(F.floor("start"), F.floor("end"))).alias("second"))
    marks = points.select("session_id", "at", F.floor("at").alias("second"))
    mixed = covered.join(marks, ["session_id", "second"]).filter("at >= start AND at < end").select("session_id", "window_id").distinct().withColumn("_mixed", F.lit(True))
    session = Window.partitionBy("session_id")
    long_ = F.col("end") - F.col("start") >= seconds
    df = windows.join(mixed, ["session_id", "window_id"], "left").withColumn("_mixed", F.coalesce("_mixed", F.lit(False)) & (F.count("*").over(session) >= least))
    pure = long_ & ~F.col("_mixed")
    return df.withColumn("_pure", F.count_if(pure).over(session)).withColumn("trusted", F.when(F.col("_pure") >= 2, pure).otherwise(long_)).drop("_mixed", "_pure")


def clearly(windows: DataFrame, cents: DataFrame, bands: DataFrame) -> DataFrame:
    """``windows`` with their nearest cluster and ``clear``: whether it is clearly theirs, by the limits of the session's band."""
    near = vectors.nearest(windows, cents, "cluster").join(bands.select("session_id", "ambiguous_margin", "outlier_max"), "session_id")
    near = near.select("session_id", "window_id", "cluster", ((F.col("margin") >= F.col("ambiguous_margin")) & (F.col("best") <= F.col("outlier_max"))).alias("clear"))
    return windows.join(near, ["session_id", "window_id"])


def refined(windows: DataFrame, cents: DataFrame, bands: DataFrame, rounds: int = 2) -> DataFrame:
    """Centroids (session_id, cluster, embedding) averaged anew over all windows that are clearly theirs, up to ``rounds`` times.

    A session with fewer clear windows than twice its clusters keeps its centroids, and so does a cluster without any; it ends early
    when none moves.  A round is sums over windows, written to the checkpoint folder, so no session's windows meet in a task.
    """
    for _ in range(rounds):
        near = clearly(windows, cents, bands)
        enough = near.groupBy("session_id").agg(F.count_if("clear").alias("clear_ones")).join(cents.groupBy("session_id").agg(F.count("*").alias("k")), "session_id").filter("clear_ones >= 2 * k")
        moved = vectors.centroids(near.filter("clear").join(enough.select("session_id"), "session_id", "left_semi"), "cluster").withColumnRenamed("embedding", "_moved")
        both = written(cents.join(moved, ["session_id", "cluster"], "left"))
        cents = both.select("session_id", "cluster", F.coalesce("_moved", "embedding").alias("embedding"))
        if not both.filter(F.col("_moved").isNotNull() & (vectors.distance(F.col("_moved"), F.col("embedding")) > 1e-12)).limit(1).count():
            break
    return cents


def remapped(windows: DataFrame, cents: DataFrame, bands: DataFrame, least: float = 4.0, share: float = 0.02, few: int = 3, cap: int = 8) -> DataFrame:
    """The centroids of clusters with enough clear sound, ``cap`` at most a session; what others held goes to the nearest of these and moves it."""
    near = clearly(windows, cents, bands)
    seconds = F.when(F.col("clear"), F.col("end") - F.col("start")).otherwise(0.0)
    sizes = near.groupBy("session_id", "cluster").agg(F.sum(seconds).alias("seconds"), F.count("*").alias("n"))
    kept = written(cents.join(vectors.prune(sizes, least, share, few, cap), ["session_id", "cluster"], "left_semi"))
    fewer = cents.groupBy("session_id").agg(F.count("*").alias("k")).join(kept.groupBy("session_id").agg(F.count("*").alias("left_over")), "session_id").filter("left_over < k").select("session_id")
    changed = refined(windows.join(fewer, "session_id", "left_semi"), kept.join(fewer, "session_id", "left_semi"), bands, rounds=1)
    return kept.join(fewer, "session_id", "left_anti").unionByName(changed)


def speakers(windows: DataFrame, band: vectors.Band = vectors.Band(), cap: int = 8) -> DataFrame:
    """All windows with their nearest speaker: (session_id, window_id, cluster, best, margin); speakers are numbered by their first window.

    Windows that straddle a change of voice are demoted, the others clustered on a sample; the clusters are refined over all trusted windows, small ones
    are dropped and their windows remapped; then every window is labelled.
    """
    core = written(with_trust(windows, change_points(windows, band=band))).filter("trusted").drop("trusted")
    clusters = cluster_windows(core, band, cap)
    cents = vectors.centroids(core.join(clusters, ["session_id", "window_id"]), "cluster")
    bands = written(vectors.calibration(core, band))
    cents = remapped(core, refined(core, written(cents), bands), bands, cap=cap)
    # Sessions without a trusted window have no speaker.
    near = vectors.nearest(windows, cents, "cluster").join(windows.select("session_id", "window_id", "start"), ["session_id", "window_id"])
    heard = near.groupBy("session_id", "cluster").agg(F.min(F.struct("start", "window_id")).alias("heard"))
    order = heard.select("session_id", "cluster", (F.row_number().over(Window.partitionBy("session_id").orderBy("heard")) - 1).alias("number"))
    return near.join(order, ["session_id", "cluster"]).select("session_id", "window_id", F.col("number").alias("cluster"), "best", "margin")


def absorb_short(frames: DataFrame, least: int = 3, passes: int = 4) -> DataFrame:
    """Frames (session_id, frame, cluster, votes) with short runs given to a neighbour.

    Each pass takes the shortest run of a session (the first on a tie) and gives it to the neighbouring run
    with more votes (the left on a tie).  Only runs travel, not frames: a run is one row.
    """
    ship(frames.sparkSession)
    w = Window.partitionBy("session_id").orderBy("frame")
    marked = frames.withColumn("_n", F.when((F.lag("cluster").over(w) == F.col("cluster")) & (F.lag("frame").over(w) == F.col("frame") - 1), 0).otherwise(1))
    marked = marked.withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.groupBy("session_id", "_i", "cluster").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.sum("votes").alias("votes"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans = pdf.sort_values("first")[["first", "last", "cluster", "votes"]].to_numpy().tolist()
        for _ in range(passes):
            real = [i for i, s in enumerate(spans) if s[2] >= 0]
            short = [i for i in real if spans[i][1] - spans[i][0] + 1 < least]
            if len(real) < 2 or not short:
                break
            victim = min(short, key=lambda i: (spans[i][1] - spans[i][0], spans[i][0]))
            at = real.index(victim)
            sides = [real[j] for j in (at - 1, at + 1) if 0 <= j < len(real)]
            spans[victim][2] = spans[max(sides, key=lambda i: spans[i][3])][2]
            merged = [spans[0]]
            for s in spans[1:]:
                if s[2] == merged[-1][2] and s[0] == merged[-1][1] + 1:
                    merged[-1] = [merged[-1][0], s[1], s[2], merged[-1][3] + s[3]]
                else:
                    merged.append(s)
            spans = merged
        out = pd.DataFrame(spans, columns=["first", "last", "cluster", "votes"])
        return out.assign(session_id=pdf["session_id"].iloc[0])[["session_id", "first", "last", "cluster"]].astype({"first": "int64", "last": "int64", "cluster": "int32"})

    return rows.groupBy("session_id").applyInPandas(run, "session_id long, first long, last long, cluster int")


def speaker_timeline(windows: DataFrame, step: float = 0.25) -> DataFrame:
    """Who speaks when: labels, votes for frames, a mode filter, short runs absorbed."""
    labelled = speakers(windows).join(windows.select("session_id", "window_id", "start", "end"), ["session_id", "window_id"])
    frames = vectors.mode_filter(vectors.frame_votes(labelled, step))
    found = absorb_short(frames)
    return found.filter("cluster >= 0").select("session_id", (F.col("first") * step).alias("start"), ((F.col("last") + 1) * step).alias("end"), F.col("cluster").alias("speaker"))
