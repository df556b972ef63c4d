"""Reports over scored runs and logs: purity, summaries, verdicts, lost speech, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.service import share


def purity(labelled: DataFrame, truth: str, guess: str) -> DataFrame:
    """The share of each session's rows that hold the most frequent true label of their guess."""
    counts = labelled.groupBy("session_id", guess, truth).agg(F.count("*").alias("n"))
    best = counts.groupBy("session_id", guess).agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy("session_id").agg(F.bround(F.sum("best") / F.sum("n"), 6).alias("purity"), F.count("*").alias("clusters"))


def run_status(runs: DataFrame) -> DataFrame:
    """Adds status to scenario runs (has_audio, error, error_rate): missing, error, ok, or counted if only speakers could be counted."""
    status = F.when(~F.col("has_audio"), "missing").when(F.col("error").isNotNull(), "error").when(F.col("error_rate").isNull(), "counted").otherwise("ok")
    return runs.withColumn("status", status)


def problem_runs(runs: DataFrame) -> DataFrame:
    """Runs that are missing or failed, or count speakers wrongly, one a row."""
    problem = F.when(F.col("status").isin("missing", "error"), F.col("status")).when(F.col("speakers") != F.col("true_speakers"), "wrong_count")
    return runs.withColumn("problem", problem).filter("problem IS NOT NULL")


def summary(runs: DataFrame, by: str, limit: float) -> DataFrame:
    """Mean error of scored runs, how many count speakers wrongly or are missing, and whether a run is over the limit."""
    scored = F.col("status") == "ok"
    return runs.groupBy(by).agg(
        F.bround(F.avg(F.when(scored, F.col("error_rate"))), 6).alias("mean_error"),
        F.count_if(F.col("status").isin("ok", "counted") & (F.col("speakers") != F.col("true_speakers"))).alias("n_wrong"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.coalesce(F.bool_or(scored & (F.col("error_rate") > limit)), F.lit(False)).alias("over_limit"),
    )


def comparison(runs: DataFrame, candidates: list[str]) -> DataFrame:
    """One row a scenario: each candidate's error, the one with the least (the first by name on a tie), and its lead."""
    errors = runs.filter("error_rate IS NOT NULL").groupBy("run_id").pivot("candidate", candidates).agg(F.min("error_rate"))
    ranked = F.array_sort(F.filter(F.array(*(F.struct(F.col(c).alias("e"), F.lit(c).alias("c")) for c in candidates)), lambda s: s["e"].isNotNull()))
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return errors.select("run_id", *candidates, first["c"].alias("best"), F.bround(second["e"] - first["e"], 6).alias("lead"))


def verdict(final: Column, live: Column, threshold: float = 0.2, gap: float = 0.05) -> tuple[Column, Column]:
    """Where errors come from: the model if the final pass is bad too, the stitching if only the live one is; and whether the gap is worth a note."""
    kind = F.when((final <= threshold) & (live <= threshold), "both_ok").when((final <= threshold) & (live > threshold), "stitching").when((final > threshold) & (live > threshold), "model").otherwise("odd")
    return kind, F.abs(final - live) >= gap


def lost_speech(events: DataFrame, lossy: list[str]) -> DataFrame:
    """Sessions with their segments that were created and never finished, and whether speech is lost: by those or by a lossy guard."""
    created, finished = F.col("kind") == "created", F.col("kind") == "finished"
    segments = events.groupBy("session_id", "segment_id").agg(F.bool_or(created).alias("c"), F.bool_or(finished).alias("f"), F.bool_or(F.coalesce(F.col("reason").isin(*lossy), F.lit(False))).alias("l"))
    return segments.groupBy("session_id").agg(F.count_if("c").alias("created"), F.count_if(F.col("c") & ~F.col("f")).alias("unfinished"), F.bool_or(F.col("l") | (F.col("c") & ~F.col("f"))).alias("lost"))


def stretched(rows: DataFrame, order: list[str]) -> DataFrame:
    """Sessions whose silhouette has fallen below 0.7 of the first while the closest distance has grown."""
    at = F.struct(*order)
    first = {c: F.min_by(c, at) for c in ("silhouette", "closest")}
    last = {c: F.max_by(c, at) for c in ("silhouette", "closest")}
    return rows.groupBy("session_id").agg(((last["silhouette"] < first["silhouette"] * 0.7) & (last["closest"] > first["closest"])).alias("stretched"))


def snapshot(chunks: DataFrame) -> DataFrame:
    """One row a session: its chunks, recordings, speakers, words' characters and length."""
    return chunks.groupBy("session_id").agg(
        F.count("*").alias("chunks"),
        F.countDistinct("recording").alias("recordings"),
        F.countDistinct("speaker").alias("speakers"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
        F.bround(F.max("end") - F.min("start"), 3).alias("seconds"),
    )


def utilisation(used: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Used against allowed, as a share of three places; 0 where nothing is allowed."""
    return limits.join(used, key, "left").select(key, F.coalesce("live", F.lit(0)).cast("long").alias("live"), "max_sessions", F.bround(share(F.coalesce("live", F.lit(0)), F.col("max_sessions")), 3).alias("utilisation"))


def json_lines(events: DataFrame, fields: list[str]) -> DataFrame:
    """Log lines as JSON (null fields left out) and for a console."""
    present = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    return events.select("event_id", F.to_json(F.struct(*fields)).alias("json"), F.concat_ws(" ", *map(present, fields)).alias("console"))


def band_blend(bands: DataFrame, alpha: float = 0.25) -> DataFrame:
    """The last blended band of each session: fresh sides pull the band by ``alpha``, unmeasured ones leave it.

    Bands are one row a pass, so a session's are few: they are folded as an array in order of ``pass``.
    """
    passes = bands.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pass", "near", "far"))).alias("passes"))
    none = F.lit(None).cast("double")

    def side(old: Column, new: Column) -> Column:
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(old * (1 - alpha) + new * alpha)

    folded = F.aggregate("passes", F.struct(none.alias("near"), none.alias("far")), lambda acc, p: F.struct(side(acc["near"], p["near"]).alias("near"), side(acc["far"], p["far"]).alias("far")))
    return passes.select("session_id", folded.alias("band")).select("session_id", F.bround("band.near", 6).alias("near"), F.bround("band.far", 6).alias("far"))


def straddling(windows: DataFrame, boundaries: DataFrame, margin: float = 0.4, least: int = 8) -> DataFrame:
    """Adds straddles: whether a turn's boundary lies inside a window, off its ends; sessions of few windows have none.

    Windows and boundaries meet by session and the whole seconds a window covers.
    """
    near = windows.select("session_id", "window_id", "start", "end", F.explode(F.sequence(F.floor("start"), F.floor("end"))).alias("second"))
    marks = boundaries.select("session_id", "at", F.floor("at").alias("second"))
    hit = near.join(marks, ["session_id", "second"]).filter((F.col("at") > F.col("start") + margin) & (F.col("at") < F.col("end") - margin)).select("session_id", "window_id").distinct().withColumn("_hit", F.lit(True))
    n = F.count("*").over(Window.partitionBy("session_id"))
    return windows.join(hit, ["session_id", "window_id"], "left").withColumn("straddles", F.coalesce("_hit", F.lit(False)) & (n >= least)).drop("_hit")
