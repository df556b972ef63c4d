"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmura.operators import clustering, intervals, vectors as op
from murmura.sources import adapters as src


def windows(spark, sf_dir):
    return src.windows(spark, sf_dir)


def r6(name):
    return F.bround(name, 6).alias(name)


def knn_spread(spark, sf_dir):
    return op.knn_spread(windows(spark, sf_dir)).select("session_id", "window_id", r6("spread"))


def calibration_band(spark, sf_dir):
    return op.calibration(windows(spark, sf_dir)).select("session_id", "n", *map(r6, ("p70", "same_max", "ambiguous_margin", "outlier_max", "identity_match_max")))


def core_mask(spark, sf_dir):
    return op.core_mask(windows(spark, sf_dir)).select("session_id", "window_id", "core")


def label_centroids(spark, sf_dir):
    return op.centroids(windows(spark, sf_dir), "label").select("session_id", "label", F.posexplode("embedding").alias("i", "x")).select("session_id", "label", "i", r6("x"))


def nearest_centroid(spark, sf_dir):
    w = windows(spark, sf_dir)
    return op.nearest(w, op.centroids(w, "label"), "label").select("session_id", "window_id", "cluster", r6("best"), r6("margin"))


def centroid_separation(spark, sf_dir):
    return op.separation(op.centroids(windows(spark, sf_dir), "label"), "label").select("session_id", r6("closest"), "pairs")


def weighted_silhouette(spark, sf_dir):
    return op.silhouette(windows(spark, sf_dir), "label").select("session_id", r6("silhouette"))


def distance_curve(spark, sf_dir):
    return op.distance_curve(windows(spark, sf_dir), 3).select("session_id", "window_id", r6("distance"))


def two_geometries(spark, sf_dir):
    """Windows of 2 s in even sessions, of 1.4 s in odd ones: strides of 3 and 2."""
    return windows(spark, sf_dir).withColumn("end", F.when(F.col("session_id") % 2 == 0, F.col("end")).otherwise(F.col("start") + 1.4))


def session_curve(spark, sf_dir):
    return op.session_curve(two_geometries(spark, sf_dir)).select("session_id", "window_id", r6("at"), r6("distance"))


def turn_peaks(spark, sf_dir):
    return clustering.turn_peaks(two_geometries(spark, sf_dir)).select("session_id", r6("at"), r6("distance"))


def cluster_prune_cap(spark, sf_dir):
    sizes = windows(spark, sf_dir).groupBy("session_id", F.col("label").alias("cluster")).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("n"))
    return op.prune(sizes, least=8.0, share=0.08, cap=4)


def labelled(spark, sf_dir):
    w = windows(spark, sf_dir)
    return op.nearest(w, op.centroids(w, "label"), "label").join(w.select("session_id", "window_id", "start", "end"), ["session_id", "window_id"])


def frame_votes(spark, sf_dir):
    return op.frame_votes(labelled(spark, sf_dir)).select("session_id", "frame", "cluster", r6("votes"))


def timeline_runs(spark, sf_dir):
    frames = op.mode_filter(op.frame_votes(labelled(spark, sf_dir)))
    return intervals.runs(frames, "frame", "cluster")


_UNIT = """
unit AS (SELECT session_id, window_id, start, "end", label, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS v FROM windows)"""
_PAIRS = _UNIT + """, pairs AS (
  SELECT a.session_id, a.window_id AS a, b.window_id AS b, 1 - list_dot_product(a.v, b.v) AS d FROM unit a JOIN unit b ON a.session_id = b.session_id AND a.window_id <> b.window_id
)"""
_SPREAD = _PAIRS + """, near AS (SELECT *, row_number() OVER (PARTITION BY session_id, a ORDER BY d, b) AS r FROM pairs),
spread AS (SELECT session_id, a AS window_id, avg(d) AS spread FROM near WHERE r <= 5 GROUP BY session_id, a)"""
_BAND = _SPREAD + """, p AS (SELECT session_id, quantile_cont(spread, 0.7) AS p70, count(*) AS n FROM spread GROUP BY session_id),
band AS (SELECT *, CASE WHEN n < 8 THEN 0.5e0 ELSE greatest(0.22e0, least(0.65e0, p70 + 0.05e0)) END AS s FROM p)"""
_CENTS = """
parts AS (SELECT session_id, label, "end" - start AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM windows),
means AS (SELECT session_id, label, i, sum(x * w) / sum(w) AS x FROM parts GROUP BY ALL),
raw AS (SELECT session_id, label, list(x ORDER BY i) AS v FROM means GROUP BY ALL),
cents AS (SELECT session_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw)"""
_NEAREST = _UNIT + "," + _CENTS + """, dist AS (
  SELECT u.session_id, window_id, u.start, u."end", c.label AS cluster, round(1 - list_dot_product(u.v, c.v), 9) AS d FROM unit u JOIN cents c USING (session_id)
), rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, window_id ORDER BY d, cluster) AS r, lead(d) OVER (PARTITION BY session_id, window_id ORDER BY d, cluster) AS nx FROM dist),
nearest AS (SELECT session_id, window_id, start, "end", cluster, d AS best, coalesce(nx - d, 1e0) AS margin FROM rk WHERE r = 1)"""
_VOTES = _NEAREST + """, fr AS (
  SELECT *, unnest(range(floor(start / 0.25e0)::BIGINT, greatest(floor(start / 0.25e0), ceil("end" / 0.25e0) - 1)::BIGINT + 1)) AS frame FROM nearest
), vo AS (
  SELECT session_id, frame, cluster, round(sum((0.25e0 + 0.75e0 * (1 - least(1e0, abs((frame + 0.5e0) * 0.25e0 - (start + "end") / 2) / (("end" - start) / 2))))
         * greatest(0.25e0, least(1e0, margin / 0.15e0)) * CASE WHEN best > 0.75e0 THEN 0.3e0 ELSE 1e0 END), 9) AS votes FROM fr GROUP BY ALL
), win AS (SELECT session_id, frame::INT AS frame, arg_max(cluster, (votes, -cluster)) AS cluster, max(votes) AS votes FROM vo GROUP BY session_id, frame)"""

_GEOMETRIES = """
two AS (SELECT session_id, window_id, start, CASE WHEN session_id % 2 = 0 THEN "end" ELSE start + 1.4e0 END AS "end" FROM windows)"""
_CURVE = _GEOMETRIES + """, hops AS (SELECT *, start - lag(start) OVER (PARTITION BY session_id ORDER BY start, window_id) AS hop FROM two),
stride AS (SELECT session_id, CASE WHEN h > 1e-6 THEN greatest(1, ceil(l / h)) ELSE 1 END::INT AS k FROM (SELECT session_id, quantile_cont("end" - start, 0.5) AS l, quantile_cont(hop, 0.5) AS h FROM hops GROUP BY session_id)),
rk AS (SELECT two.*, v, row_number() OVER (PARTITION BY session_id ORDER BY two.start, window_id) AS r FROM two JOIN (SELECT session_id, window_id, v FROM unit) USING (session_id, window_id)),
curve AS (
  SELECT a.session_id, a.window_id, (a."end" + b.start) / 2 AS curve_at, 1 - list_dot_product(a.v, b.v) AS distance
  FROM rk a JOIN stride USING (session_id) JOIN rk b ON b.session_id = a.session_id AND b.r = a.r + k WHERE b.start - a."end" BETWEEN -1e-6 AND 0.75e0
)"""


def _sql(body: str, select: str) -> str:
    return src.with_sql("windows", f"WITH {body.strip()} {select}")


_R = "round_even({0}, 6) AS {0}".format

QUERIES = {f.__name__: f for f in (knn_spread, calibration_band, core_mask, label_centroids, nearest_centroid, centroid_separation, weighted_silhouette, distance_curve, session_curve, turn_peaks, cluster_prune_cap, frame_votes, timeline_runs)}

SQL = {
    "knn_spread": _sql(_SPREAD, f"SELECT session_id, window_id, {_R('spread')} FROM spread"),
    "calibration_band": _sql(_BAND, """SELECT session_id, n, round_even(p70, 6) AS p70, round_even(s, 6) AS same_max, round_even(greatest(0.03e0, least(0.1e0, s * 0.1e0)), 6) AS ambiguous_margin,
       round_even(greatest(s, least(0.95e0, s * 1.5e0)), 6) AS outlier_max, round_even(greatest(s, least(0.95e0, s + 0.05e0)), 6) AS identity_match_max FROM band"""),
    "core_mask": _sql(_BAND, """, c AS (SELECT session_id, window_id, spread <= greatest(s, p70) AS core FROM spread JOIN band USING (session_id))
SELECT session_id, window_id, core OR count(*) FILTER (WHERE core) OVER (PARTITION BY session_id) < 16 AS core FROM c"""),
    "label_centroids": _sql(_CENTS, ", u AS (SELECT session_id, label, (generate_subscripts(v, 1) - 1)::INT AS i, unnest(v) AS x FROM cents) SELECT session_id, label, i, round_even(x, 6) AS x FROM u"),
    "nearest_centroid": _sql(_NEAREST, f"SELECT session_id, window_id, cluster, round_even(best, 6) + 0e0 AS best, round_even(margin, 6) + 0e0 AS margin FROM nearest"),
    "centroid_separation": _sql(_CENTS, "SELECT a.session_id, round_even(min(1 - list_dot_product(a.v, b.v)), 6) AS closest, count(*) AS pairs FROM cents a JOIN cents b ON a.session_id = b.session_id AND a.label < b.label GROUP BY a.session_id"),
    "weighted_silhouette": _sql(_PAIRS, """, m AS (
  SELECT p.session_id, p.a, u.label AS c, sum(d * (u."end" - u.start)) / sum(u."end" - u.start) AS mean FROM pairs p JOIN unit u ON u.session_id = p.session_id AND u.window_id = p.b GROUP BY ALL
), s AS (
  SELECT m.session_id, m.a, any_value(o."end" - o.start) AS w, max(mean) FILTER (WHERE c = o.label) AS i, min(mean) FILTER (WHERE c <> o.label) AS x
  FROM m JOIN unit o ON o.session_id = m.session_id AND o.window_id = m.a GROUP BY m.session_id, m.a
)
SELECT session_id, round_even(sum(w * CASE WHEN i IS NULL OR x IS NULL THEN 0e0 ELSE (x - i) / greatest(i, x) END) / sum(w), 6) AS silhouette FROM s GROUP BY session_id"""),
    "distance_curve": _sql(_UNIT, """, l AS (SELECT *, lead(v, 3) OVER (PARTITION BY session_id ORDER BY start, window_id) AS later FROM unit)
SELECT session_id, window_id, round_even(1 - list_dot_product(v, later), 6) AS distance FROM l WHERE later IS NOT NULL"""),
    "session_curve": _sql(_UNIT + "," + _CURVE, f"""SELECT session_id, window_id, round_even(curve_at, 6) AS "at", {_R('distance')} FROM curve"""),
    "turn_peaks": _sql(_BAND + "," + _CURVE, f""", st AS (SELECT session_id, quantile_cont(distance, 0.5) AS med, quantile_cont(distance, 0.9) AS p90, count(*) AS k FROM curve GROUP BY session_id),
nb AS (SELECT *, lag(distance) OVER o AS before, lead(distance) OVER o AS after FROM curve WINDOW o AS (PARTITION BY session_id ORDER BY curve_at, window_id))
SELECT session_id, round_even(curve_at, 6) AS "at", {_R('distance')} FROM nb JOIN st USING (session_id) JOIN band USING (session_id)
WHERE k >= 8 AND p90 - med >= 1e-6 AND distance >= greatest(med + 0.45e0 * (p90 - med), 1.3e0 * s) AND distance >= before AND distance >= after"""),
    "cluster_prune_cap": src.with_sql("windows", """WITH c AS (SELECT session_id, label AS cluster, sum("end" - start) AS seconds, count(*) AS n FROM windows GROUP BY ALL),
b AS (SELECT *, seconds >= greatest(8e0, 0.08e0 * sum(seconds) OVER (PARTITION BY session_id)) AND n >= 3 AS big, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, cluster) AS r FROM c),
k AS (SELECT *, bool_or(big) OVER (PARTITION BY session_id) AS found FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, cluster) AS q FROM k WHERE big OR NOT found AND r = 1)
SELECT session_id, cluster, seconds, n FROM f WHERE q <= 4"""),
    "frame_votes": _sql(_VOTES, f"SELECT session_id, frame, cluster, {_R('votes')} FROM win"),
    "timeline_runs": _sql(_VOTES, """, nb AS (
  SELECT a.session_id, a.frame, any_value(a.cluster) AS own, list(b.cluster) AS around FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame) AS n FROM win) a JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame) AS n FROM win) b
  ON a.session_id = b.session_id AND b.n BETWEEN a.n - 2 AND a.n + 2 GROUP BY a.session_id, a.frame
), ct AS (SELECT session_id, frame, c, count(*) AS k FROM (SELECT session_id, frame, unnest(around) AS c FROM nb) GROUP BY ALL),
md AS (SELECT session_id, frame, arg_max(c, (k, -c)) AS mode FROM ct GROUP BY ALL),
fi AS (SELECT nb.session_id, nb.frame, CASE WHEN len(around) = 5 THEN mode ELSE own END AS cluster FROM nb JOIN md USING (session_id, frame)),
br AS (SELECT *, CASE WHEN cluster = lag(cluster) OVER (PARTITION BY session_id ORDER BY frame) THEN 0 ELSE 1 END AS b FROM fi),
il AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM br)
SELECT session_id, cluster, min(frame)::BIGINT AS first, max(frame)::BIGINT AS last FROM il GROUP BY session_id, island, cluster"""),
}
