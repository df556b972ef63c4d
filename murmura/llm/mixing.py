"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest.

Targets.  Sources in the order of their code points (null last) weigh ``weights``, repeated, and share the words of all documents.
A target stops at ``most`` times its source's words; the excess is shared anew by weight until no target is above.

Copies.  Each document of a source is to be taken m times on average: the source's target by its words, or, with a column of
``worth``, in proportion to it and ``most`` times at most.  floor(m) copies are certain; the rest of m is the document's inclusion
probability p in one sample of its source.  That sample is drawn by Pareto order: documents are ranked by the odds of a random number,
u / (1 - u), over the odds of inclusion, p / (1 - p), and taken in that order until the sample has its size, in words.
Documents that are large against the sample (over 1 / ``FINE`` of it) are ranked and taken first, the others then fill what is missing;
at the end one document, of the size nearest to what is still lacking, is taken in or left out.  So the sample misses its size by a part of a
small document, if the source has enough of them.

Scale.  Texts are counted in the scan; what is shuffled is a few numbers a document.  Ranks are made in ``BUCKETS`` buckets of a source's
random numbers, with the buckets' sums before them, so a source that holds most rows is spread over tasks.  Repeated rows are
counted before any shuffle and numbered after it.  Sources are ranked in ranges, not in one task.

Edge cases: a null or empty text has size 0 and takes no words; a null source is a source of its own, the last; rows of equal doc_id, size and
source count as copies with a number each; a null doc_id draws as an empty string; a source without words has target 0; ties in rank go by doc_id and
copy; worth counts in thousandths; a null or negative one is 0; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import cut, table

#: Buckets of a source's random numbers.
BUCKETS = 1024
#: A document over this part of its source's sample is ranked with the large ones.
FINE = 256
#: Most sources that are sent to every task; more are joined by a shuffle.
FEW = 20_000
#: Inclusion probabilities are whole parts of this.
PARTS = 1_000_000_000
WIDE = "decimal(38,0)"
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, worth: str | None = None) -> DataFrame:
    """(doc_id, source, size, worth, n): each distinct row of these with its number; size counts words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    value = F.lit(1.0) if worth is None else F.floor(F.greatest(F.lit(0.0), F.coalesce(F.col(worth).cast("double"), F.lit(0.0))) * 1000) / 1000
    return docs.select("doc_id", "source", size.alias("size"), value.alias("worth")).groupBy("doc_id", "source", "size", "worth").agg(F.count("*").alias("n"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number from 0 by code point, null last: numbered within ranges, with the ranges' counts before."""
    ranges = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    # A row for each partition, not for each source.
    before = ranges.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("place", within).join(before, "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def shared_out(parts: DataFrame, pool: str, weight: str, cap: str, total: DataFrame) -> DataFrame:
    """``parts`` with ``rate``: within each pool, least(cap, rate * weight) sums up to the pool's ``total`` (pool, total).

    Shares over their cap stop there and the others share what is left, until none is above.  A round is an aggregate; one number comes back from it.
    """
    start = parts.join(total, pool).withColumn("rate", F.lit(0.0))
    while True:
        full = F.col("rate") * F.col(weight) > F.col(cap)
        exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,6)")), F.lit(0)).cast("double")  # noqa: E731  whatever the order of tasks
        rest = F.first("total") - exact(F.when(full, F.col(cap)))
        free = exact(F.when(~full, F.col(weight)))
        # Where all are full, or nothing weighs, the rate stays.
        rates = start.groupBy(pool).agg(F.when(free > 0, rest / free).otherwise(F.first("rate")).alias("next"))
        grown = cut(start.join(rates, pool))
        again = grown.filter((F.col("next") * F.col(weight) > F.col(cap)) & ~full).limit(1).count()
        start = grown.withColumn("rate", F.col("next")).drop("next")
        if not again:
            return start.drop("total")


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """(source, source_size, target) from ``measured`` rows."""
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = ranked(sources).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    # Written, so that the pool is a column to join on and not a literal, which would make a cross join.
    parts = cut(sources.withColumns({"pool": F.lit(0), "cap": F.col("source_size") * float(most)}))
    whole = parts.groupBy("pool").agg(F.sum("source_size").cast("double").alias("total"))
    found = shared_out(parts, "pool", "weight", "cap", whole)
    return found.select("source", "source_size", F.least(F.col("cap"), F.col("rate") * F.col("weight")).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the digest of ``parts``."""
    digits = F.conv(F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 13), 16, 10).cast("long")
    return (digits + 0.5) / F.lit(float(1 << 52))


def expected(rows: DataFrame, found: DataFrame, most: float = 3, worth: bool = False) -> DataFrame:
    """``measured`` rows with their source's columns and ``m``, the copies expected of each; ``found`` are the sources' targets."""
    if not worth:
        levels = found.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    else:
        levels = rows.groupBy("source", "worth").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
        levels = levels.select(F.struct("source").alias("pool"), "worth", (F.col("worth") * F.col("words")).alias("weight"), (F.col("words") * float(most)).alias("cap"))
        rated = shared_out(levels, "pool", "weight", "cap", found.select(F.struct("source").alias("pool"), F.col("target").alias("total")))
        levels = found.join(rated.groupBy(F.col("pool.source").alias("rated")).agg(F.max("rate").alias("rate")), F.expr("source <=> rated")).drop("rated")
    levels = cut(levels.withColumnRenamed("source", "its"))
    if levels.count() <= FEW:
        levels = F.broadcast(levels)
    return rows.join(levels, F.expr("source <=> its")).withColumn("m", F.least(F.lit(float(most)), F.col("rate") * F.col("worth"))).drop("its", "rate")


def fill(ranks: DataFrame, goals: DataFrame) -> DataFrame:
    """``ranks`` (stratum, bucket, order, size ...) with ``once``: in their order up to the stratum's ``goal``, as near as whole documents come to it.

    Goals are in words times ``PARTS``, as whole numbers, so that sums don't depend on the order of tasks.
    """
    sums = ranks.groupBy("stratum", "bucket").agg(F.sum("size").alias("words"))
    whole = Window.partitionBy("stratum").orderBy("bucket")
    # BUCKETS rows a stratum at most.
    sums = sums.select("stratum", "bucket", (F.sum("words").over(whole) - F.col("words")).alias("before")).join(goals, "stratum")
    within = Window.partitionBy("stratum", "bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("before") + F.sum("size").over(within)) - F.col("size")
    return ranks.join(sums, ["stratum", "bucket"]).withColumn("once", middle.cast(WIDE) * PARTS <= 2 * F.col("goal")).drop("before", "goal")


def last_one(drawn: DataFrame) -> DataFrame:
    """``drawn`` rows with one document of a source, of the size nearest to what its sample still lacks (or has too much), taken in (or left out)."""
    drawn = cut(drawn)
    size = F.col("size").cast(WIDE) * PARTS
    lacks = drawn.groupBy(F.col("source").alias("its")).agg(F.sum(F.col("p").cast(WIDE) * F.col("size") - F.when(F.col("once"), size).otherwise(0)).cast(WIDE).alias("lacks"))
    useful = (F.col("once") == (F.col("lacks") < 0)) & (size < 2 * F.abs("lacks")) & (F.col("size") > 0)
    off = F.abs(size - F.abs("lacks"))
    chosen = drawn.join(lacks, F.expr("source <=> its")).filter(useful).groupBy("its").agg(F.min_by("order", F.struct(off.alias("off"), "order")).alias("chosen"))
    return drawn.join(chosen, F.expr("source <=> its AND order = chosen"), "left").withColumn("once", F.col("once") != F.col("chosen").isNotNull()).drop("its", "chosen")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, worth: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of each row of ``docs``."""
    rows = cut(measured(docs, worth))
    plan = expected(rows, targets(rows, weights, most), most, worth is not None)
    plan = plan.withColumn("certain", F.floor("m")).withColumn("p", F.floor((F.col("m") - F.col("certain")) * PARTS)).drop("m", "worth")
    wanted = F.sum(F.col("p").cast(WIDE) * F.col("size") * F.col("n")).cast(WIDE)
    sample = cut(plan.groupBy("source").agg(wanted.alias("sample")).withColumnRenamed("source", "its"))
    if sample.count() <= FEW:
        sample = F.broadcast(sample)
    each = plan.join(sample, F.expr("source <=> its")).drop("its").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    kept = ["doc_id", "source", "size", "source_size", "target", "certain"]
    # Nothing beyond their certain copies is due to these.
    settled = each.filter("p = 0").select(*kept, F.lit(False).alias("once"))
    odds = lambda x: x / (1 - x)
    rank = odds(uniform(F.lit(seed), F.col("doc_id"), F.col("copy"))) / odds(F.col("p") / PARTS)
    # Where p is equal in a source, a bucket holds an equal share of the random numbers; else it holds what is near in rank.
    mean = F.col("sample").cast("double") / PARTS / F.greatest(F.lit(1), F.col("source_size"))
    even = F.col("rank") * odds(F.least(F.lit(0.999), F.greatest(F.lit(0.001), mean)))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(even / (1 + even) * BUCKETS)).cast("int")
    stratum = F.struct("source", (F.col("size").cast(WIDE) * (FINE * PARTS) > F.col("sample")).alias("large"))
    open_ = each.filter("p > 0").withColumn("rank", rank).select(*kept, "p", stratum.alias("stratum"), bucket.alias("bucket"), F.struct("rank", "doc_id", "copy").alias("order"))
    open_ = cut(open_)
    due = F.sum(F.col("p").cast(WIDE) * F.col("size")).cast(WIDE)
    asked = cut(open_.groupBy("stratum").agg(due.alias("goal")))
    large = cut(fill(open_.filter("stratum.large"), asked))
    off = large.groupBy(F.col("source").alias("its")).agg(F.sum(F.when(F.col("once"), F.col("size")).otherwise(0).cast(WIDE) * PARTS - F.col("p").cast(WIDE) * F.col("size")).cast(WIDE).alias("off"))
    rest = asked.filter("NOT stratum.large").join(off, F.expr("stratum.source <=> its"), "left").select("stratum", (F.col("goal") - F.coalesce("off", F.lit(0))).cast(WIDE).alias("goal"))
    small = fill(open_.filter("NOT stratum.large"), rest)
    out = settled.unionByName(last_one(large.unionByName(small)).select(*kept, "once"))
    copies = (F.col("certain") + F.col("once").cast("long")).alias("copies")
    return out.select(*kept[:-1], copies, (copies * F.col("size")).alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END::DOUBLE AS w, 3.0::DOUBLE * sum(size) AS cap
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER f AS rn, sum(source_size) OVER ()::DOUBLE AS total, sum(w) OVER () AS all_w, sum(w) OVER f - w AS w_before, sum(cap) OVER f - cap AS cap_before
  FROM s WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), r AS (
  SELECT (total - cap_before) / (all_w - w_before) AS rate FROM o WHERE (total - cap_before) / (all_w - w_before) * w <= cap ORDER BY rn LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, rate * w) AS target, CASE WHEN source_size > 0 THEN least(3.0, least(cap, rate * w) / source_size) ELSE 0.0 END AS m FROM s, r
), e AS (
  SELECT d.*, t.source_size, t.target, floor(m)::BIGINT AS certain, floor((m - floor(m)) * 1000000000)::BIGINT AS p, row_number() OVER (PARTITION BY d.doc_id, d.source, d.size) AS copy
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, (('0x' || sha256('1:' || coalesce(doc_id::VARCHAR, '') || ':' || copy)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u, p / 1000000000.0::DOUBLE AS q,
         size::HUGEINT * 256 * 1000000000 > sum(p::HUGEINT * size) OVER (PARTITION BY source) AS large
  FROM e
), a AS (
  SELECT *, sum(size) OVER (PARTITION BY source, large ORDER BY (u / (1 - u)) / (q / (1 - q)), doc_id NULLS FIRST, copy ROWS UNBOUNDED PRECEDING) AS upto, sum(p::HUGEINT * size) OVER (PARTITION BY source, large) AS goal
  FROM k WHERE p > 0
), l AS (
  SELECT *, (2 * upto - size)::HUGEINT * 1000000000 <= 2 * goal AS once FROM a WHERE large
), off AS (
  SELECT source, sum(CASE WHEN once THEN size ELSE 0 END)::HUGEINT * 1000000000 - any_value(goal) AS off FROM l GROUP BY source
), b AS (
  SELECT a.*, (2 * upto - size)::HUGEINT * 1000000000 <= 2 * (goal - coalesce(off, 0)) AS once FROM a LEFT JOIN off ON a.source IS NOT DISTINCT FROM off.source WHERE NOT large
), z AS (
  SELECT *, sum(p::HUGEINT * size - CASE WHEN once THEN size ELSE 0 END::HUGEINT * 1000000000) OVER (PARTITION BY source) AS lacks FROM (SELECT * FROM l UNION ALL BY NAME SELECT * FROM b)
), y AS (
  SELECT *, once = (lacks < 0) AND size::HUGEINT * 1000000000 < 2 * abs(lacks) AND size > 0 AS useful FROM z
), v AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT useful, abs(size::HUGEINT * 1000000000 - abs(lacks)), (u / (1 - u)) / (q / (1 - q)), doc_id NULLS FIRST, copy) = 1 AND useful AS chosen FROM y
)
SELECT doc_id, size, source_size, target, (certain * size)::BIGINT AS taken FROM k WHERE p = 0
UNION ALL SELECT doc_id, size, source_size, target, ((certain + (once <> chosen)::INT) * size)::BIGINT FROM v
"""
