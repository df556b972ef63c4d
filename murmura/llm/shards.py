"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks and shards.  A key descends it: at each level every
child draws -ln(u) / weight, where u is a hash of the key and the child's name as a number in
(0, 1], and the smallest draw wins.  A child's weight is the sum of its shards' weights.  If
weights change, a child's draw changes only with its own weight, so keys move only into or out
of the subtrees that changed.  A new shard opens a region of its own, so that growth by one moves keys
into that shard alone and none between old ones (law ``key``).

A shard's rows get slots 0, 1, 2 ... without a gap.  Equal rows are counted before any
shuffle, and shards are numbered in many buckets with offsets, so no task holds a whole shard.

Edge cases: a null doc_id is a key of its own; a null text has size 8 and the checksum of the
empty string; repeated rows share a shard and get a slot each; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import table

#: Shards in a full rack, racks in a full region.
RACK, RACKS = 4, 2
#: Buckets in which a shard's rows are numbered; each is a task's worth at most.
BUCKETS = 1024

Tree = list[list[list[tuple[int, float]]]]


def tree(weights: list[float], grown: list[float] = ()) -> Tree:
    """Regions of racks of (shard, weight): full regions for ``weights``, one more region for each shard in ``grown``."""
    shards = list(enumerate(weights))
    racks = [shards[i : i + RACK] for i in range(0, len(shards), RACK)]
    regions = [racks[i : i + RACKS] for i in range(0, len(racks), RACKS)]
    return regions + [[[(len(weights) + i, w)]] for i, w in enumerate(grown)]


def _draw(key: Column, names: list[str], weights: list[float]) -> Column:
    """The number of the child with the smallest draw; equal draws go to the first name."""
    if len(names) == 1:
        return F.lit(0)

    def draw(name: str, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + 1) / F.lit(float(1 << 53))
        return -F.log(u) / F.lit(float(weight))

    return F.array_min(F.array(*(F.struct(draw(n, w).alias("draw"), F.lit(n).alias("name"), F.lit(i).alias("at")) for i, (n, w) in enumerate(zip(names, weights, strict=True)))))["at"]


def _weight(node: list | tuple) -> float:
    return sum(map(_weight, node)) if isinstance(node, list) else node[1]


def _cases(at: Column, values: list[Column]) -> Column:
    """``values[at]``, of which only that one is computed."""
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(at == i, v).otherwise(out)
    return out


def place(rows: DataFrame, key: str, layout: Tree, name: str) -> DataFrame:
    """``rows`` with ``name``, the shard of their key: a region is drawn, then a rack of it, then a shard of that.

    Each level is a column of its own, so that a row makes the draws among the children of one node a level, and no others.
    """
    #: The nodes of a level with their names, in the order in which the level's column counts them.
    nodes: list[tuple[str, list]] = [("", [r for r in layout if _weight(r) > 0])]
    at, extra = F.lit(0), []
    for level in ("region", "rack", "shard"):
        first = [sum(len(c) for _, c in nodes[:i]) for i in range(len(nodes))]
        picks = [F.lit(n) + _draw(F.col(key), [f"{path}/{i}" for i in range(len(c))], [_weight(x) for x in c]) for n, (path, c) in zip(first, nodes, strict=True)]
        extra.append(f"{name}_{level}")
        rows = rows.withColumn(extra[-1], _cases(at, picks))
        at = F.col(extra[-1])
        nodes = [(f"{path}/{i}", x) for path, c in nodes for i, x in enumerate(c)]
    shards = F.array(*(F.lit(x[0]) for _, x in nodes))
    return rows.withColumn(name, F.element_at(shards, at + 1)).drop(*extra)


def assign(docs: DataFrame, weights: list[float]) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Equal rows become one with a count, then each gets its share of slots.
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    mean = sum(weights) / max(1, len(weights))
    rows = place(place(rows, "doc_id", tree(weights), "shard"), "doc_id", tree(weights, [mean]), "grown_shard")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int"))
    whole = Window.partitionBy("shard").orderBy("bucket")
    offsets = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m")).select("shard", "bucket", (F.sum("m").over(whole) - F.col("m")).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    first = F.sum("n").over(within) - F.col("n")
    # At most BUCKETS rows a shard, whatever the size of the table.
    placed = rows.withColumn("first", first).join(F.broadcast(offsets), ["shard", "bucket"])
    slots = F.explode(F.sequence(F.col("offset") + F.col("first"), F.col("offset") + F.col("first") + F.col("n") - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", slots, "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), [1.0] * 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
