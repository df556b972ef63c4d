"""Fill-in-middle examples, cut at unit boundaries by relations over units.

A text is a sequence of units (code points by default, or what a pattern matches; a code point that begins no
unit is a unit of its own).  The work is relational:

1. the matches of a text are exploded with their position; a match takes up to ``RUN`` consecutive units, so that
   there is a row for each run and not for each unit;
2. window sums over a text's runs give the units and the code points before each run;
3. requests (a text and a unit ordinal) are joined to the runs of that text, and the run that holds the ordinal answers;
   inside it the units up to the ordinal are matched once more;
4. the answers of a text are aggregated into one row of offsets;
5. the offsets are joined to the texts, and ``substring`` cuts them.

Runs and requests carry a text's key (a digest of doc_id and text) and numbers; whole texts are shuffled once, by step 5.
One document's runs are the largest group of a task: its code points by ``RUN`` at most.

``transform`` decides by hashes of the doc_id alone, so reruns agree.  Edge cases: a null text is empty; an empty text,
one that holds a mark, and a share of the others stay plain; rows of equal doc_id and text get equal results, rows of equal doc_id
and different texts each their own; a null doc_id hashes as an empty string; very long texts are cut whole; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmura.llm.common import table

#: Most units in one run.
RUN = 1024
#: Patterns of units are read with the flag (?s).
CODE_POINT = "."
# The marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

def keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id and text of each row; null texts are empty.  Rows of one key have one doc_id and one text."""
    text = F.coalesce("text", F.lit(""))
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return docs.select(F.md5(F.concat(who, F.lit("\n"), text).cast("binary")).alias("key"), "doc_id", text.alias("text"))


def runs(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(key, at, size, units_before, length_before, n): the runs of each text of ``keyed`` rows.

    ``size`` has a run's doc_id, its units and its length in code points; ``n`` counts all units of the text.
    """
    one = CODE_POINT if unit == CODE_POINT else f"(?:{unit}|{CODE_POINT})"
    # Possessive, so that a run is matched in one loop and never given back.
    matches = F.regexp_extract_all("text", F.lit(f"(?s){one}{{1,{RUN}}}+"), 0)
    units = F.length("run") if unit == CODE_POINT else F.regexp_count("run", F.lit(f"(?s){one}"))
    size = F.struct("doc_id", units.cast("long").alias("units"), F.length("run").cast("long").alias("length"))
    # Repeated rows have equal runs.  One column for all that follows, so that both readers of these rows share one exchange.
    rows = docs.select("key", "doc_id", F.posexplode(matches).alias("at", "run")).groupBy("key", "at").agg(F.first(size).alias("size"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda what, frame: F.coalesce(F.sum(F.col("size")[what]).over(frame), F.lit(0))
    return rows.select("key", "at", "size", total("units", before).alias("units_before"), total("length", before).alias("length_before"), total("units", whole).alias("n"))


def answer(found: DataFrame, requests: DataFrame) -> DataFrame:
    """The run that holds the last unit before each cut.

    ``requests`` (key, name, cut) ask for the place after ``cut`` units; returns (key, name, run_offset, run_length, skip):
    the cut is behind ``skip`` units of the run that begins after run_offset code points.  A cut of 0 is in the first run, behind none.
    """
    r = found.select(F.col("key").alias("text_key"), "at", "size", "units_before", "length_before")
    here = (F.col("cut") > F.col("units_before")) & (F.col("cut") <= F.col("units_before") + F.col("size.units")) | (F.col("cut") == 0) & (F.col("at") == 0)
    joined = r.join(requests, (F.col("text_key") == F.col("key")) & here)
    return joined.select("key", "name", F.col("length_before").alias("run_offset"), F.col("size.length").alias("run_length"), (F.col("cut") - F.col("units_before")).alias("skip"))


def offsets(answers: DataFrame, names: list[str]) -> DataFrame:
    """One row a text: a struct (run_offset, run_length, skip) for each of ``names``."""
    place = F.struct("run_offset", "run_length", "skip")
    return answers.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, place)).alias(n) for n in names))


def cut_at(text: Column, place: Column, unit: str = CODE_POINT) -> Column:
    """The code points of ``text`` before a cut; 0 where there is none."""
    run = F.substring(text, (place["run_offset"] + 1).cast("int"), place["run_length"].cast("int"))
    if unit == CODE_POINT:
        inside = F.least(place["skip"], place["run_length"])
    else:
        inside = F.length(F.regexp_substr(run, F.concat(F.lit(rf"(?s)\A(?:{unit}|{CODE_POINT}){{"), place["skip"].cast("string"), F.lit("}+"))))
    return F.when(place.isNull() | (place["skip"] == 0), F.coalesce(place["run_offset"], F.lit(0))).otherwise(place["run_offset"] + inside)


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers from the digest of the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def requested(found: DataFrame, seed: int = 1) -> DataFrame:
    """Two cuts for each text, drawn from its doc_id: after the prefix and after the middle."""
    h1, h2, *_ = draws(F.col("size.doc_id"), seed)
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cuts = F.map_from_arrays(F.array(F.lit("prefix"), F.lit("middle")), F.array(F.least(a, b), F.greatest(a, b)))
    return found.filter("at = 0").select("key", F.explode(cuts).alias("name", "cut"))


def transform(docs: DataFrame, plain_percent: int = 10, spm_percent: int = 20, unit: str = CODE_POINT, seed: int = 1) -> DataFrame:
    """doc_id, text, form (plain, psm or spm), prefix_chars, middle_chars and output of each row of ``docs``."""
    rows = keyed(docs)
    # A plain text needs no cut.
    *_, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.greatest(*(F.instr("text", m) for m in (PREFIX, SUFFIX, MIDDLE))) > 0
    plain = (F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    found = runs(rows.filter(~plain), unit)
    places = offsets(answer(found, requested(found, seed)), ["prefix", "middle"])
    joined = rows.join(places.hint("shuffle_hash"), "key", "left").withColumns({"form": form, "a": cut_at(F.col("text"), F.col("prefix"), unit), "b": cut_at(F.col("text"), F.col("middle"), unit)})
    shape = F.col("form")
    joined = joined.select("doc_id", "text", "form", *(F.when(shape != "plain", c).cast("long").alias(n) for c, n in ((F.col("a"), "prefix_chars"), (F.col("b") - F.col("a"), "middle_chars"))))
    a, b = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return joined.withColumn("output", F.when(shape == "plain", text).when(shape == "psm", psm).otherwise(spm))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from; its marks are the only ones, since texts that hold one stay plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), x AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM x
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
