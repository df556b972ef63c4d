"""Readers: speaker annotations (two text formats), scenario manifests, logs, WAV files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmura.session import ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("line"))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def rttm(lines: DataFrame) -> DataFrame:
    """Turns of lines ``SPEAKER file 1 start duration x x name``; lines with bad numbers or too few fields are skipped."""
    f = F.split("line", r"(?U)\s+")
    start, length = _number(F.get(f, F.lit(3))), _number(F.get(f, F.lit(4)))
    turns = lines.filter(F.upper(F.get(f, F.lit(0))) == "SPEAKER").filter(F.size(f) >= 8)
    return turns.select("file", start.alias("start"), (start + length).alias("end"), F.get(f, F.lit(7)).alias("speaker")).filter("end > start")


def label_lines(lines: DataFrame) -> DataFrame:
    """Turns of lines ``start end speaker``, split by commas, tabs or spaces; ``#`` begins a comment, names may hold spaces."""
    body = F.trim(F.regexp_replace("line", "#.*$", ""))
    f = F.split(F.regexp_replace(body, r"(?U)[,\s]+", " "), " ")
    name = F.array_join(F.slice(f, 3, 1 << 20), " ")
    return lines.select("file", _number(F.get(f, F.lit(0))).alias("start"), _number(F.get(f, F.lit(1))).alias("end"), name.alias("speaker")).filter("end > start AND speaker <> ''")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Turns of all files: a file with any SPEAKER line is of the first format, else of the second."""
    lines = _lines(spark, path)
    marked = lines.groupBy("file").agg(F.max(F.upper("line").startswith("SPEAKER ")).alias("is_rttm"))
    both = lines.join(marked, "file")
    return rttm(both.filter("is_rttm").drop("is_rttm")).unionByName(label_lines(both.filter("NOT is_rttm").drop("is_rttm")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The scenarios of a JSON manifest, one a row."""
    return spark.read.json(path, multiLine=True).select(F.explode("scenarios").alias("s")).select("s.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of logs with their file; bytes that are no UTF-8 are replaced."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def wav(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, seconds, pcm) of mono 16-bit WAV files of the given rate; others are left out."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, rate):
                            out.append((name, w.getnframes() / rate, w.readframes(w.getnframes())))
                except (wave.Error, EOFError):
                    continue
            yield pd.DataFrame(out, columns=["path", "seconds", "pcm"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, seconds double, pcm binary")
