"""Tables that change together: versioned folders, published by one manifest.

``commit`` writes each table to a folder of its own and then one manifest that names, for every table, the folders that make it up.
A manifest is written beside and renamed to its number, which fails if that number is taken.  So readers see all tables of a commit or none of
them: a writer that dies between two tables leaves folders that no manifest names, and of two writers at once the later one fails.

``tag`` makes commits repeatable: one whose tag isn't greater than the last one's does nothing, so a micro-batch that is replayed
(its number is the tag) changes nothing.  A table that is appended to has a folder a commit until ``compact`` makes one of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict:
    """The latest manifest: number, tag and the folders of each table."""
    folder, fs = f"{root}/manifests", _files(spark, root)
    if not fs.exists(_path(spark, folder)):
        return {"number": 0, "tag": None, "tables": {}}
    names = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    number = max((int(n) for n in names if n.isdigit()), default=0)
    if not number:
        return {"number": 0, "tag": None, "tables": {}}
    return json.loads(spark.read.text(f"{folder}/{number:012d}", wholetext=True).first()[0])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], append: tuple[str, ...] = (), tag: int | None = None) -> bool:
    """Write ``tables`` as one version; those in ``append`` add to what is there, the others replace it.  Returns whether there was anything to do."""
    last = manifest(spark, root)
    if tag is not None and last["tag"] is not None and tag <= last["tag"]:
        return False
    found = dict(last["tables"])
    for name, df in tables.items():
        folder = f"{root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        found[name] = [*found.get(name, []), folder] if name in append else [folder]
    _publish(spark, root, {"number": last["number"] + 1, "tag": last["tag"] if tag is None else tag, "tables": found})
    return True


def _publish(spark: SparkSession, root: str, content: dict) -> None:
    fs, jvm = _files(spark, root), spark._jvm
    draft, final = (_path(spark, f"{root}/manifests/{n}") for n in (f".draft-{uuid.uuid4().hex}", f"{content['number']:012d}"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.valueOf("NONE")  # not over a manifest of another writer
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), how)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the latest manifest."""
    return spark.read.parquet(*manifest(spark, root)["tables"][name])


def compact(spark: SparkSession, root: str, name: str) -> None:
    """Make one folder of a table's many; the old ones stay for readers that still use them."""
    commit(spark, root, {name: read(spark, root, name)})


def each_batch(root: str, name: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is appended to a table once, however often it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        commit(batch.sparkSession, root, {name: batch}, append=(name,), tag=number)

    return write
