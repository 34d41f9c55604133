"""Files as tables: parsed blocks, delimited tables with their bad rows, JSON lines, evaluation sets, versioned sets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.sources.parsers import parse


def parsed(files: DataFrame, key: str, name: str, data: str, read: Callable[[str, bytes], list[str]] = parse) -> DataFrame:
    """(key, place, block): the blocks of files that lie in a table, by their names; nulls give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, b) for k, n, d in zip(batch["key"], batch["name"], batch["data"], strict=True) if n is not None and d is not None for i, b in enumerate(read(n, bytes(d)))]
            yield pd.DataFrame(rows, columns=["key", "place", "block"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(data).alias("data")).mapInPandas(run, f"key {kind}, place int, block string").withColumnRenamed("key", key)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, block, error) of all files below a path; a file that can't be parsed has one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, i, block, None) for i, block in enumerate(parse(name, data))]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "place", "block", "error"]).astype({"place": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, place int, block string, error string")


def read_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): rows of a table with a header; rows of another number of fields come out in bad, as they are
    in its column line (which Spark reads only together with other columns)."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_bad", T.StringType())])
    every = spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path)
    return every.where("_bad is null").drop("_bad"), every.where("_bad is not null").withColumnRenamed("_bad", "line")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, valid): each line with its VARIANT value, null where it isn't JSON."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    return lines.select("line", F.try_parse_json("line").alias("value"), F.try_parse_json("line").isNotNull().alias("valid"))


def read_qrels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(query, key, rel) of an evaluation set in Parquet, JSON lines or tab-separated form."""
    schema = "query string, key string, rel int"
    if kind == "parquet":
        return spark.read.parquet(path).select("query", "key", F.col("rel").cast("int").alias("rel"))
    if kind == "jsonl":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).option("sep", "\t").csv(path)


class VersionedSets:
    """Sets of rows under one folder: staged, checked, activated by a pointer, purged when superseded.

    Pointers are small files (name, version, number), the greatest number counts; activation creates the next one, which only one of
    several writers can, and only if the active version is the one that the caller saw.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return self.spark.read.json(f"{self.folder}/pointers").collect()

    def active(self, name: str) -> str | None:
        found = [r for r in self._pointers() if r["name"] == name]
        return max(found, key=lambda r: r["number"])["version"] if found else None

    def stage(self, name: str, rows: DataFrame) -> str:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{name}/{version}")
        return version

    def activate(self, name: str, version: str, expected: str | None, rows: int) -> bool:
        """False, and nothing changed, if the active version isn't the expected one or the set hasn't so many rows."""
        if self.active(name) != expected or self.spark.read.parquet(f"{self.folder}/{name}/{version}").count() != rows:
            return False
        number = max((r["number"] for r in self._pointers() if r["name"] == name), default=0) + 1
        # two writers want the same number: the file can be created only once
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pointers/{name}-{number:09d}.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray((json.dumps({"name": name, "version": version, "number": number}) + "\n").encode()))
        out.close()
        return True

    def read(self, name: str) -> DataFrame:
        version = self.active(name)
        if version is None:
            raise LookupError(f"no active version of {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{version}")

    def purge(self, name: str) -> int:
        """Remove the sets that were active once and are no longer; the number removed. What is staged and not yet active stays."""
        keep = self.active(name)
        before = {r["version"] for r in self._pointers() if r["name"] == name} - {keep}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() in before]
        return sum(bool(fs.delete(p, True)) for p in gone)
