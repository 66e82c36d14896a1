"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did
    (a cluster whose nodes lack that folder needs the package by --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark (any store that Spark can open)."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """Rows no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], max_rows: int = 512, max_bytes: int = 2 << 20,
           text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that one slice holds few rows and few bytes
    (a single longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        lo, acc = 0, 0
        for i, n in enumerate(sizes):
            if i > lo and (acc + n > max_bytes or i - lo >= max_rows):
                yield batch.slice(lo, i - lo)
                lo, acc = i, 0
            acc += n
        yield batch.slice(lo)


def map_texts(docs: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: pa.Schema,
              ddl: str, **cut) -> DataFrame:
    """Apply ``make`` (slice -> columns) to every slice of the rows."""
    def run(batches):
        for part in slices(batches, **cut):
            yield pa.RecordBatch.from_pydict(make(part), schema=schema)
    return docs.mapInArrow(run, ddl)
