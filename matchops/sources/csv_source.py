"""CSV ingest (A1, A2, A4): header table, all-string read by name, file ordinal."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from matchops.config import Config, DEFAULT

_CORRUPT = "_corrupt_record"
_AT_ONCE = 100  # files whose first lines one job reads


class MissingColumnsError(ValueError):
    pass


def header_table(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their first line, files and lines in order.

    One line a file is read, many files by one job; files without a line are
    left out.  Like a file listing it is as long as the list of files.
    """
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found: dict[str, list[str]] = defaultdict(list)
    for lo in range(0, len(files), _AT_ONCE):
        firsts = [spark.read.text(f).limit(1).select(F.lit(f).alias("file"), "value") for f in files[lo:lo + _AT_ONCE]]
        for r in sorted(reduce(DataFrame.unionByName, firsts).collect()):
            found[r.value.rstrip("\r")].append(r.file)
    return dict(found)


def _plain(path: str) -> str:
    """One form for the ways Spark writes a path."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _open_quotes(line):
    """Has a line an odd number of quotes, so that a field may go on below?"""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def multi_line_files(spark: SparkSession, files: list[str]) -> set[str]:
    """Files with a line that leaves a quote open (one look at the lines, no parsing)."""
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), "value")
    return {_plain(r.file) for r in lines.where(_open_quotes(F.col("value"))).select("file").distinct().collect()}


def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("nullValue", "\u0000")        # keep empty text; tokens are mapped later
        .option("emptyValue", "")
    )


def header_columns(spark: SparkSession, file: str, multi_line: bool = False) -> list[str]:
    """Column names of one file (no data scan)."""
    return _reader(spark, multi_line).csv(file).columns


def _group(spark: SparkSession, files: list[str], cols: list[str], multi_line: bool) -> DataFrame:
    """Files of one header, every column as text, with the ordinal."""
    schema = StructType()
    for c in [*cols, _CORRUPT]:
        schema = schema.add(c, StringType(), True)
    df = _reader(spark, multi_line).schema(schema).option("columnNameOfCorruptRecord", _CORRUPT).csv(files)
    if not multi_line:
        df = df.withColumn("player_id", F.when(_open_quotes(F.col(_CORRUPT)), F.raise_error(F.concat(
            F.lit("a quoted field goes over a line end, read with multi_line=True: "), F.col(_CORRUPT)))).otherwise(F.col("player_id")))
    return df.select(
        *cols,
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("ingest_seq"),
    )


def read_raw(spark: SparkSession, path: str, cfg: Config = DEFAULT, multi_line: bool | None = None) -> DataFrame:
    """Every column as STRING plus ``ingest_seq``.

    ``ingest_seq`` orders rows like reading the files one after another:
    (file path, split start, position within the split).  Columns are taken by
    name: files of one header are read together, groups of other headers are
    joined on, and a column that a file lacks is NULL there.  Every file must
    have the required columns.

    Quoted fields may contain commas, doubled quotes and line ends.  Files
    whose lines all close their quotes are split over tasks; only the others
    are read by one task each.  ``multi_line`` says beforehand which it is:
    True reads every file by one task, False skips the look at the lines, and
    a field that goes over a line end is then an error.
    """
    groups = []
    for files in header_table(spark, path).values():
        whole = set(files) if multi_line else set() if multi_line is False else multi_line_files(spark, files)
        cols = header_columns(spark, files[0], bool(whole))
        missing = [c for c in cfg.required_columns if c not in cols]
        if missing:
            raise MissingColumnsError(f"Missing required columns in CSV: {missing} ({files[0]})")
        for kind in (False, True):
            chosen = [f for f in files if (f in whole or _plain(f) in whole) == kind]
            if chosen:
                groups.append(_group(spark, chosen, cols, kind))
    if not groups:
        raise MissingColumnsError(f"Missing required columns in CSV: {list(cfg.required_columns)} (no header in {path})")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), groups)
