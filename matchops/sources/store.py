"""Versioned tables: batches of several writers, newest row per key.

A store is a folder of plain parquet tables:

* ``data/store_writer=<writer>/store_batch=<batch>/`` holds a batch,
  partitioned by the store's columns;
* ``log/<writer>/<batch>/`` holds one file of one row that publishes it: the
  batch's arrival number and kind, its partitions with their rows, and the
  entries it takes the place of.

A batch is in the store from the moment its log file appears, whole or not
at all; a folder without one (a writer that failed) is never read.  Writers
have names, so two of them never share a folder; publishing (writer, batch) a
second time changes nothing.  Rows carry (arrival, writer, batch, ingest_seq),
and the largest of these wins for a key.  Two writers that publish at once may
take the same arrival; the name decides then.

``replace`` publishes a batch that covers everything the store had: readers
see the old rows until its log file appears and only new ones after.
``merge`` does the same with the current rows, which ends the growth of the
log and of old versions; rows keep their order, so a batch that was published
meanwhile still wins or loses as before.  Covered folders stay for readers
that began earlier until ``vacuum``.

Readers take the folders from the log: with partition values wanted, only
those of entries that have them.  A key may have moved to another partition in
a later batch, so the keys (not the rows) of the others are read too; of a
merged entry none are, because a key is in it once.  Null and blank partition
values differ, and values keep their text (``01`` is not 1).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOG = ("writer string, batch long, kind string, arrival long, covers array<string>, done map<string,long>, last long, "
        "schema string, parts array<struct<values:array<string>,rows:long>>")
_VERSION = "_version"
_OWN = ("store_writer", "store_batch")  # folders of an entry
_PART = "region_or_part_"  # folders of its partitions, as text: no value is typed anew


@dataclass(frozen=True)
class Spec:
    """What a store is keyed and partitioned by (column names)."""

    keys: tuple[str, ...]
    parts: tuple[str, ...] = ()


MATCHES = Spec(("player_id", "match_id"), ("region", "match_date"))
PLAYERS = Spec(("player_id",))


def writer_of(checkpoint: str) -> str:
    """A streaming job's name as a writer: the same after a restart."""
    return "job-" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def _safe(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name.startswith("_") or name.startswith("."):
        raise ValueError(f"a writer's name has letters, digits, '.', '_' and '-' only: {name!r}")
    return name


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _log(spark: SparkSession, path: str) -> list:
    if not _files(spark, f"{path}/log"):
        return []
    return spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{path}/log").collect()


def entries(spark: SparkSession, path: str) -> list:
    """The live entries, oldest first: a row for every batch since the last
    merge, not for every row or file of the store."""
    log = _log(spark, path)
    covered = {c for e in log for c in e.covers}
    return sorted((e for e in log if _name(e) not in covered), key=_order)


def _order(entry) -> tuple:
    return entry.arrival, entry.writer, entry.batch


def _name(entry) -> str:
    return f"{entry.writer}/{entry.batch}"


def _data(path: str, writer: str, batch: int) -> str:
    return f"{path}/data/{_OWN[0]}={writer}/{_OWN[1]}={batch}"


def published(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    """Is the batch in the log, or was it before a merge and vacuum?"""
    if any(f.startswith("part-") for f in _files(spark, f"{path}/log/{_safe(writer)}/{int(batch)}")):
        return True
    return any(e.done.get(writer, -1) >= batch for e in _log(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    """Has anything been published in this folder?"""
    return bool(_files(spark, f"{path}/log"))


def _stored(df: DataFrame, arrival: int, writer: str, batch: int) -> DataFrame:
    numbered = dict(df.dtypes).get("ingest_seq") in ("bigint", "int")
    seq = F.coalesce(F.col("ingest_seq").cast("long"), F.lit(0).cast("long")) if numbered else F.lit(0).cast("long")
    return df.withColumn(_VERSION, F.struct(F.lit(arrival).cast("long").alias("arrival"), F.lit(writer).alias("writer"),
                                            F.lit(int(batch)).cast("long").alias("batch"), seq.alias("seq")))


def _folders(spec: Spec) -> list[str]:
    return [f"{_PART}{i}" for i in range(len(spec.parts))]


def _publish(rows: DataFrame, path: str, spec: Spec, writer: str, batch: int, kind: str, arrival: int, covered: Sequence = ()) -> None:
    spark, folders, data = rows.sparkSession, _folders(spec), _data(path, _safe(writer), int(batch))
    writing = rows.withColumns({f: _text(p) for f, p in zip(folders, spec.parts, strict=True)}).write.mode("overwrite")
    (writing.partitionBy(*folders) if folders else writing).parquet(data)
    written = spark.read.schema(_with_folders(rows.schema, folders)).parquet(data)
    counted = written.groupBy(F.array(*[F.col(f) for f in folders]).cast("array<string>").alias("values")).agg(
        F.count(F.lit(1)).alias("rows"), F.max(f"{_VERSION}.arrival").alias("last"))
    done: dict[str, int] = {}
    for e in covered:
        for w, n in [*e.done.items(), *([(e.writer, e.batch)] if e.kind == "batch" else [])]:
            done[w] = max(n, done.get(w, n))
    entry = counted.agg(F.collect_list(F.struct("values", "rows")).alias("parts"), F.coalesce(F.max("last"), F.lit(0)).alias("last")).select(
        F.lit(writer).alias("writer"), F.lit(int(batch)).cast("long").alias("batch"), F.lit(kind).alias("kind"),
        F.lit(int(arrival)).cast("long").alias("arrival"), F.lit(rows.schema.json()).alias("schema"), "last", "parts",
        F.from_json(F.lit(json.dumps([_name(e) for e in covered])), "array<string>").alias("covers"),
        F.from_json(F.lit(json.dumps(done)), "map<string,long>").alias("done"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{writer}/{int(batch)}")


def _text(col: str) -> Column:
    """A partition value as text; 'n' for null, so that null and blank differ."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(col).cast("string")))


def _with_folders(schema: StructType, folders: Sequence[str]) -> StructType:
    out = StructType(list(schema.fields))
    for f in folders:
        out = out.add(f, "string")
    return out


def _next(live: Sequence) -> int:
    return 1 + max((e.arrival for e in live), default=0)


def append(df: DataFrame, path: str, spec: Spec, writer: str, batch: int) -> bool:
    """Publish a batch; False if it already was (a retried micro-batch).  A
    writer's batches have ascending numbers."""
    spark = df.sparkSession
    if published(spark, path, writer, batch):
        return False
    arrival = _next(entries(spark, path))
    _publish(_stored(df, arrival, writer, batch), path, spec, writer, batch, "batch", arrival)
    return True


def replace(df: DataFrame, path: str, spec: Spec, writer: str | None = None) -> None:
    """Publish rows in place of all that the store has at this moment."""
    live = entries(df.sparkSession, path)
    arrival, writer = _next(live), writer or f"upload-{uuid.uuid4().hex[:12]}"
    _publish(_stored(df, arrival, writer, arrival), path, spec, writer, arrival, "replace", arrival, live)


def _read(spark: SparkSession, path: str, spec: Spec, chosen: Sequence) -> DataFrame:
    """All rows of some entries, with their partition folders as columns."""
    schema = StructType()
    for e in chosen:  # later batches may bring further columns
        for f in StructType.fromJson(json.loads(e.schema)).fields:
            if f.name not in schema.names:
                schema = schema.add(f.name, f.dataType, True)
    reader = spark.read.schema(_with_folders(schema, [*_OWN, *_folders(spec)])).option("basePath", f"{path}/data")
    return reader.parquet(*[_data(path, e.writer, e.batch) for e in chosen]).drop(*_OWN)


def _newest(rows: DataFrame, spec: Spec) -> DataFrame:
    others = [c for c in rows.columns if c not in spec.keys]
    best = rows.groupBy(*spec.keys).agg(F.max_by(F.struct(*others), _VERSION).alias("_row"))
    return best.select(*spec.keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def batch_rows(spark: SparkSession, path: str, spec: Spec, writer: str, batch: int) -> DataFrame:
    """The rows of one live batch as they were published."""
    own = [e for e in entries(spark, path) if (e.writer, e.batch) == (writer, batch)]
    if not own:
        raise FileNotFoundError(f"{writer}/{batch} is not live in {path}")
    return _read(spark, path, spec, own).drop(*_folders(spec), _VERSION)


def _moved(spark: SparkSession, path: str, spec: Spec, live: Sequence, hit: Column) -> DataFrame | None:
    """(keys, newest version) of rows outside the wanted partitions that may
    be newer than one inside; None if there can be none."""
    merged = [e for e in live if e.kind == "merge"]
    others = [e for e in live if e.kind != "merge"]
    if len(merged) > 1 or any(e.arrival <= max(m.last for m in merged) for e in others if merged):
        others = list(live)  # a batch that was published while older ones were merged
    if not others:
        return None
    rows = _read(spark, path, spec, others).filter(~hit)
    return rows.groupBy(*spec.keys).agg(F.max(_VERSION).alias("_moved"))


def read(spark: SparkSession, path: str, spec: Spec, where: Mapping[str, object] | None = None,
         without: tuple[str, int] | None = None, versions: bool = False, only: DataFrame | None = None) -> DataFrame:
    """The newest row of every key.

    ``where`` gives wanted values by partition column: one value, or a list of
    values.  ``without`` leaves an entry out (a batch that is being retried).
    ``only`` has wanted values of some of the key columns: rows of other keys
    are left out before versions are compared."""
    live = [e for e in entries(spark, path) if without is None or (e.writer, e.batch) != without]
    if not live:
        raise FileNotFoundError(f"nothing is published in {path}")
    own, hit = live, F.lit(True)
    for column, values in (where or {}).items():
        at = spec.parts.index(column)
        texts = {f"v{v}" for v in (values if isinstance(values, (list, tuple, set)) else [values])}
        own = [e for e in own if any(p["values"][at] in texts for p in e.parts)]
        hit = hit & F.col(f"{_PART}{at}").isin(sorted(texts))
    rows = _read(spark, path, spec, own or live[-1:]).filter(hit)
    if only is not None:
        rows = rows.join(only, [c for c in spec.keys if c in only.columns], "left_semi")
    if not (len(own) == 1 and own[0].kind == "merge"):  # that one has a key once
        rows = _newest(rows, spec)
    if where and own and (moved := _moved(spark, path, spec, live, hit)) is not None:
        rows = rows.join(moved, list(spec.keys), "left").filter(
            F.col("_moved").isNull() | (F.col("_moved") <= F.col(_VERSION))).drop("_moved")
    return rows.drop(*_folders(spec), *([] if versions else [_VERSION]))


def newest(spark: SparkSession, path: str, spec: Spec, without: tuple[str, int] | None = None) -> DataFrame | None:
    """``read``, or None where nothing (else) is published."""
    try:
        return read(spark, path, spec, without=without)
    except FileNotFoundError:
        return None


def merge(spark: SparkSession, path: str, spec: Spec, most: int = 1) -> bool:
    """Write the current rows as one entry if more than ``most`` are live."""
    live = entries(spark, path)
    if len(live) <= most:
        return False
    rows = _newest(_read(spark, path, spec, live), spec).drop(*_folders(spec))
    names = "\n".join(map(_name, live))
    number = int(hashlib.sha256(names.encode()).hexdigest()[:15], 16)  # the same entries merge to the same one
    _publish(rows, path, spec, "merge", number, "merge", live[-1].arrival, live)
    return True


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the entries that a merge or replace has covered; for when no
    reader from before it is left.  Returns their number."""
    names = sorted({c for e in _log(spark, path) for c in e.covers})
    gone = 0
    for name in names:
        writer, _, batch = name.rpartition("/")
        gone += _delete(spark, _data(path, writer, int(batch)))
        _delete(spark, f"{path}/log/{name}")
    return gone
