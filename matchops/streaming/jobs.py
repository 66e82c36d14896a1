"""Start the streaming jobs (J1–J10, M10) on any source and trigger.

Each ``*_job`` takes a streaming DataFrame of match records (columns of
the clean match table plus ``created_at``), the output and checkpoint
locations, and a trigger (``{"processingTime": "30 seconds"}`` in
production, ``{"availableNow": True}`` to drain what is there), and
returns the started ``StreamingQuery``.  Checkpoints make every job
restartable after a failure; the foreachBatch sinks are idempotent per
batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from matchops.config import Config, DEFAULT
from matchops.plans.batch import Analysis
from matchops.sources.store import writer_of
from matchops.streaming import ingest, plans, refresh
from matchops.streaming.verdicts import player_reasons, verdicts as verdict_rows


def match_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                 options: dict | None = None) -> DataFrame:
    """Matches of a file source, typed by ``schema``.  With ``fmt="kafka"``
    and broker options the records of a topic, as text by name
    (``ingest.topic_records``), for ``ingest_job`` and ``verdict_job``."""
    reader = spark.readStream.format(fmt).options(**(options or {}))
    return ingest.topic_records(reader.load()) if fmt == "kafka" else reader.schema(schema).load(path)


def _start(writer, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def alerts_job(stream: DataFrame, out: str, checkpoint: str, trigger: dict,
               cfg: Config = DEFAULT) -> StreamingQuery:
    """Rule alerts, appended as parquet."""
    w = plans.rule_alerts(stream, cfg).writeStream.format("parquet").option("path", out)
    return _start(w, checkpoint, trigger)


def dedup_job(stream: DataFrame, out: str, checkpoint: str, trigger: dict,
              delay: str) -> StreamingQuery:
    """First arrival of each (player, match) within the watermark delay."""
    w = plans.dedup_within_watermark(stream, delay).writeStream.format("parquet").option("path", out)
    return _start(w, checkpoint, trigger)


def store_job(stream: DataFrame, store: str, checkpoint: str, trigger: dict, writer: str | None = None,
              merge_above: int | None = None) -> StreamingQuery:
    """J4 + J10: upsert into the partitioned match store (newest wins).

    Jobs share a store: each writes under its own name, by default one made
    from its checkpoint.  One of them may merge the store whenever more than
    ``merge_above`` batches are live."""
    spark, name = stream.sparkSession, writer or writer_of(checkpoint)

    def publish(df, bid):
        plans.append_to_store(df, bid, store, name)
        if merge_above is not None:
            plans.merge_store(spark, store, merge_above)

    return _start(stream.writeStream.foreachBatch(publish), checkpoint, trigger)


def rate_job(stream: DataFrame, out: str, checkpoint: str, trigger: dict, delay: str,
             width: str = "1 minute") -> StreamingQuery:
    """Matches per closed window (append)."""
    w = plans.windowed_counts(stream, delay, width).writeStream.format("parquet").option("path", out)
    return _start(w, checkpoint, trigger)


def alert_rate_job(stream: DataFrame, out: str, checkpoint: str, trigger: dict, delay: str,
                   cfg: Config = DEFAULT, width: str = "1 minute") -> StreamingQuery:
    """Alerted matches and players per closed window (append)."""
    w = plans.windowed_alerts(stream, delay, cfg, width).writeStream.format("parquet").option("path", out)
    return _start(w, checkpoint, trigger)


def late_rows_job(stream: DataFrame, base: str, checkpoint: str, trigger: dict, delay: str,
                  width: str = "1 minute") -> StreamingQuery:
    """A side output beside ``rate_job``: the rows that come after their
    window closed, under ``base`` (``plans.late_counts`` counts them)."""
    writer = writer_of(checkpoint)
    w = stream.writeStream.foreachBatch(lambda df, n: plans.take_late_rows(df, n, base, writer, delay, width))
    return _start(w, checkpoint, trigger)


def totals_job(stream: DataFrame, totals: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Running player totals (update mode, changed players per batch)."""
    w = plans.running_totals(stream).writeStream.outputMode("update").foreachBatch(
        lambda df, bid: plans.append_totals(df, bid, totals, writer_of(checkpoint)))
    return _start(w, checkpoint, trigger)


def zscore_job(stream: DataFrame, base: str, checkpoint: str, trigger: dict, delay: str,
               cfg: Config = DEFAULT, k: int = 100) -> StreamingQuery:
    """J5 + J6: moments, z flags and the first ``k`` of the board, kept batch
    by batch under ``base`` (``refresh.read_moments``, ``read_outliers``,
    ``read_top``); copies within the watermark delay are dropped as in J3."""
    return refresh.refresh_job(stream, base, checkpoint, trigger, delay, cfg, k)


def reasons_path(verdicts: str) -> str:
    """Where a verdict job puts the players' reasons."""
    return verdicts.rstrip("/") + "_reasons"


def verdict_job(stream: DataFrame, store: str, verdicts: str, checkpoint: str, trigger: dict,
                cfg: Config = DEFAULT, writer: str | None = None, letters: str | None = None) -> StreamingQuery:
    """Land each batch of submissions, then judge them against the
    detection over the whole store; verdicts are appended per batch, and the
    reasons they refer to (by ``_batch`` and player) beside them.

    With ``letters`` the stream holds text records: they are validated and
    normalised first, and rejected ones go there instead (B13)."""
    spark, name = stream.sparkSession, writer or writer_of(checkpoint)

    def handle(batch, bid):
        if letters is None:
            plans.append_to_store(batch, bid, store, name)
        else:
            ingest.take(batch, bid, store, letters, name, cfg)
            batch = ingest.accepted(batch, cfg)
        a = Analysis(plans.read_store(spark, store), cfg)
        subs = batch.drop(*[c for c in ("ingest_seq",) if c in batch.columns])
        plans.append_log(player_reasons(a, subs), bid, reasons_path(verdicts))
        plans.append_log(verdict_rows(a, subs), bid, verdicts)

    return _start(stream.writeStream.foreachBatch(handle), checkpoint, trigger)
