"""Validated ingest (B13, J1, M10): text records in, store and dead letters out.

Records arrive as text fields (a file of strings, or JSON values of a topic).
Each micro-batch goes to two places under its one batch number: accepted
records, normalised as on upload, into the match store, and rejected ones with
the reason and all that arrived into a table of dead letters.  Both are
published once per (writer, batch), so a retry after a stop between the two
adds what is missing and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchops.config import Config, DEFAULT
from matchops.operators import cleaning
from matchops.sources import store
from matchops.sources.store import Spec
from matchops.streaming import plans

TIME = "created_at"
#: One row per rejected record: the place it had in its batch tells copies apart.
LETTERS = Spec(("place",), ("reason",))


def topic_records(values: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Records of a topic's rows (``value`` as bytes or text, one JSON object
    each; ``partition`` and ``offset`` where there are any).

    Numbers come as they are written, so validation sees ``12.5`` or ``"x"``.
    A value that is no JSON object is a record without fields, and ``raw``
    keeps its text."""
    text = F.col("value").cast("string")
    fields = [*cfg.required_columns, TIME]
    parsed = F.from_json(text, ", ".join(f"{c} string" for c in fields))
    places = [F.col(c) for c in ("partition", "offset") if c in values.columns]
    return values.select(*places, text.alias("raw"), parsed.alias("_r")).select(*places, "raw", *[F.col(f"_r.{c}").alias(c) for c in fields])


def judged(records: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every record with ``reason`` (NULL where it is accepted)."""
    text = records.withColumns({c: F.col(c).cast("string") for c in cfg.required_columns})
    return text.withColumn("reason", cleaning.reject_reason(cfg))


def accepted(records: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The accepted records as clean matches (ids stripped, labels in title
    case); of copies of a match the later one in the topic or file counts."""
    good = judged(records, cfg).where("reason IS NULL").drop("reason")
    numbers = cleaning.parsed_numbers(good, cfg)
    order = F.col("offset") if "offset" in numbers.columns else F.monotonically_increasing_id()
    seq = numbers if "ingest_seq" in numbers.columns else numbers.withColumn("ingest_seq", order)
    seq = seq.withColumn(TIME, F.col(TIME).try_cast("timestamp")) if TIME in seq.columns else seq
    return cleaning.finish(seq, cfg)


def take(batch: DataFrame, number: int, path: str, letters: str, writer: str = plans.MAIN, cfg: Config = DEFAULT) -> None:
    """Publish one micro-batch to the store and the dead letters."""
    plans.append_to_store(accepted(batch, cfg), number, path, writer)
    bad = judged(batch, cfg).where("reason IS NOT NULL")
    place = F.concat_ws("/", F.lit(writer), F.lit(str(int(number))), F.monotonically_increasing_id().cast("string"))
    store.append(bad.withColumn("place", place), letters, LETTERS, writer, number)


def ingest_job(stream: DataFrame, path: str, letters: str, checkpoint: str, trigger: dict, cfg: Config = DEFAULT,
               writer: str | None = None) -> StreamingQuery:
    """B13 + J4: validate a stream of text records into store and dead letters."""
    name = writer or store.writer_of(checkpoint)
    query = stream.writeStream.foreachBatch(lambda df, n: take(df, n, path, letters, name, cfg))
    return query.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_letters(spark, letters: str) -> DataFrame:
    """All rejected records with their reasons."""
    return store.read(spark, letters, LETTERS)
