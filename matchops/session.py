"""Session helpers: local sessions for tests/bench, checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "matchops", extra: dict | None = None) -> SparkSession:
    """A local session configured like the production one (AQE on, UTC)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``
    (required there); only a local-mode session without one gets a scratch
    folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set
            conf_dir = None
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach; "
                "intermediate tables and stream checkpoints are written there")
        # local mode only (tests): one machine, so a scratch folder is shared.
        conf_dir = tempfile.mkdtemp(prefix="matchops-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_CREATED: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for staged inputs, sinks and stream checkpoints.

    It lives under the session's checkpoint folder, which on a cluster is
    the shared location every executor (and a restarted driver) can reach.
    """
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/matchops-work/{name}-{uuid.uuid4().hex[:12]}"
    _CREATED.append(path)
    return path


def work_mark() -> int:
    """A marker for ``release_work``: folders created after it."""
    return len(_CREATED)


def release_work(spark: SparkSession, since: int) -> int:
    """Delete the work folders created after ``since`` (once their readers
    are done); returns how many were removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while len(_CREATED) > since:
        p = jvm.org.apache.hadoop.fs.Path(_CREATED.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            removed += 1
    return removed


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table in the shared folder.

    One write job (no recount as with an RDD checkpoint), columnar, so
    later readers prune columns; a lost executor re-reads the files
    instead of recomputing the upstream plan.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
