"""Session defaults, the shared staging folder and the size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a narrow (key, id) table that still make a harmless broadcast.
BROADCAST_ROWS = 1_000_000


def get_session(app: str = "civitext", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`.

    Only a local-mode session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="civitext-"))
    return sc.getCheckpointDir()


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/civitext/{spark.sparkContext.applicationId}"


_SCOPES: list[list[str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owner of what is staged within: it is deleted at the end, also after an error.

    For jobs that write what they make to a place of its own before they end. Scopes can
    be nested; threads of a job share its scope.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(spark, path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged. Call it once no staged table is read any more."""
    _delete(spark, app_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def unstage(df: DataFrame) -> None:
    """Delete the table that `stage` returned as `df`, once nothing reads it any more.

    For loops that stage a table per round: the next round's table is committed before
    this one goes, so a lost executor still finds what it has to read.
    """
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if "/civitext/" not in folder:
            raise ValueError(f"{folder} is not a staged table")
        _delete(df.sparkSession, folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage with a committed table, so a lost executor never recomputes
    what lies behind it, and later readers prune columns of it.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting that `df` has at most `max_rows` rows.

    Meant for staged or otherwise cheap-to-count tables; a larger side is
    returned without a hint, for a shuffled join.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
