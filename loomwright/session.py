"""Session helpers: configuration, checkpoint folder, materialisation and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by :func:`sized_broadcast` only up to this many rows, and characters of its rows as JSON.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 64_000_000

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "loomwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``_`` for ``.``-less overrides or full Spark names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a local one only in local mode where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")


#: Lets the shuffle files of a query go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    The shuffle files that made it are removed with it: nothing reads them again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made while the setting holds
    finally:
        spark.conf.set(_CLEANUP, before)


def release(*frames: DataFrame) -> None:
    """Delete the checkpoint that each of the frames was materialised as; nothing may read them any more, frames derived from them included."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile().get()
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows of at most ``chars`` characters together, else ``df``
    for a shuffled join.

    ``df`` is materialised first, so the count and the join see the same rows.
    """
    df = materialise(df)
    size = F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= rows and held <= chars else df


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
