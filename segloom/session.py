"""Sessions, table access and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many ranges or buckets to cut a shuffle into: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share, below which checkpoints lie.

    The cluster names it in ``spark.checkpoint.dir``; only where neither it nor an earlier ``setCheckpointDir`` is
    present, and all runs on one machine, as in tests, a temporary local folder is set. A cluster that names none is an
    error: its executors don't share a machine's folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="segloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: files in the ``shared_folder``."""
    ship(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys up to this number are sent to every task; beyond it they are joined by a shuffle.
MOST_SENT = 200_000
#: Parts that a key is split into in such a shuffle, so that a hot one is no single task's.
SALTS = 16


def few(keys: DataFrame) -> bool:
    """Whether there are few enough of the (durable) keys to send them; ``spark.segloom.mostSent`` overrules the bound."""
    return keys.count() <= int(keys.sparkSession.conf.get("spark.segloom.mostSent", str(MOST_SENT)))


def joined(df: DataFrame, keyed: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``df`` joined with rows that are few for each key, whatever the share of a key in ``df``.

    They are sent to every task if they are few in all, else copied for SALTS parts of each key, so a hot key of ``df`` is
    spread over as many tasks. They are counted first, so ``keyed`` should be ``durable``.
    """
    if few(keyed):
        return df.join(F.broadcast(keyed), on, how)
    salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, [on, "_salt"], how).drop("_salt")


def narrowed(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` with one of the keys (``left_anti``: with none). keys: one column, as for ``joined``."""
    return joined(df, keys.select(on), on, how)


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of this application, wherever they run; once per context."""
    context = spark.sparkContext
    if context.getLocalProperty("segloom.shipped"):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="segloom-")) / "segloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(archive))
    context.setLocalProperty("segloom.shipped", "yes")
