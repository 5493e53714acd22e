"""Session defaults, table access and lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. On a cluster the submitting configuration wins."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a checkpoint goes when nothing refers to it any more
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, the folder that was set for checkpoints, or, only where the master is this machine, a
    temporary one. On a cluster without either there is no folder that survives the loss of a machine: an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    ctx = spark.sparkContext._jsc.sc()
    if ctx.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrid-"))
    return ctx.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    there = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(there)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor, wherever the driver found it."""
    ctx = spark.sparkContext
    if getattr(ctx, "_lexigrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    there = Path(tempfile.mkdtemp(prefix="lexigrid-ship-")) / "lexigrid.zip"
    with zipfile.ZipFile(there, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    ctx.addPyFile(str(there))
    ctx._lexigrid_shipped = True
