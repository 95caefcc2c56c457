"""Session factory, table loading and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def get_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (ANSI, UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a directory of parts."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per context, nothing to do in local mode)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_quillon_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(_ROOT.parent)))
    sc.addPyFile(str(path))
    sc._quillon_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests) a local one is made."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-checkpoint-")
    sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, stored in the shared folder, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back the disk of shuffles and checkpoints that nothing refers to any more.

    Spark removes them when the driver happens to collect its garbage (half an hour by default), so the
    steps of a long job would pile up. To be called between steps, not within loops of small ones.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
