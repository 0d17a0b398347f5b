"""Session helpers: a tuned builder and lineage cutting that survives lost executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def build(master: str | None = None, app: str = "tidewire", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    if not is_local(spark):
        ship(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, which share its folders."""
    return spark.sparkContext.master.split("[")[0] == "local"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in ``spark.checkpoint.dir``; in a single process without one make a temporary one.

    Raises on a cluster that names none: its executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not is_local(spark):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewire-checkpoint-"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it by name; it is zipped into Spark's own folder."""
    package = Path(__file__).resolve().parent
    archive = Path(SparkFiles.getRootDirectory(), "tidewire.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy, partition by partition."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out to all cores where its files make fewer tasks than there are cores.

    Only small inputs are moved: a table of many files is read where it lies. The rows stay the same.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
