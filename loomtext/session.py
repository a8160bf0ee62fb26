"""Session defaults and the one place that knows where shared scratch data goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; cluster sizing stays with the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "loomtext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword settings (with ``__`` for ``.``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Only a local session may do without and gets a folder of its own:
    a driver's folder isn't one that executors elsewhere see."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = context.getConf().get("spark.checkpoint.dir", "")
    if not configured and not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomtext-checkpoint-"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out to all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts for each split of a scan that its rows are dealt out into for a join.
PARTS_A_SPLIT = 2


def parted(df: DataFrame, key: str, scan: DataFrame) -> DataFrame:
    """The small side of a join with a scan, in parts by the scan's splits; if it isn't broadcast, the scan's rows follow it.

    A task then reads a share of a split, whatever the tables' sizes and however few shuffle partitions are set. Beside a scan of
    fewer splits than there are cores it stays as it is.
    """
    spark, splits = df.sparkSession, scan.rdd.getNumPartitions()
    if splits < spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_A_SPLIT * splits), key)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
