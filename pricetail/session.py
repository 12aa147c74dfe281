"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job in this library relies on.  Adaptive execution
# picks join strategies from measured sizes, coalesces small shuffle
# partitions and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Recording the Python call site of every expression slows long plans down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str = "pricetail", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediate tables.

    The session's own ``spark.checkpoint.dir`` wins.  Only a local session
    without one gets a fresh folder on this machine: on a cluster such a
    folder would not be visible to the executors.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="pricetail-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written intermediate table."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder and go on from the written table.

    This cuts the lineage and survives the loss of executors.  Unlike a
    checkpointed plan, a written table brings its true size along: the size
    Spark carries over from a plan multiplies with every join, and in a loop
    that soon swamps planning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into the checkpoint folder: cheaper than a written table.

    For single steps.  The estimated size of the result still multiplies along
    a chain of steps, so a loop needs :func:`materialise` every few rounds.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = checkpoint_root(spark).rstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/step-" in folder and folder.split(":", 1)[-1].startswith(root.split(":", 1)[-1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
