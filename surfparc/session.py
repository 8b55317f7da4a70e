"""Session construction and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "surfparc", cores: str = "8") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "iterative operators need spark.checkpoint.dir to name a folder "
                "every executor can reach"
            )
        shared = tempfile.mkdtemp(prefix="surfparc-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and read it back.

    The written table drops all lineage, outlives any executor and carries its real
    size, so a later join is broadcast only where that size allows it. (An RDD
    checkpoint would keep the plan's constraints, which pile up over a loop.)
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in file:
            place = spark._jvm.org.apache.hadoop.fs.Path(file)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def pin(df: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Write once as a table bucketed by ``by``; later joins and groups on ``by`` read it in place.

    The files live in the checkpoint folder, so they outlive any executor.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"surfparc_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", folder).format("parquet").saveAsTable(name)
    return spark.table(name)
