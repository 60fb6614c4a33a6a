"""Session helpers: local sessions for tests, scratch folders for checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "marlstone", **conf: str) -> SparkSession:
    """A local session as tests and the bench use it; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one set here (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Stages are packed well, in small row groups, so that the next reader can split them.
STAGE = {"compression": "zstd", "parquet.block.size": str(16 << 20)}


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the function that makes its path objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


class Scratch:
    """Stages of one computation, in one folder of the shared folder, removed at its end."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.stages = spark, scratch(spark, label), 0

    def cut(self, df: DataFrame) -> DataFrame:
        """Write df and read it again, as cut_lineage() does."""
        self.stages += 1
        path = f"{self.path}/{self.stages}"
        df.write.options(**STAGE).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, stage: DataFrame) -> None:
        """Remove a stage that nothing reads any more."""
        (folder,) = {file.rpartition("/")[0] for file in stage.inputFiles()} or {None}
        if folder:
            fs, at = file_system(self.spark, folder)
            fs.delete(at(folder), True)
        self.collect()

    def collect(self) -> None:
        """Let Spark drop the shuffle files of plans that have run, once their objects are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        fs, at = file_system(self.spark, self.path)
        fs.delete(at(self.path), True)
        self.collect()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again.

    The written files survive the loss of an executor, unlike cached or locally
    checkpointed blocks, and later readers see real file sizes when they plan joins.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("overwrite").options(**STAGE).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
