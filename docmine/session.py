"""Session settings, scratch tables and schema checks shared by every job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on.

    Hot join keys are split at run time by adaptive execution, also where the split
    costs one more shuffle; small sides become broadcasts only from measured sizes.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def build_session(app: str = "docmine", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode, where one machine is all there is, a
    private folder stands in when none is configured; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/docmine-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it outlives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def release(*stored: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs. It does so when the driver's
    garbage is collected, which a driver with little to do puts off while disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def check_schema(df: DataFrame, expected: T.StructType, name: str = "input") -> DataFrame:
    """Fail early when a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    missing = [f.name for f in expected if f.name not in have]
    wrong = [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in expected
        if f.name in have and have[f.name] != f.dataType
    ]
    if missing or wrong:
        raise ValueError(f"{name}: missing {missing}, wrong type {wrong}")
    return df
