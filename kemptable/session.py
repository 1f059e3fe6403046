"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the package relies on; each is applied only where the session has
# not chosen one itself.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above this size; on wide tables one big
    # generated method would run interpreted, several small ones do not.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "kemptable", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a folder is made and set, which is only allowed on a
    local master: on a cluster executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    already = context.getCheckpointDir()
    if already:
        return already
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kemptable-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the session's own part of the shared folder; nothing is created there yet.

    The session's part is removed when its driver ends.
    """
    own = f"{shared_folder(spark).rstrip('/')}/kemptable-{spark.sparkContext.applicationId}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(conf)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a reduced table to the shared folder so later jobs start from it.

    Parquet rather than a checkpoint: later jobs read only the columns and
    rows they need.
    """
    path = scratch_path(df.sparkSession, "reduced")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
