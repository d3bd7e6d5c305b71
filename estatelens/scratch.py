"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_BUCKET_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory of the session.

    Without a configured `spark.checkpoint.dir` only a local master may run: a machine-local
    folder would leave each executor of a cluster with files that the others cannot see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="estatelens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/estatelens/{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage, survives the loss of an executor, and gives the optimizer
    a real size to choose join strategies by.
    """
    path = scratch_dir(df.sparkSession)
    writer = df.write.option("compression", compression) if compression else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads; only files under the scratch folder go."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/estatelens/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Write `df` to the shared folder in buckets of `keys`, so that joins on them do not shuffle it.

    There are as many buckets as shuffle partitions, with one file each as rows are dealt out the same way first. The
    table is in the session's catalog until `discard_table`.
    """
    spark = df.sparkSession
    name = f"estatelens_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", f"{scratch_dir(spark)}").format("parquet").saveAsTable(name)
    return spark.table(name).alias(name)


@contextmanager
def bucket_order(spark: SparkSession) -> Iterator[None]:
    """Joins written in here take the rows of `bucketed` tables as sorted, which they are with one file a bucket."""
    before = spark.conf.get(_BUCKET_ORDER, None)
    spark.conf.set(_BUCKET_ORDER, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BUCKET_ORDER)
        else:
            spark.conf.set(_BUCKET_ORDER, before)


def discard_table(df: DataFrame) -> None:
    """Drop a table of `bucketed` and delete its files."""
    name = df._jdf.queryExecution().analyzed().alias()
    discard(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
