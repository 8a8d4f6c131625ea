"""Session-level helpers shared by all operators: table access, lineage cuts, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUTS = "archivolt-cuts"


def table(spark: SparkSession, sf_dir: str, name: str, busy: bool = False) -> DataFrame:
    """The Parquet table ``name`` of a data folder (one file or one directory); ``busy``: see ``spread``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if busy else df


def spread(df: DataFrame) -> DataFrame:
    """A scan for much work per row: one with splits for less than half of the cores is dealt out over all of them.

    Only scans of a few splits are ever moved, so what is moved is bounded by the split size; larger scans stay as they
    are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` of the session, else (local runs) a folder of our own.

    A machine-local folder is only ever used where the master is local; a cluster without the setting is refused.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "archivolt-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def save(df: DataFrame) -> str:
    """Writes a table into the shared checkpoint folder; returns its own folder."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{CUTS}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes a table into the shared checkpoint folder and reads it back.

    The table is columnar, so later reads take the columns and rows they need, and its size is known to the optimizer.
    """
    return df.sparkSession.read.schema(df.schema).parquet(save(df))


def release_cuts(spark: SparkSession) -> None:
    """Deletes the tables of all cuts of this application, once no result that reads them is needed any more."""
    jvm, folder = spark.sparkContext._jvm, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{CUTS}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def groups_for(n_rows: int, rows_per_group: int) -> int:
    """Number of groups so that none holds much more than ``rows_per_group`` rows."""
    return max(1, -(-n_rows // rows_per_group))


def salt(col, groups: int, seed: int = 0):
    """A pseudorandom group number in ``[0, groups)``, the same on every run and executor."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(groups)).cast("int")
