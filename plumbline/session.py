"""Session factory and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "plumbline", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with adaptive execution on and UTC as time zone."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset on a local master (tests on
    one machine) a temporary folder takes its place; elsewhere executors would not share it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if jsc.getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return jsc.getCheckpointDir().get().rstrip("/")


#: Folders made in the shared one, in order; who has no more use for them may ``remove`` them.
MADE: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    MADE.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return MADE[-1]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, made at once: cuts the lineage in the shared folder, so lost executors lose nothing."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    MADE.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` as a written table of the shared folder; unlike a checkpoint, it forgets how rows were partitioned.

    A join that reads it shuffles it by itself, so that adaptive execution can split hot keys. The table stays until
    ``discard``, or until the shared folder is emptied.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote; nothing may read it any more."""
    remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
