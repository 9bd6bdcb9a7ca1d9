"""Session helpers: defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# True: the files of a query's shuffles go when the query ends, not when the driver collects its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "eventcast", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for; caller's settings win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written stages.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to
    a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    current = context.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="eventcast-")
    context.setCheckpointDir(named)
    return named


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/eventcast-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under this application's part of the shared folder."""
    return f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application wrote with ``new_path``; call when results are saved."""
    _delete(spark, _scratch(spark))


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``stage_table`` wrote, when nothing reads it any more."""
    spark = table.sparkSession
    own = re.escape(_scratch(spark).rpartition("/")[2])
    for path in {found[0] for file in table.inputFiles() if (found := re.match(rf".*/{own}/stage-[0-9a-f]+(?=/)", file))}:
        _delete(spark, path)


def own_session(spark: SparkSession, **values: str) -> SparkSession:
    """A session with the settings of ``spark`` and ``values``; tables read in it are computed with these, whoever asks."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **values}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def stage(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder; later readers survive executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, **options: str) -> DataFrame:
    """Like ``stage`` for tables as large as the events: a compressed columnar table, so that
    later passes read only the columns they need. ``options`` are those of the writer."""
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, **options))


def stage_path(df: DataFrame, **options: str) -> str:
    """Where ``stage_table`` has written ``df``."""
    path = new_path(df.sparkSession, "stage")
    df.write.options(**options).parquet(path)
    return path


def result_table(spark: SparkSession, rows: Sequence[Sequence], columns: str) -> DataFrame:
    """A few result rows (one per model or setting) as a DataFrame, without Python workers."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [part.split() for part in columns.split(",")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    names = [name for name, _ in fields]
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=schema)
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that has fewer partitions than there are cores.

    Inputs with enough partitions, which is every large one, are left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
