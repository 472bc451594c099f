"""Session for tests and the bench, and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, name: str = "plumbline") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Scratch folders of local applications without a checkpoint folder.
_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master without one, as in tests, gets a scratch folder; elsewhere a missing
    folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _SCRATCH:
            _SCRATCH[application] = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        named = _SCRATCH[application]
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut.

    A table that Parquet cannot hold (void or interval columns, repeated names) is checkpointed
    there instead, which computes it twice.
    """
    spark, names = df.sparkSession, [c.lower() for c in df.columns]
    kinds = " ".join(kind for _, kind in df.dtypes)
    if names and len(set(names)) == len(names) and "void" not in kinds and "interval" not in kinds:
        path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
