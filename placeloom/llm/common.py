"""Helpers shared by the training-data operators.

Nothing here keeps state on a machine-local disk: what has to be cut from the
lineage goes below ``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it; ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Flips word hashes, so that hashes of words here differ from other uses.
SEED_WORD = 0x5851F42D4C957F2D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else one set for tests."""
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    path = spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one; Hadoop removes it when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: written once, whatever reads it later.

    The shuffles behind it aren't needed any more; the collection makes Spark's cleaner remove their files now,
    where on a driver of little garbage they would stay for half an hour.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    rows = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(rows)] = path
    return rows


_PATHS: dict[int, str] = {}


def drop(*rows: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and nothing reads any more."""
    for df in rows:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(id(df)))
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``cut``, in buckets by a key: what groups or joins by it doesn't shuffle these rows."""
    spark = df.sparkSession
    path, table_name = scratch(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    rows = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")  # the name only: the files are the session's
    return rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of a string column without decoding it."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], text.type)
    kind = pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()
    return text.cast(kind).to_pylist()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names: others can't clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


