"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.session import checkpointed, ensure_checkpoint_dir  # noqa: F401  shared with the operators here

#: Remainder of crc32(doc_id as text) modulo 3 whose documents no model may learn from.
HELD_OUT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """True for rows that are kept for evaluation; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == HELD_OUT, F.lit(False))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows from a Parquet table in the shared checkpoint folder, and its path, so that the caller can remove it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{spark.sql('select uuid()').first()[0]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those of lowest hash of a key that tells rows apart; all rows if there are no more.

    Rows whose hash lies under most / n are taken first, so that the exact cut
    sees few more rows than it keeps, however many partitions there are. df is
    read twice and should be slim.
    """
    n = df.count()
    if n <= most:
        return df
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    under = int((1 << 40) * min(1.0, (most + 6 * most**0.5 + 10) / n))
    return df.where(hashed < under).orderBy(hashed, key).limit(most)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of one key from which on it is joined by broadcast instead of being dealt to one task, and rows of a side that is broadcast.
HOT_ROWS, BROADCAST_ROWS = 50_000, 1_000_000


def join_unique(many: DataFrame, one: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of many rows for each key with at most one; `rows` of `one` counts the key's rows in many.

    Keys with HOT_ROWS rows and more never meet in one task: there is one of
    them for every HOT_ROWS rows at most, so they are broadcast, and their
    rows stay where they are. many is read twice and should be materialised.
    """
    hot = F.broadcast(one.where(F.col(rows) >= HOT_ROWS).drop(rows))
    cold = one.where(F.col(rows) < HOT_ROWS).drop(rows)
    return many.join(hot, key).unionByName(many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in dropped (one column, materialised); whole rows move only if dropped is too large to broadcast."""
    return df.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, key, "left_anti")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """A column name that no column of the input has (names compare without case)."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def extended(schema: T.StructType, fields: dict[str, str]) -> T.StructType:
    """A schema with further fields (name: type); the given one stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in fields.items())])
