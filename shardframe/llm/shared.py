"""Tables that the operators write once to the cluster's shared folder and read again."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.session import new_shared_path


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: stable between uses, safe when executors are lost.

    What was shuffled to make it is deleted at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of an object whose class travels along, for executors without this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    """The object of :func:`shipped`, in a task."""
    return pickle.loads(shared.value)


def text_of(column: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id, null included, is in the column ``_id`` of ``ids``.

    Both sides are sorted at every size: ids grow with the documents, so a broadcast would be right for small tables only.
    """
    return docs.join(ids.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(ids["_id"]), "left_semi")
