"""Tables in the folder that driver and executors share, and joins whose sides are measured first."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to so many rows (of a few dozen bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that set on the context; in local mode alone a temporary one where both are unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df shuffled once by key, so that grouping by the key and more columns needs no further shuffle, and `dealt` a file a task."""
    return df.repartition(partitions(df.sparkSession), key)


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, which `by_key` has shuffled, as a table of buckets in the shared folder: reads of it need no shuffle by key, however many."""
    path = new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").bucketBy(partitions(df.sparkSession), key).option("compression", "zstd").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else without. df should be staged: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], hot: str) -> DataFrame:
    """Inner join with side, which has one row for each key; `hot` (SQL on side) names the keys of very many rows.

    The condition must hold for a number of keys with a proven bound (those of a thousandth of all rows each, say):
    they are broadcast, so that their rows stay where they are, and each key of the shuffled rest has few rows.
    Both sides are read twice and should be staged.
    """
    keys = list(keys)
    often = F.broadcast(side.filter(hot))
    rest = rows.join(often.select(*keys), keys, "left_anti")
    return rows.join(often, keys).unionByName(rest.join(side.filter(f"not ({hot})"), keys))


def keyed_left_join(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys in which rows that lack one take no part: they can match nothing, and stay where they are.

    In a plain outer join all of them would be sent to the task of the null key.
    """
    keys = list(keys)
    whole = " and ".join(f"{k} is not null" for k in keys)
    joined = rows.filter(whole).join(side, keys, "left")
    return joined.unionByName(rows.filter(f"not ({whole})"), allowMissingColumns=True).select(*joined.columns)
