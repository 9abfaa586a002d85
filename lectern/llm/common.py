"""Helpers that several operators share: staging, size-checked broadcasts, two-level running sums, batch hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule, `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join may be broadcast up to so many rows (of a few dozen bytes each); beyond that the join shuffles.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that set on the context.

    Where both are unset, a temporary one in local mode (tests); on a cluster executors would not see it, so that is
    an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_dir.get()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that was made of them must be staged itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else without. df should be staged: it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts(df: DataFrame, column: str = "text") -> DataFrame:
    """df with nulls of the text column read as empty."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value, out: str) -> DataFrame:
    """Sum of `value` over the rows before each one, by keys, in the order of (bucket, order).

    Rows of a key are summed within their bucket, and the buckets' totals are summed on their own, so that a key
    with a third of all rows is spread over its buckets. `order` must be unique within a bucket.
    """
    keys = list(keys)
    df = df.withColumn("_v", value)
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    totals = df.groupBy(*keys, bucket).agg(F.sum("_v").alias("_t"))
    outer = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    before = totals.withColumn("_b", F.sum("_t").over(outer) - F.col("_t")).drop("_t")
    return df.withColumn("_w", F.sum("_v").over(inner) - F.col("_v")).join(before, [*keys, bucket]).withColumn(out, F.col("_b") + F.col("_w")).drop("_v", "_w", "_b")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df, staged by ranges of (keys, order), with `pos`: each row's place within its keys, from 0; nulls come first.

    Rows that agree in keys and order are interchangeable: their own number breaks the tie, so that even a key or a
    value with a third of all rows is dealt over ranges. Counts by key and range are summed, one row for each.
    """
    keys = list(keys)
    by = [*keys, *order, "_r"]
    ranged = df.withColumn("_r", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = staged(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).drop("_r"), name)
    groups = ranged.groupBy(*keys, "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(groups.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), f"{name}-starts")
    out = ranged.join(small_side(starts), [*keys, "_p"]).withColumn("pos", F.col("_s") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_s", "_first")
    out.staged_at = ranged.staged_at
    return out


def split_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], hot: str) -> DataFrame:
    """rows left-joined with side, which has a row for each of its keys; `hot` (SQL on side) names the keys of many rows.

    The caller's condition must hold for a bounded number of keys (a thousandth of all rows each, say): these are
    broadcast, so that their rows stay where they are, and only the rest is shuffled. Both sides should be staged.
    """
    keys = list(keys)
    many = F.broadcast(side.filter(hot).withColumn("_hot", F.lit(True)))
    found = rows.join(many, keys).drop("_hot")
    rest = rows.join(many.select(*keys, "_hot"), keys, "left").filter("_hot is null").drop("_hot")
    return found.unionByName(rest.join(side.filter(f"not ({hot})"), keys, "left"))


# ---- hashing of whole Arrow batches with numpy -------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (Stafford's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the next batch."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, 1 << 20) + 1
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            _POWERS[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a batch of texts: ASCII upper case folded, split at SPACE, each one as a 64-bit hash.

    hashes: of all words; begin, end: their bytes in `data`; first: the first word of each text, with the total last.
    """

    def __init__(self, strings):
        import pyarrow as pa

        strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
        strings = strings.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        raw = strings.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = _FOLD[data]
        space = _IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a word may not run on into the next text
        edge[offsets] = True
        inside = ~space
        starts = inside & (edge[:-1] | np.concatenate(([True], space[:-1])))
        ends = inside & (edge[1:] | np.concatenate((space[1:], [True])))
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        with np.errstate(over="ignore"):
            up, down = _powers(len(data))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[self.data] * up[: len(data)], dtype=np.uint64)))
            self.down = down
            self.hashes = self.spans(self.begin, self.end)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of `size` words; a shorter text that has words gives its whole sequence."""
    n = np.diff(words.first)
    out, doc = [], []
    with np.errstate(over="ignore"):
        for k in range(1, size + 1):
            chosen = n >= size if k == size else n == k
            if not chosen.any():
                continue
            last = np.maximum(n - k + 1, 0) * chosen
            at = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(last)[:-1])), last) + np.arange(last.sum())
            h = np.full(len(at), np.uint64(k))
            for i in range(k):
                h = mix(h * _BASE + words.hashes[at + i])
            out.append(h)
            doc.append(np.repeat(np.arange(len(n)), last))
    return (np.concatenate(out), np.concatenate(doc)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def slices(batches, column: str, most: int = 1_000_000):
    """Arrow batches cut so that each has about `most` bytes of text at most (one text at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        at, total = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total and total + n > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(batch):
            yield batch.slice(at)
