"""Packing of token sequences by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum, slices, staged

TOKENIZER = "byte_bpe_50k.json"
WINDOW, END, DEPTH, STEPS = 1024, 0, 3, 400


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _encoder(path: str):
    """An encoder with the vocabulary of a byte-level BPE file of `tokenizers`, whose ids are its merge ranks.

    The same ids come out about four times as fast as from the library that the file is for, which takes the texts
    that the fast one fails on.
    """
    import json

    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    # The split rule of this kind of tokenizer (fixed value).
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast, special = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), frozenset(added)
    own = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special=special, disallowed_special=())
        except Exception:  # what its pattern can't split, as a million blanks
            import tokenizers

            if not own:
                own.append(tokenizers.Tokenizer.from_file(path))
            return own[0].encode(text, add_special_tokens=False).ids

    return encode


def _tokens(path: str, window: int, end: int):
    """Task function: per row its token count, the crc32 of each full window, and of each part of what is left.

    The rest is described in parts whose sizes are the powers of two in its length, largest first, so that it can
    later be cut between them without the ids.
    """
    import zlib

    import pyarrow as pa

    def run(batches):
        encode = _encoder(path)
        crc = lambda ids: zlib.crc32(ids.tobytes())
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                ids = np.array([*encode(text or ""), end], "<u4")
                full = len(ids) // window
                rest, parts, at = len(ids) - full * window, [], full * window
                for bit in range(window.bit_length() - 1, -1, -1):
                    if rest >> bit & 1:
                        parts.append(crc(ids[at : at + (1 << bit)]))
                        at += 1 << bit
                out.append((len(ids), [crc(ids[i * window : (i + 1) * window]) for i in range(full)], rest, crc(ids[full * window :]) if rest else 0, parts))
            n, full, rest, rest_crc, parts = zip(*out, strict=True)
            crcs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(full, crcs), pa.array(rest, pa.int32()), pa.array(rest_crc, pa.int64()), pa.array(parts, crcs)],
                names=["doc_id", "doc_tokens", "full", "rest", "rest_crc", "parts"],
            )

    return run


def combinations(lengths: np.ndarray, window: int, depth: int) -> np.ndarray:
    """Rows of up to `depth` lengths, largest first and zero-filled, that fill the window exactly."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    rows = [np.array([[window] + [0] * (depth - 1)])] if have[window] else []
    a = lengths[lengths <= window - 1]
    if depth >= 2:
        pair = a[(window - a <= a) & have[window - a]]
        rows.append(np.stack([pair, window - pair, *[np.zeros_like(pair)] * (depth - 2)], 1))
    if depth >= 3:
        x, y = (v.ravel() for v in np.meshgrid(a, a, indexing="ij"))
        z = window - x - y
        ok = (x >= y) & (y >= z) & (z > 0)
        ok &= have[np.where(ok, z, 0)]
        rows.append(np.stack([x[ok], y[ok], z[ok], *[np.zeros(ok.sum(), x.dtype)] * (depth - 3)], 1))
    return np.concatenate(rows) if rows else np.zeros((0, depth), int)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Whole repeat counts of combinations: accelerated projected gradient on |A x - histogram|^2, x >= 0, rounded down.

    After rounding, counts are cut (most used combinations first) so that no length is used more often than it occurs.
    """
    window, m = len(histogram) - 1, len(combos)
    if not m:
        return np.zeros(0, np.int64)
    real = combos > 0
    scale = max(1.0, float(histogram.max()))
    h = histogram / scale
    # Each combination's step follows the Lipschitz bound of its lengths' rows.
    degree = np.bincount(combos[real], minlength=window + 1)
    step = 1.0 / np.maximum(1, (degree[combos] * real).sum(1))
    x = y = np.zeros(m)
    t = 1.0
    for _ in range(steps):
        fit = np.bincount(combos.ravel(), np.where(real, y[:, None], 0).ravel(), window + 1) - h
        fit[0] = 0
        new = np.maximum(0, y - step * fit[combos].sum(1))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (last - 1) / t * (new - x), new
    want = np.floor(x * scale + 1e-9).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for i in np.argsort(-want, kind="stable"):
        if not want[i]:
            break
        n, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        want[i] = min(want[i], int((left[n] // times).min()))
        left[n] -= want[i] * times
    # What rounding left is offered to the same combinations once more, largest first part first.
    for i in np.lexsort(tuple(-combos.T[::-1])):
        n = combos[i][combos[i] > 0]
        if left[n].all():
            n, times = np.unique(n, return_counts=True)
            more = int((left[n] // times).min())
            want[i] += more
            left[n] -= more * times
    return want


def _slots(combos: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which a use begins (with the total last), and sequence and offset at its beginning."""
    base, found = 0, {}
    for row, n in zip(combos[counts > 0].tolist(), counts[counts > 0].tolist(), strict=True):
        at = 0
        for length in (x for x in row if x):
            found.setdefault(length, []).append((n, base, at))
            at += length
        base += n
    return {k: (np.cumsum([0, *(n for n, _, _ in v)]), np.array([b for _, b, _ in v]), np.array([a for _, _, a in v])) for k, v in found.items()}


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None, depth: int = DEPTH) -> DataFrame:
    """Pieces of the token sequences of docs (doc_id, text), each with its place in a training sequence.

    A document's ids and `end` are cut into full windows and a rest. The histogram of rests (window - 1 numbers) goes
    to the driver, where combinations of at most `depth` lengths that fill a window are solved for by non-negative
    least squares and rounded down. The k-th rest of a length takes the k-th slot of that length; ranks come from
    sums over buckets, so that a frequent length is no single task. Residual rests are cut into powers of two and
    packed greedily, largest first, which fills every window; the last, incomplete one is split into sequences whose
    sizes are powers of two. So nothing is padded.

    A null text is empty (one piece: the end id); null or repeated doc_ids are rows like others; an empty table gives
    an empty one. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_tokens(path, window, end), f"doc_id {kind}, doc_tokens long, full array<long>, rest int, rest_crc long, parts array<long>")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "tokens")
    made = made.withColumn("bucket", F.shiftright("row", 33)).withColumn("_n", F.size("full"))

    full = running_sum(made.filter("_n > 0").select("doc_id", "doc_tokens", "row", "bucket", "full", "_n"), [], "bucket", ["row"], F.col("_n").cast("long"), "base")
    full = full.select("doc_id", "doc_tokens", "base", F.posexplode("full").alias("k", "ids_crc32"))
    n_full = made.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    full = full.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    histogram = np.zeros(window + 1, np.int64)
    for rest, n in made.filter("rest > 0").groupBy("rest").count().collect():  # at most window - 1 rows
        histogram[rest] = n
    combos = combinations(np.flatnonzero(histogram), window, depth)
    counts = repeat_counts(histogram, combos)
    slots, n_combined = _slots(combos, counts), int(counts.sum())

    rests = running_sum(made.filter("rest > 0").select("doc_id", "doc_tokens", "row", "bucket", "rest", "rest_crc", "parts"), ["rest"], "bucket", ["row"], F.lit(1).cast("long"), "rank")
    shared = spark.sparkContext.broadcast(slots)  # at most `depth` entries a combination, however large the input

    @F.pandas_udf("struct<sequence:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
        values, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(values):
            if n in shared.value:
                begins, base, at = shared.value[n]
                mine = np.flatnonzero((values == n) & (ranks < begins[-1]))
                use = np.searchsorted(begins, ranks[mine], "right") - 1
                sequence[mine], offset[mine] = base[use] + ranks[mine] - begins[use], at[use]
        return pd.DataFrame({"sequence": sequence, "offset": offset})

    placed = staged(rests.withColumn("p", place("rest", "rank")).select("doc_id", "doc_tokens", "row", "bucket", "rest", "rest_crc", "parts", "p"), "placed")
    start = F.col("doc_tokens") - F.col("rest")
    combined = placed.filter("p.sequence >= 0").select("doc_id", start.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", (F.col("p.sequence") + n_full).alias("sequence_id"), F.col("p.offset").alias("offset"))

    bits = [b for b in range(window.bit_length() - 1, -1, -1)]
    sizes = F.array(*[F.when(F.col("rest").bitwiseAND(1 << b) > 0, F.lit(1 << b)) for b in bits])
    parts = placed.filter("p.sequence < 0").withColumn("sizes", F.array_compact(sizes))
    parts = parts.select("doc_id", "doc_tokens", "row", "bucket", start.alias("start"), "sizes", F.posexplode("parts").alias("k", "ids_crc32"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    parts = parts.withColumn("start", F.col("start") + before).withColumn("size", F.get("sizes", F.col("k"))).drop("sizes")
    parts = running_sum(parts, ["size"], "bucket", ["row"], F.lit(1).cast("long"), "rank")
    bits_of = {r[0]: r[1] for r in placed.filter("p.sequence < 0").select(F.explode(F.array_compact(sizes)).alias("s")).groupBy("s").count().collect()}  # a row for each power of two
    total, base_of = 0, F.lit(0)
    for s in sorted(bits_of, reverse=True):
        base_of = F.when(F.col("size") == s, F.lit(total)).otherwise(base_of)
        total += s * bits_of[s]
    at = base_of.cast("long") + F.col("rank") * F.col("size")
    whole, tail = divmod(total, window)
    into, split, cut = F.lit(0), F.lit(0), 0  # sequences of the tail, and where each begins
    for i, b in enumerate(b for b in bits if tail >> b & 1):
        into, split = F.when(F.col("_in") >= cut, F.lit(i)).otherwise(into), F.when(F.col("_in") >= cut, F.lit(cut)).otherwise(split)
        cut += 1 << b
    parts = parts.withColumn("_at", at).withColumn("_in", F.col("_at") % window).withColumn("_s", F.floor(F.col("_at") / window))
    in_tail = F.col("_s") >= whole
    greedy = parts.select(
        "doc_id",
        "start",
        F.col("size").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("_s") + F.when(in_tail, into).otherwise(F.lit(0)) + (n_full + n_combined)).cast("long").alias("sequence_id"),
        (F.col("_in") - F.when(in_tail, split).otherwise(F.lit(0))).cast("long").alias("offset"),
    )
    return full.unionByName(combined).unionByName(greedy)
