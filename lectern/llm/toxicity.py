"""Toxicity by non-negative positive-unlabelled learning: numpy classifiers with a class-prior-corrected risk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, small_side, staged

#: Bounds of the rows that the weights are fitted on. Features are chosen from all training rows, and scores cover every row.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 12_000
BITS, FEATURES, MIN_ROWS = 20, 1_000, 20
#: Word prefixes of so many bytes are features beside whole words.
PREFIXES = (4, 5, 6, 7)
STEPS, RATE, DECAY, THRESHOLD = 400, 0.1, 3e-3, 0.3
DEFAULT_PRIOR = 0.1


def _features(column):
    """Hashed features of a batch of texts: document and feature of every occurrence."""
    words = Words(column)
    length = words.end - words.begin
    found, docs = [words.hashes], [words.doc]
    for n in PREFIXES:
        long = length >= n
        found.append(mix(words.spans(words.begin[long], words.begin[long] + n) + np.uint64(n)))
        docs.append(words.doc[long])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _count_rows(batches):
    """For each feature, the positive and unlabelled rows of this task that have it."""
    import pyarrow as pa

    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in slices(batches, "text"):
        doc, feature = _features(batch.column("text"))
        key = np.unique((doc << BITS) + feature)
        positive = np.asarray(batch.column("positive"), bool)[key >> BITS]
        for row, chosen in ((0, positive), (1, ~positive)):
            counts[row] += np.bincount(key[chosen] & ((1 << BITS) - 1), minlength=1 << BITS)
    used = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["feature", "p", "u"])


def _chosen(column, index: np.ndarray, k: int):
    """Document, feature number and log count of each chosen feature of a batch."""
    doc, feature = _features(column)
    number = index[feature]
    mine = number >= 0
    key, n = np.unique(doc[mine] * k + number[mine], return_counts=True)
    return key // k, key % k, np.log1p(n).astype(np.float32)


def _rows(index: np.ndarray, k: int):
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            doc, number, value = _chosen(batch.column("text"), index, k)
            ends = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.ListArray.from_arrays(pa.array(ends), pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(value))], names=["positive", "number", "value"])

    return run


def fit(x: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss.

    Risk: prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]). Where the second part falls below zero, its
    gradient is reversed, as the method's authors propose, so that the fit cannot go on gaining from it.
    """
    p, u = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior)))
    gw2, gb2 = np.full(x.shape[1], 1e-8, np.float32), 1e-8
    for _ in range(STEPS):
        zp, zu = p @ w + b, u @ w + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(p), su / len(u)  # of prior * E_P[l(+)], E_U[l(-)]
        gn = -prior * sp / len(p)  # of - prior * E_P[l(-)]
        if negative >= 0:
            gw, gb = p.T @ (gp + gn) + u.T @ gu, (gp + gn).sum() + gu.sum()
        else:
            gw, gb = -(p.T @ gn + u.T @ gu), -(gn.sum() + gu.sum())
        gw = gw + DECAY * w
        gw2, gb2 = gw2 + gw * gw, gb2 + gb * gb
        w, b = w - RATE * gw / np.sqrt(gw2), b - RATE * gb / gb2**0.5
    return w, float(b)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 4) = 2", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """Score of each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Confirmed toxic rows outside held_out are the positives, other rows outside it are unlabelled text whatever
    their label. The class prior is the share of toxic rows among the labelled ones outside held_out. Features are
    hashed words and word prefixes; those whose document frequencies differ most between positives and unlabelled
    rows (by z-score) enter the classifier: these frequencies are counted over all rows outside held_out. The weights
    are fitted on at most max_positive and about max_unlabelled rows, taken by a hash of doc_id.

    Very long texts are read whole, a million bytes of text at a time; other columns of docs and labels may have any
    name, and an empty table gives an empty one. A null text is empty; a null doc_id is never held out and never labelled; repeated rows are all scored; null
    labels are ignored, and a doc_id that is labelled both ways counts as toxic. Without positives or unlabelled
    rows every score is the prior (DEFAULT_PRIOR without labels).
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    known = labels.filter("toxic is not null and doc_id is not null").filter(~F.expr(held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    stats = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(DEFAULT_PRIOR if stats is None else float(stats), 1e-3), 0.9)

    ids = staged(known.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive), "positives")
    share = min(1.0, max_unlabelled / max(1, docs.count()))
    pool = docs.filter(~F.col("held_out")).join(small_side(ids.withColumn("positive", F.lit(True))), "doc_id", "left")
    pool = pool.withColumn("positive", F.coalesce("positive", F.lit(False)))
    # A confirmed row is unlabelled text as well, so that the prior holds for the unlabelled rows.
    both_roles = lambda unlabelled: pool.select("text", F.explode(F.array_compact(F.array(F.when(F.col("positive"), F.lit(True)), F.when(unlabelled, F.lit(False))))).alias("positive"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000)
    fitted = staged(both_roles(drawn), "sample")
    n_p, n_u = fitted.agg(F.sum(F.col("positive").cast("int")), F.sum((~F.col("positive")).cast("int"))).first()

    weights = np.zeros(0, np.float32)
    bias, index = float(np.log(prior / (1 - prior))), np.full(1 << BITS, -1, np.int64)
    if n_p and n_u:
        every = both_roles(F.lit(True))
        n_u = pool.count()
        counts = every.mapInArrow(_count_rows, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        p, u, both = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u")) / (n_p + n_u)
        z = F.abs(p - u) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
        top = [r[0] for r in counts.filter(F.col("p") + F.col("u") >= MIN_ROWS).orderBy(z.desc(), "feature").limit(FEATURES).select("feature").collect()]
        index[top] = np.arange(len(top))
        if top:
            rows = fitted.mapInArrow(_rows(index, len(top)), "positive boolean, number array<int>, value array<float>").toArrow()
            x = np.zeros((rows.num_rows, len(top)), np.float32)
            number = rows.column("number").combine_chunks()
            sizes = np.asarray(number.value_lengths())
            x[np.repeat(np.arange(rows.num_rows), sizes), np.asarray(number.flatten())] = np.asarray(rows.column("value").combine_chunks().flatten())
            weights, bias = fit(x, np.asarray(rows.column("positive").combine_chunks().to_numpy(zero_copy_only=False), bool), prior)
    model = spark.sparkContext.broadcast((index, weights, bias))

    def score(batches):
        import pyarrow as pa

        index, weights, bias = model.value
        for batch in slices(batches, "text"):
            z = np.full(len(batch), bias)
            if len(weights):
                doc, number, value = _chosen(batch.column("text"), index, len(weights))
                z += np.bincount(doc, weights[number] * value, len(batch))
            s = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
