"""Approximate nearest neighbours with balanced posting lists: replicated boundary vectors, a centroid graph and pruning by distance ratio."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors that the centroids are fitted on, those aimed at in a list, and the most lists.
SAMPLE, PER_LIST, MAX_LISTS = 20_000, 50, 4_096
#: Most copies of a vector, and how much farther than the nearest centroid the others may be.
COPIES, COPY_RATIO = 4, 1.10
#: Queries by which the lists to read are chosen (all, if fewer), their nearest rows that must lie in these, and the share of them that the ratio keeps.
TRIALS, RECALL, KEPT = 512, 0.94, 0.998
#: Vectors find their lists by a matrix product up to so many lists, and in the graph beyond; queries always use the graph.
PRODUCT_LISTS = 2_048
#: Edges of a centroid in the graph, and the beam of its search.
EDGES, BEAM = 24, 32
#: Vectors of a posting list that one task holds at once.
BLOCK = 4_096


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1: no square overflows or vanishes, and cosines keep their bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Means of balanced clusters: halves at the median along the 2-means direction until there are `lists`, then two Lloyd steps."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        at = max(range(len(parts)), key=lambda i: len(parts[i]))
        part = parts.pop(at)
        if len(part) < 2:
            parts.append(part)
            break
        a, b = x[rng.choice(part, 2, replace=False)]
        for _ in range(4):
            near = x[part] @ (a - b) > ((a * a).sum() - (b * b).sum()) / 2
            if near.all() or not near.any():
                break
            a, b = x[part[near]].mean(0), x[part[~near]].mean(0)
        order = part[np.argsort(x[part] @ (a - b), kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(2):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def graph(c: np.ndarray, edges: int = EDGES) -> np.ndarray:
    """The nearest centroids of each one, and a ring through all, which keeps the graph connected."""
    d = (c * c).sum(1)[None] - 2 * c @ c.T
    np.fill_diagonal(d, np.inf)
    k = min(edges, len(c) - 1)
    near = np.argpartition(d, k - 1, 1)[:, :k] if k else np.zeros((len(c), 0), int)
    own = np.arange(len(c))[:, None]
    after = (own + 1) % len(c)
    return np.concatenate([near, np.where((near == after).any(1, keepdims=True), own, after)], 1)  # no edge twice


def search_graph(x: np.ndarray, c: np.ndarray, links: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Near centroids of each row of x and their distances, nearest first: best-first search with a beam, all rows in step."""
    n, beam = len(x), min(beam, len(c))
    norm = (c * c).sum(1)
    seen = np.zeros((n, len(c)), bool)
    starts = np.unique(np.linspace(0, len(c) - 1, min(len(c), 32)).astype(int))
    ids = np.broadcast_to(starts, (n, len(starts))).copy()
    seen[:, starts] = True
    dist = norm[starts] - 2 * x @ c[starts].T
    done = np.zeros_like(dist, bool)
    for _ in range(4 * beam):
        open_ = np.where(done, np.inf, dist)
        best = open_.argmin(1)
        live = np.isfinite(open_[np.arange(n), best])
        if not live.any():
            break
        done[np.arange(n), best] = True
        nxt = links[ids[np.arange(n), best]]
        d = norm[nxt] - 2 * np.einsum("nd,nkd->nk", x, c[nxt])
        d[np.take_along_axis(seen, nxt, 1) | ~live[:, None]] = np.inf
        np.put_along_axis(seen, nxt, True, 1)
        ids, dist, done = np.concatenate([ids, nxt], 1), np.concatenate([dist, d], 1), np.concatenate([done, np.zeros_like(d, bool)], 1)
        if dist.shape[1] > beam:
            keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
            ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (ids, dist, done))
    order = dist.argsort(1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    return ids, np.sqrt(np.maximum(dist + (x * x).sum(1)[:, None], 0))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((c * c).sum(1)[None] - 2 * x @ c.T + (x * x).sum(1)[:, None], 0))


def _lists(model, rows: np.ndarray, most: int, ratio: float, walk: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row and list of each choice: the nearest `most` lists within `ratio`, found in the graph where there are many lists or with `walk`."""
    c, links = model
    owner, chosen = [], []
    for at in range(0, len(rows), 1024):
        x = rows[at : at + 1024]
        if walk or len(c) > PRODUCT_LISTS:
            ids, dist = (v[:, :most] for v in search_graph(x, c, links, max(BEAM, 2 * most)))
        else:
            dist = _distances(x, c)
            ids = dist.argsort(1, kind="stable")[:, :most]
            dist = np.take_along_axis(dist, ids, 1)
        r, k = np.nonzero(np.isfinite(dist) & (dist <= ratio * dist[:, :1] + 1e-9))
        owner.append(r + at)
        chosen.append(ids[r, k])
    return np.concatenate(owner), np.concatenate(chosen)


def _trial(shared, k: int):
    """Of a part of the postings: the rows that can be among the k nearest of a trial query, with their lists."""
    def run(batches):
        import pandas as pd

        ids, x = shared.value
        best = None
        for batch in (b for b in batches if len(b)):
            v = _unit(_matrix(batch.column("embedding")))
            near = x @ v.T
            vec, place = batch.column("vec_id").to_numpy(), batch.column("list").to_numpy()
            near[ids[:, None] == vec[None]] = -np.inf
            n = min(near.shape[1], k * COPIES)
            top = np.argpartition(-near, n - 1, 1)[:, :n]
            rows = pd.DataFrame({"query": np.repeat(np.arange(len(x)), n), "vec_id": vec[top].ravel(), "list": place[top].ravel(), "score": np.take_along_axis(near, top, 1).ravel()})
            best = rows if best is None else pd.concat([best, rows])
            best = best.sort_values(["query", "score"], ascending=[True, False]).groupby("query").head(k * COPIES)
        if best is not None:
            import pyarrow as pa

            yield pa.RecordBatch.from_pandas(best[best.score > -np.inf], preserve_index=False)

    return run


def reading(model, trials: np.ndarray, ids: np.ndarray, postings: DataFrame, k: int) -> tuple[int, float, dict]:
    """How many lists a query reads, and within which distance ratio, for RECALL of the k nearest rows of the trial queries.

    The nearest are told by one pass over all postings, so the choice holds at every number of rows and for any shape of
    the data. The third item has what was measured: recall, lists, and copies a vector.
    """
    import pandas as pd

    spark, (c, _) = postings.sparkSession, model
    shared = spark.sparkContext.broadcast((ids, trials))
    found = postings.mapInArrow(_trial(shared, k), "query long, vec_id long, list int, score double")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "list"))
    found = found.withColumn("n", nearest).filter(F.col("n") <= k * COPIES).drop("n").toPandas()  # TRIALS * k * COPIES rows at most
    if found.empty:
        return len(c), np.inf, {"recall": 1.0, "lists": len(c), "read": float(len(c))}
    found = found.drop_duplicates(["query", "vec_id", "list"])
    order = found.drop_duplicates(["query", "vec_id"]).sort_values(["query", "score", "vec_id"], ascending=[True, False, True]).groupby("query").head(k)[["query", "vec_id"]]
    found = found.merge(order, on=["query", "vec_id"])
    dist = _distances(trials, c)
    rank = dist.argsort(1, kind="stable").argsort(1, kind="stable")
    q, at = found["query"].to_numpy(), found["list"].to_numpy()
    found["rank"], found["ratio"] = rank[q, at], dist[q, at] / np.maximum(dist.min(1), 1e-12)[q]
    best = found.groupby(["query", "vec_id"]).min()
    most = int(np.quantile(best["rank"], RECALL, method="higher")) + 1
    while True:
        # The walk may miss a near list: what counts is the recall of the lists that it finds.
        at, lists = _lists(model, trials, most, np.inf, walk=True)
        pairs = pd.MultiIndex.from_arrays([at, lists])
        held = found[pd.MultiIndex.from_frame(found[["query", "list"]]).isin(pairs)].groupby(["query", "vec_id"]).ratio.min()
        recall = len(held) / len(best)
        if recall >= RECALL or most >= len(c):
            break
        most = min(len(c), most + 1 + most // 10)
    ratio = float(np.quantile(held, KEPT, method="higher"))
    read = (dist[at, lists] <= ratio * dist.min(1)[at] + 1e-9).sum() / len(trials)
    return most, ratio, {"recall": float((held <= ratio + 1e-9).sum() / len(best)), "lists": len(c), "read": float(read)}


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows in double precision; equal rows give equal bits, wherever they stand."""
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _assign(shared, most: int, ratio: float, walk: bool = False):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                row, chosen = _lists(shared.value, _unit(_matrix(batch.column("embedding"))), most, ratio, walk)
                picked = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32)), *picked.columns], names=["list", *picked.schema.names])

    return run


def _best(k: int):
    def run(key, queries, postings):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(postings):
            q, v = (_scaled(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (queries, postings))
            ids, norm = postings["vec_id"].to_numpy(), np.sqrt((v * v).sum(1))
            for i, query in enumerate(queries["vec_id"].to_numpy()):
                near = (v @ q[i]) / norm
                near[ids == query] = -np.inf
                n = min(k, len(near))
                edge = np.partition(near, len(near) - n)[len(near) - n]
                # Everything within rounding of the k-th is scored in a way that does not depend on its place.
                some = np.flatnonzero(np.isfinite(near) & (near >= edge - 1e-9 * abs(edge) - 1e-12))
                if len(some):
                    exact = cosine(np.broadcast_to(q[i], (len(some), q.shape[1])), v[some])
                    order = np.lexsort((ids[some], -exact))[:k]
                    out["query_id"].append(np.full(len(order), query))
                    out["vec_id"].append(ids[some][order])
                    out["score"].append(exact[order])
        return pd.DataFrame({a: np.concatenate(b) if b else np.zeros(0) for a, b in out.items()})

    return run


def nearest(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """The k nearest rows found for each row of vectors (vec_id, embedding) that `queries` selects: query_id, rank, vec_id, score.

    Centroids are fitted on at most SAMPLE vectors. A vector is in its nearest list and in up to COPIES nearly as near.
    A query walks the graph of centroids to the lists nearest to it; how many it reads, and up to which distance, is
    measured on TRIALS of the queries against all rows (`reading`), so it holds for queries unlike other rows. Centroids
    are fitted without the queries, to which they would lie nearer than to others (on all rows, if most are queries:
    then trial and other queries are fitted on alike). A query that finds fewer than k vectors there reads all
    lists. Of equal vectors only the k + 1 smallest ids are kept as postings: no other can be among the k nearest of
    any query. Lists are dealt in blocks of about BLOCK vectors, so that a crowded list is no single task.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
    part, nor do rows without vec_id. Of rows that repeat a vec_id and vector one takes part.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(good)
    chosen = F.coalesce(F.expr(queries), F.lit(False))
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"), F.count_if(chosen).alias("asked")).orderBy(F.col("rows").desc(), "n").first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None or not sizes["asked"]:
        return spark.createDataFrame([], out)
    rows = rows.filter(F.size("embedding") == sizes["n"]).dropDuplicates(["vec_id", "embedding"])
    asked, others = rows.filter(chosen), sizes["rows"] - sizes["asked"]
    fitted, n = (rows.filter(~chosen), others) if others > sizes["asked"] else (rows, sizes["rows"])
    drawn = fitted.select("embedding", F.xxhash64("vec_id").alias("h")).filter(F.pmod("h", F.lit(1_000_000)) <= int(min(1.0, SAMPLE / n) * 1_000_000)).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    if not len(drawn):
        drawn = fitted.select("embedding").limit(1).toArrow()
    x = np.unique(_unit(_matrix(drawn.column(0))), axis=0)
    tried = asked.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(TRIALS).select("embedding", "vec_id").toArrow()
    c = centroids(x, max(1, min(MAX_LISTS, round(sizes["rows"] / PER_LIST), len(x) // 4)))
    model = spark.sparkContext.broadcast((c, graph(c)))

    first = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    schema = "list int, vec_id long, embedding array<double>"
    postings = staged(kept.mapInArrow(_assign(model, COPIES, COPY_RATIO), schema), "postings")
    most, ratio, _ = reading(model.value, _unit(_matrix(tried.column(0))), tried.column(1).to_numpy(), postings, k)
    blocks = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # at most MAX_LISTS rows
    near = asked.mapInArrow(_assign(model, most, ratio, walk=True), schema).join(F.broadcast(blocks), "list")
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    postings = postings.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")

    def search(some: DataFrame) -> DataFrame:
        return some.groupBy("list", "block").cogroup(postings.groupBy("list", "block")).applyInPandas(_best(k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])

    found = staged(search(near), "neighbours")
    # Queries whose lists hold fewer than k others read all lists.
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = staged(asked.join(full, "vec_id", "left_anti"), "short-queries")
    if not short.isEmpty():
        every = blocks.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        found = found.unionByName(search(staged(short.crossJoin(F.broadcast(every)).select("list", "vec_id", "embedding", "block"), "short-probes"))).dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
