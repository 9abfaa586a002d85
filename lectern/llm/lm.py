"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, staged

#: Children of a class. Words with LEAST training tokens or more are modelled, 16 ** MOST_DEPTH at most, which bounds the
#: memory of a task; the depth of their tree follows from their number. Other words fall into RARE classes by their ending.
CHILDREN, LEAST, MOST_DEPTH, RARE, ENDING = 16, 32, 4, 16, 3
#: Tokens for each row of hashed weights, and powers of two of rows at least and at most (memory of a task, and of a sum).
TOKENS_A_ROW, FEW_ROWS, MOST_ROWS = 64, 10, 15
#: Kinds of neighbours that tell which words are alike.
CONTEXTS = 16
#: Tokens of a step, learning rate, and for each round of averaging the eighths of the training rows that it takes.
STEP, RATE, ROUNDS = 2_048, 0.1, ((0,), (1, 2, 3), (4, 5, 6, 7))
#: Counts of the most frequent words, so many at most, go to every task; other words are joined.
KNOWN = 131_072
TRAIN = "coalesce(pmod(crc32(cast(doc_id as string)), 7) <> 2, true)"
_END = np.array([0x5EED5EED5EED5EED], np.uint64)


class Tokens:
    """Tokens of a batch (words, then one end for each text): hashes, rare class of each, text of each."""

    def __init__(self, column):
        words = Words(column)
        n = np.diff(words.first)
        at = np.arange(len(words.hashes)) + words.doc  # an end stands before each later text
        size = len(words.hashes) + len(n)
        self.hashes, self.rare = np.full(size, _END[0]), np.zeros(size, np.int64)
        self.hashes[at] = words.hashes
        tail = words.spans(np.maximum(words.begin, words.end - ENDING), words.end)
        self.rare[at] = (tail % np.uint64(RARE)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.first = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
        self.counts = n + 1


def _counted(batches):
    """Hash, rare class and count of the words of a task, summed over a few million at a time."""
    import pyarrow as pa

    held: list[tuple] = []

    def flush():
        h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(total)], names=["word", "rare", "c"])

    for batch in slices(batches, "text"):
        tokens = Tokens(batch.column("text"))
        u, first, n = np.unique(tokens.hashes, return_index=True, return_counts=True)
        held.append((u, tokens.rare[first], n))
        if sum(len(x[0]) for x in held) > 2_000_000:
            yield flush()
    if held:
        yield flush()


def depth_of(words: int) -> int:
    """Levels of a tree of classes for so many words, two at least."""
    depth = 2
    while CHILDREN**depth < words:
        depth += 1
    return depth


def slots_of(words: int) -> np.ndarray:
    """Leaves of the tree for words in order, spread evenly."""
    return np.arange(words) * CHILDREN ** depth_of(words) // max(words, 1)


class Model:
    """A tree of classes over the frequent words, and weights in hashed rows.

    `a`: root classes and rare classes, by the previous symbol, the one before it (a skip feature) and their pair.
    `d`: children of the other classes, by class and previous symbol.
    `sa`, `sd`: sums of squared gradients of the rows. Biases are log shares of counts. A symbol is a leaf or a rare class.
    """

    def __init__(self, vocabulary: np.ndarray, slots: np.ndarray, counts: np.ndarray, rare: np.ndarray, rows: int):
        order = np.argsort(vocabulary)
        self.sorted, self.slot = vocabulary[order], slots[order]
        self.depth = depth_of(len(vocabulary))
        leaves = np.zeros(CHILDREN**self.depth)
        leaves[slots] = counts
        shares = [leaves.reshape(CHILDREN**k, -1).sum(1).reshape(-1, CHILDREN) for k in range(1, self.depth + 1)]
        top = np.maximum(np.concatenate([shares[0][0], rare]), 1e-9)
        self.top_bias = np.log(top / top.sum()).astype(np.float32)
        below = np.maximum(np.concatenate(shares[1:]), 1e-9)
        self.bias = np.log(below / below.sum(1, keepdims=True)).astype(np.float32)
        self.a, self.d = np.zeros((rows, CHILDREN + RARE), np.float32), np.zeros((2 * rows, CHILDREN), np.float32)
        self.sa, self.sd = np.zeros(len(self.a), np.float32), np.zeros(len(self.d), np.float32)

    def weights(self) -> tuple:
        return self.sorted, self.slot, self.depth, self.top_bias, self.bias, self.a, self.d, self.sa, self.sd

    @classmethod
    def of(cls, weights: tuple, copy: bool = False) -> Model:
        """A model on shared weights, or on copies of those that training moves."""
        model = cls.__new__(cls)
        model.sorted, model.slot, model.depth, model.top_bias, model.bias = weights[:5]
        model.a, model.d, model.sa, model.sd = (w.copy() if copy else w for w in weights[5:])
        return model

    def symbols(self, tokens: Tokens) -> np.ndarray:
        at, known = found(self.sorted, tokens.hashes)
        return np.where(known, self.slot[at] if len(self.sorted) else 0, CHILDREN**self.depth + tokens.rare)

    def coarse(self, symbols: np.ndarray) -> np.ndarray:
        """Root class, rare class or start."""
        leaves = CHILDREN**self.depth
        return np.where(symbols < leaves, symbols // (leaves // CHILDREN), symbols - leaves + CHILDREN)

    def history(self, tokens: Tokens, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Previous symbol of each token and the one before it; the start of a text is a symbol."""
        start = CHILDREN**self.depth + RARE
        one, two = (np.full(len(symbols) + k, start) for k in (1, 2))
        one[1:], two[2:] = symbols, symbols
        one, two = one[: len(symbols)], two[: len(symbols)]
        one[tokens.first] = two[tokens.first] = start
        two[(tokens.first + 1)[tokens.counts > 1]] = start
        return one, two

    def top(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray):
        """Rows of `a` and target of each token."""
        size = CHILDREN**self.depth + RARE + 1
        return hashed(len(self.a), one, size + two, 2 * size + two * size + one), self.coarse(symbols)

    def below(self, symbols: np.ndarray, one: np.ndarray):
        """For tokens that are leaves, and each level below the root: rows of `d`, target, class."""
        size = CHILDREN**self.depth + RARE + 1
        node = np.concatenate([symbols // CHILDREN ** (self.depth - k) + (CHILDREN**k - CHILDREN) // (CHILDREN - 1) for k in range(1, self.depth)])
        target = np.concatenate([symbols // CHILDREN ** (self.depth - k - 1) % CHILDREN for k in range(1, self.depth)])
        return hashed(len(self.d), node * size + np.tile(one, self.depth - 1)), target, node


def found(ordered: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in ordered ones, and whether it is there."""
    if not len(ordered):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)
    return at, ordered[at] == hashes


def hashed(rows: int, *features: np.ndarray) -> np.ndarray:
    """Row of each feature; `rows` is a power of two."""
    with np.errstate(over="ignore"):
        return np.stack([(mix(f.astype(np.uint64)) & np.uint64(rows - 1)).astype(np.int64) for f in features])


def _exponentials(rows: np.ndarray, table: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the sum of table rows and bias, less each row's largest where any might overflow or vanish, and its sums."""
    z = table.take(rows[0], 0) + bias
    for r in rows[1:]:
        z += table.take(r, 0)
    if not -60 < z.min() <= z.max() < 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def log_share(rows: np.ndarray, target: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Log of the target's probability."""
    z, total = _exponentials(rows, table, bias)
    return np.log(np.maximum(z[np.arange(len(target)), target] / total, 1e-30))


def softmax(rows: np.ndarray, target: np.ndarray, table: np.ndarray, bias: np.ndarray):
    """Softmax over the sum of table rows and bias: probabilities, and the log of the target's."""
    z, total = _exponentials(rows, table, bias)
    z /= total[:, None]
    return z, np.log(np.maximum(z[np.arange(len(target)), target], 1e-30))


def _summed(p: np.ndarray, order: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of the runs of p's rows in that order; only runs of several rows are reduced, two columns at once."""
    g = p.take(order[starts], 0)
    several = times > 1
    if several.any():
        at = np.cumsum(times[several]) - times[several]
        many = p.take(order[np.repeat(several, times)], 0)
        pairs = many.view(np.result_type(p.dtype, np.complex64))
        g[several] = np.add.reduceat(pairs, at, axis=0).view(p.dtype)
    return g


def _descend(rows, target, table, bias, used, squares) -> None:
    """One step of all weights that the tokens use, scaled by the sums of squares of their rows."""
    p, total = _exponentials(rows, table, bias)
    p /= total[:, None]
    p[np.arange(len(target)), target] -= 1
    flat = rows.ravel()
    order = np.argsort(flat.astype(np.uint16) if len(table) <= 1 << 16 else flat, kind="stable")  # 16 bits are sorted by radix
    at = flat[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    times = np.diff(np.concatenate((starts, [len(at)])))
    mine = at[starts]
    g = _summed(p, order % len(target) if len(rows) > 1 else order, starts, times)
    used[mine] += times
    squares[mine] += np.einsum("ij,ij->i", g, g) / g.shape[1]
    g *= (RATE / np.sqrt(squares[mine] + 1e-6))[:, None]
    table[mine] = table.take(mine, 0) - g


BLOCK = 512


def _sent(parts):
    """Blocks of rows that were used: (uses, values) of each part."""
    import pyarrow as pa
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    for k, (uses, values) in enumerate(parts):
        for b in range(0, len(uses), BLOCK):
            n = uses[b : b + BLOCK]
            if n.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([task], pa.int64()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([values[b : b + BLOCK].astype(np.float32).tobytes()], pa.binary())],
                    names=["part", "block", "task", "uses", "moved"],
                )


def _contexts(shared):
    """Task function: how often the words of a vocabulary stand beside words of each kind, by block of words."""

    def run(batches):
        ordered, rank = shared.value
        n = np.zeros(len(ordered) * CONTEXTS, np.int64)
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column("text"))
            at, known = found(ordered, tokens.hashes)
            word = np.where(known, rank[at] if len(ordered) else 0, -1)
            beside = (word[1:] >= 0) & (word[:-1] >= 0) & (tokens.doc[1:] == tokens.doc[:-1])
            left, right = word[:-1][beside], word[1:][beside]
            for x, y in ((left, right), (right, left)):
                n += np.bincount(x * CONTEXTS + y % CONTEXTS, minlength=len(n))
        n = n.reshape(-1, CONTEXTS)
        yield from _sent([(n.sum(1), n)])

    return run


def alike(contexts: np.ndarray) -> np.ndarray:
    """Order of words in which those of like neighbours lie together: halved again and again along the main axis."""
    total = contexts.sum(0)
    shares = contexts + CONTEXTS * (total + 1) / (total + 1).sum()
    x = np.sqrt(shares / shares.sum(1, keepdims=True))
    done, open_ = [], [np.arange(len(x))]
    while open_:
        index = open_.pop()
        if len(index):
            moved = x[index] - x[index].mean(0)
            axis = np.linalg.eigh(moved.T @ moved)[1][:, -1]
            index = index[np.argsort(moved @ (axis * np.sign(axis[np.abs(axis).argmax()])), kind="stable")]
        if len(index) <= 64:
            done.append(index)
        else:
            open_ += [index[len(index) // 2 :], index[: len(index) // 2]]
    return np.concatenate(done)


def _train(shared):
    """Task function: gradient steps over the task's texts from the shared weights; moves times uses, by block of rows."""

    def run(batches):
        start, model = Model.of(shared.value), Model.of(shared.value, copy=True)
        used = [np.zeros(len(t), np.float32) for t in (model.a, model.d)]
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column("text"))
            symbols = model.symbols(tokens)
            one, two = model.history(tokens, symbols)
            for at in range(0, len(symbols), STEP):
                now = symbols[at : at + STEP], one[at : at + STEP], two[at : at + STEP]
                _descend(*model.top(*now), model.a, model.top_bias, used[0], model.sa)
                leaf = now[0] < CHILDREN**model.depth
                if leaf.any():
                    rows, target, node = model.below(now[0][leaf], now[1][leaf])
                    _descend(rows, target, model.d, model.bias.take(node, 0), used[1], model.sd)
        moves = (np.column_stack([t - t0, s - s0]) for t, t0, s, s0 in ((model.a, start.a, model.sa, start.sa), (model.d, start.d, model.sd, start.sd)))
        yield from _sent([(n, m * n[:, None]) for n, m in zip(used, moves, strict=True)])

    return run


_BLOCKS = "part int, block int, task long, uses binary, moved binary"


def _added(key, group):
    import pandas as pd

    total = lambda name: np.sum([np.frombuffer(x, np.float32) for x in group[name]], axis=0, dtype=np.float32).tobytes()
    return pd.DataFrame({"part": [group["part"].iloc[0]], "block": [group["block"].iloc[0]], "task": [group["task"].iloc[0]], "uses": [total("uses")], "moved": [total("moved")]})


def _sums(made: DataFrame):
    """Blocks of all tasks, summed in a tree: part, first row, uses, values. As many as the model has blocks."""
    for span in (64, 64, None):
        made = made.withColumn("task", F.floor(F.col("task") / span) if span else F.lit(0).cast("long"))
        made = made.groupBy("part", "block", "task").applyInPandas(_added, _BLOCKS)
    for row in made.collect():
        n = np.frombuffer(row["uses"], np.float32)
        yield row["part"], row["block"], n, np.frombuffer(row["moved"], np.float32).reshape(len(n), -1)


def model_log(model: Model, tokens: Tokens, symbols: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each symbol after those before it."""
    one, two = model.history(tokens, symbols)
    log = np.zeros(len(symbols))
    for at in range(0, len(symbols), STEP):
        now = symbols[at : at + STEP], one[at : at + STEP], two[at : at + STEP]
        log[at : at + STEP] = log_share(*model.top(*now), model.a, model.top_bias)
        leaf = np.flatnonzero(now[0] < CHILDREN**model.depth)
        if len(leaf):
            rows, target, node = model.below(now[0][leaf], now[1][leaf])
            log[leaf + at] += log_share(rows, target, model.d, model.bias.take(node, 0)).reshape(-1, len(leaf)).sum(0)
    return log


def _score(shared):
    """Task function: parts of the scores that the shared model and counts give, and each text's other words."""

    def run(batches):
        import pyarrow as pa

        weights, words, counts, base_log, rare_log = shared.value
        model = Model.of(weights)
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column("text"))
            n, symbols = len(batch), model.symbols(tokens)
            frequent = symbols < CHILDREN**model.depth
            log = model_log(model, tokens, symbols)
            log /= np.log(10)
            at, known = found(words, tokens.hashes)
            c = np.where(known, counts[at] if len(words) else 0, 0)
            base = np.where(known, np.log10(c + 1.0) - base_log, 0)
            log += np.where(known & ~frequent, np.log10(c + 1.0) - rare_log[tokens.rare], 0)
            other = np.flatnonzero(~known)
            order = other[np.lexsort((tokens.hashes[other], tokens.doc[other]))]
            h, d = tokens.hashes[order], tokens.doc[order]
            starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(order) else np.zeros(0, int)
            times = np.diff(np.concatenate((starts, [len(order)]))) if len(order) else np.zeros(0, int)
            ends = np.searchsorted(d[starts], np.arange(n + 1)).astype(np.int32) if len(order) else np.zeros(n + 1, np.int32)
            rest = pa.StructArray.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(tokens.rare[order][starts].astype(np.int32)), pa.array(times.astype(np.int32))], names=["word", "rare", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens.counts.astype(np.int64)), pa.array(np.bincount(tokens.doc, known, n).astype(np.int64)), pa.array(np.bincount(tokens.doc, base, n)), pa.array(np.bincount(tokens.doc, log, n)), pa.ListArray.from_arrays(pa.array(ends), rest)],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "log", "rest"],
            )

    return run


def lm_scores(docs: DataFrame, train: str = TRAIN) -> DataFrame:
    """Scores of each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words of the rows that `train` selects are counted by their 64-bit hash. The most frequent ones are the model's
    vocabulary, in a tree of classes that puts words of like neighbours together; every other word belongs to a rare
    class by a hash of its last bytes. The model gives P(root or rare class | history) from the previous symbol, the
    one before it (a skip feature) and their pair, then P(child | class, previous symbol) at each level down to a word, or
    (c + 1) / (N + V + 1) over the counts of a rare class, whose 1 is for unseen words. The number of words, the depth
    of the tree and the rows of weights follow from the training counts, up to the memory of a task. Each round, tasks
    take gradient steps over their own share of the training rows, every row in one round; moved weights are averaged
    by use in a tree of sums, of the model's size. Counts of the KNOWN most frequent words go to all tasks; other
    words are joined by hash.

    A null text is empty (the end token alone); a null doc_id is not held out; repeated rows are all scored, and
    count as often as they occur; with no training rows all counts are 0 and the weights stay at their start.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~F.expr(train)).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = staged(training.select("text").mapInArrow(_counted, "word long, rare int, c long").groupBy("word").agg(F.min("rare").alias("rare"), F.sum("c").alias("c")), "counts")

    level = F.floor(F.log2("c") * 8).cast("int")
    levels = counts.groupBy(level.alias("l"), "rare").agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # RARE rows for each of a few hundred levels
    total, distinct = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
    least, have = 1 << 30, 0
    for l in sorted({r["l"] for r in levels}, reverse=True):
        have += sum(r["v"] for r in levels if r["l"] == l)
        if have > KNOWN:
            break
        least = l
    top = counts.filter(level >= least).toArrow()
    words, rare, c = (top.column(k).to_numpy() for k in ("word", "rare", "c"))
    order = np.lexsort((words, -c))
    words, rare, c = words[order].view(np.uint64), rare[order], c[order]
    modelled = min(int((c >= LEAST).sum()), CHILDREN**MOST_DEPTH)
    vocabulary = words[:modelled]

    ranks = np.argsort(vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary[ranks], ranks))
    contexts = np.zeros((modelled, CONTEXTS))
    if modelled:
        for _, b, _, values in _sums(training.select("text").mapInArrow(_contexts(shared), _BLOCKS)):
            contexts[b : b + len(values)] += values
    slots = np.zeros(modelled, np.int64)
    if modelled:
        slots[alike(contexts)] = slots_of(modelled)
    sizes = np.ones((RARE, 2))
    for r in levels:
        sizes[r["rare"]] += (r["n"], r["v"])
    np.subtract.at(sizes, rare[:modelled], np.stack([c[:modelled], np.ones(modelled)], 1))
    rows = 1 << int(np.clip(np.ceil(np.log2(max(total or 0, 1) / TOKENS_A_ROW)), FEW_ROWS, MOST_ROWS))
    model = Model(vocabulary, slots, c[:modelled], sizes[:, 0], rows)
    rare_log = np.log10(np.maximum(sizes.sum(1) - 1, 1))  # N + V + 1 of each rare class

    for eighths in ROUNDS:
        shared = spark.sparkContext.broadcast(model.weights())
        part = training.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(8)).isin(*eighths)).select("text")
        for k, b, n, moved in _sums(part.mapInArrow(_train(shared), _BLOCKS)):
            table, squares = ((model.a, model.sa), (model.d, model.sd))[k]
            moved = moved / np.maximum(n, 1)[:, None]
            table[b : b + len(n)] += moved[:, :-1]
            squares[b : b + len(n)] += moved[:, -1]

    base_log = float(np.log10(total + distinct + 1))
    order = np.argsort(words)
    shared = spark.sparkContext.broadcast((model.weights(), words[order], c[order].astype(float), base_log, rare_log))
    made = docs.mapInArrow(_score(shared), f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, log double, rest array<struct<word:long,rare:int,n:int>>")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = made.select("row", F.explode("rest").alias("e")).select("row", "e.word", F.col("e.rare").alias("k"), "e.n")
    c1 = F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    rare_of = F.get(F.array(*[F.lit(float(x)) for x in rare_log]), F.col("k"))
    seen = rest.join(counts.filter(level < least).select("word", "c"), "word", "left")
    seen = seen.groupBy("row").agg(F.sum(F.col("n") * (c1 - base_log)).alias("b"), F.sum(F.col("n") * (c1 - rare_of)).alias("s"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("k"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return made.drop("rest").join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("k")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("log") + zero("s")).alias("score")
    )
