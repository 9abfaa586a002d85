"""Mixing sources to target weights by hierarchical budgeting (built-in functions only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_side, staged, texts

LEVELS = ("domain", "lang", "source")
#: Share of the corpus' tokens to select, most passes over a leaf, and the seed of the order within an epoch.
PERCENT, MAX_EPOCHS, SEED = 50, 2, "mix"


def domain_of(source: str = "source") -> Column:
    """The domain of a source: `web`, `books` or `code` by the last digit of its name, for tables without such a column."""
    digit = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9])$", 1)
    return F.when(digit.isin("0", "1", "2", "3", "4"), F.lit("web")).when(digit.isin("5", "6", "7"), F.lit("books")).otherwise(F.lit("code"))


# Weights of nodes (level, name); others weigh 1.
WEIGHTS = {
    ("domain", "web"): 5, ("domain", "books"): 3, ("domain", "code"): 2,
    ("lang", "en"): 6, ("lang", "de"): 2, ("lang", "fr"): 2, ("lang", "es"): 2,
    ("source", "src0"): 2, ("source", "src9"): 4,
}


def _weight(level: str, column: Column, weights: Mapping[tuple[str, str], int]) -> Column:
    out = F.lit(1)
    for (at, name), w in weights.items():
        if at == level:
            out = F.when(column == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(38,0)")


def budgets(leaves: DataFrame, total: Column, levels: Sequence[str], weights: Mapping[tuple[str, str], int], max_epochs: int) -> DataFrame:
    """Budget in tokens of each leaf (levels, tokens): every level shares out its parent's budget by weight.

    A child gets no more than its subtree can give (tokens x max_epochs). What saturated children leave goes to
    their siblings by weight; only what no sibling can take is left to the parent's own siblings, because the
    parent's capacity bounds what it was given. Children are taken in the order of capacity over weight, by which
    the saturated ones come first. Shares are rounded down to whole tokens.
    """
    tree = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("decimal(38,0)"))
    out = None
    for depth, level in enumerate(levels):
        keys = list(levels[: depth + 1])
        nodes = tree.groupBy(*keys).agg(F.sum("cap").cast("decimal(38,0)").alias("cap")).withColumn("w", _weight(level, F.col(level), weights))
        parent = keys[:-1]
        if out is None:
            nodes = nodes.withColumn("given", F.least(total.cast("decimal(38,0)"), F.sum("cap").over(Window.partitionBy(F.lit(0)))))
        else:
            nodes = nodes.join(out.select(*parent, F.col("budget").alias("given")), parent)
        by = [F.lit(0), *parent]
        first = Window.partitionBy(*by).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), level)
        nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
        nodes = nodes.withColumn("rest", F.sum("w").over(first.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)"))
        full = F.col("cap").cast("double") * F.col("rest").cast("double") <= (F.col("given") - F.col("before")).cast("double") * F.col("w").cast("double")
        nodes = nodes.withColumn("full", full)
        group = Window.partitionBy(*by)
        used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
        open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
        share = F.floor((F.col("given") - used).cast("double") * F.col("w").cast("double") / open_w.cast("double"))
        out = nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(share.cast("decimal(38,0)"))).select(*keys, "budget")
    return leaves.join(out, list(levels)).withColumn("budget", F.col("budget").cast("long"))


def mix(
    docs: DataFrame,
    percent: int = PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    weights: Mapping[tuple[str, str], int] = WEIGHTS,
    domain: Column | None = None,
) -> DataFrame:
    """Rows of docs in the mixture, one for each epoch that takes them: domain, epoch, n_tokens, taken_tokens beside their columns.

    The target is `percent` of all tokens (words). A leaf (domain, lang, source) with a budget of q whole passes and
    a rest gives every row in epochs 0..q-1 and, in epoch q, the prefix of its rows in the order of
    md5(seed:epoch:doc_id), then md5 of the text, whose tokens reach the rest; the last row counts for what fits.
    The prefix is found by summing tokens over buckets of the order (its first three hex digits) and then within the
    one bucket where it ends, so that no leaf is sorted as a whole.

    A given column `domain` is used where no expression is; given columns n_tokens, epoch and taken_tokens are
    replaced, and others may have any name. Null domain, lang, source, text or doc_id are read as empty strings in levels, order and count; repeated rows take part
    as rows of equal order (all or the prefix of them by a running count); rows without a word are never taken; an
    empty table gives an empty one.
    """
    own = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch", "taken_tokens")]
    level = domain if domain is not None else F.col("domain").cast("string") if "domain" in docs.columns else domain_of()
    empty = F.lit("")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), "doc_id", "text", F.coalesce(level, empty).alias("domain"), F.coalesce("lang", empty).alias("_lang"), F.coalesce("source", empty).alias("_source"))
    keyed = keyed.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).filter("n_tokens > 0")
    levels = ["domain", "_lang", "_source"]
    leaves = keyed.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    leaves = staged(leaves, "leaves")
    total = leaves.agg(F.floor(F.coalesce(F.sum(F.col("tokens").cast("decimal(38,0)")), F.lit(0)) * percent / 100).cast("long").alias("_total"))
    renamed = {("_" + a if a != "domain" else a, b): w for (a, b), w in weights.items()}
    plan = budgets(leaves, F.lit(total.first()[0]), levels, renamed, max_epochs)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    plan = small_side(staged(plan.select(*levels, "passes", "rest"), "budgets"))

    placed = keyed.join(plan, levels).withColumn("_order", F.concat(F.md5(F.concat(F.lit(seed + ":"), F.col("passes").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.md5("text")))
    placed = placed.withColumn("_bucket", F.substring("_order", 1, 3))
    sums = placed.filter("rest > 0").groupBy(*levels, "_bucket").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    run = Window.partitionBy(*levels).orderBy("_bucket")
    sums = sums.withColumn("_before", F.sum("t").over(run) - F.col("t"))
    edge = staged(sums.filter((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("t") >= F.col("rest"))).select(*levels, F.col("_bucket").alias("_edge"), "_before"), "edges")
    placed = placed.join(small_side(edge), levels, "left")
    within = Window.partitionBy(*levels).orderBy("_order")
    # Only the rows of the one bucket where the prefix ends are put in order.
    last = placed.filter(F.col("_bucket") == F.col("_edge"))
    last = last.select("doc_id", *levels, "_order", "n_tokens", "rest", "_before").withColumn("_copy", F.lit(1))
    last = last.groupBy("doc_id", *levels, "_order", "n_tokens", "rest", "_before").agg(F.sum("_copy").alias("_copies"))
    last = last.withColumn("_at", F.col("_before") + F.sum(F.col("n_tokens") * F.col("_copies")).over(within) - F.col("n_tokens") * F.col("_copies")).filter("_at < rest")
    last = staged(last.select(*levels, F.col("_order").alias("_o"), F.col("_at")), "cut")
    cut = last.groupBy(*levels).agg(F.max_by("_o", "_o").alias("_o"), F.max("_at").alias("_at"))
    placed = placed.join(small_side(cut), levels, "left")
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("passes") - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("taken_tokens"))))
    taken = F.when(F.col("_order") == F.col("_o"), F.least(F.col("n_tokens"), F.col("rest") - F.col("_at"))).otherwise(F.col("n_tokens"))
    part = F.when((F.col("rest") > 0) & (F.col("_edge").isNull() | (F.col("_order") <= F.col("_o"))), F.array(F.struct(F.col("passes").alias("epoch"), taken.alias("taken_tokens"))))
    none = F.expr("cast(array() as array<struct<epoch:int,taken_tokens:bigint>>)")
    out = placed.withColumn("_e", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(part, none))))
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in own), "domain", "n_tokens", F.col("_e.epoch").alias("epoch"), F.col("_e.taken_tokens").alias("taken_tokens"))


def sql(percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED, table: str = "documents") -> str:
    """DuckDB SQL for doc_id, domain, lang, source, epoch, n_tokens, taken_tokens of `mix` (rows of distinct doc_ids)."""
    cases = lambda level, c: "CASE " + " ".join(f"WHEN {c} = '{n}' THEN {w}" for (a, n), w in WEIGHTS.items() if a == level) + " ELSE 1 END"
    out = f"""
k AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
  CASE WHEN regexp_matches(coalesce(source, ''), '[0-4]$') THEN 'web' WHEN regexp_matches(coalesce(source, ''), '[5-7]$') THEN 'books' ELSE 'code' END AS domain FROM {table}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {max_epochs} AS cap FROM k WHERE n_tokens > 0 GROUP BY ALL),
b0 AS (SELECT (sum(tokens) * {percent}) // 100 AS budget FROM leaf)"""
    for depth, level in enumerate(LEVELS):
        keys, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        given = f"JOIN b{depth} USING ({up})" if up else "CROSS JOIN b0"
        by = f"PARTITION BY {up}" if up else ""
        out += f""",
n{depth} AS (SELECT {keys}, sum(cap) AS cap, {cases(level, level)} AS w FROM leaf GROUP BY {keys}),
g{depth} AS (SELECT n{depth}.*, {"budget" if up else "least(budget, sum(cap) OVER ())"} AS given FROM n{depth} {given}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remain FROM g{depth} WINDOW q AS ({by} ORDER BY cap::DOUBLE / w, {level})),
f{depth} AS (SELECT *, cap::DOUBLE * remain <= (given - before)::DOUBLE * w AS sat FROM o{depth}),
b{depth + 1} AS (SELECT {keys}, CASE WHEN sat THEN cap ELSE floor((given - coalesce(sum(cap) FILTER (sat) OVER p, 0))::DOUBLE * w / sum(w) FILTER (NOT sat) OVER p)::HUGEINT END AS budget FROM f{depth} WINDOW p AS ({by}))"""
    return (
        "WITH "
        + out
        + f""",
plan AS (SELECT domain, lang, source, (budget // tokens)::INT AS passes, (budget % tokens)::BIGINT AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
placed AS (SELECT k.*, passes, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || passes || ':' || coalesce(doc_id::VARCHAR, '')) || md5(text)) - n_tokens AS ahead FROM k JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
picked AS (SELECT *, unnest(range(passes)) AS epoch, n_tokens AS taken FROM placed UNION ALL SELECT *, passes AS epoch, least(n_tokens, rest - ahead) AS taken FROM placed WHERE ahead < rest)
"""
    )


SQL = sql() + "SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens, taken::BIGINT AS taken_tokens FROM picked"
