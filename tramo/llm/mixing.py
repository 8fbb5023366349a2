"""Mixing sources to target weights, in DataFrame operations only.

A token budget goes down a tree of levels (domain, language, source): siblings share their parent's budget by weight, what
a sibling can't supply goes to the other siblings, and only what the whole subtree can't supply goes to the siblings of an
ancestor. Each leaf then takes a prefix of its seeded epochs: whole epochs, and of the last one the documents in seeded
order up to the leaf's budget, the last of them cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm.staging import quoted, small, stage

#: Words, as everywhere in this subpackage: runs of what is not an ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    levels: Sequence[str] = ("domain", "lang", "source")
    #: By level, whole-number weights of names; others get the level's default. A weight of 0 leaves a subtree out.
    weights: Sequence[dict[str, int]] = ({}, {}, {})
    defaults: Sequence[int] = (1, 1, 1)
    #: Budget in thousandths of the tokens there are, unless budget_tokens is given.
    budget_permille: int = 1000
    budget_tokens: int | None = None
    max_epochs: int = 4
    seed: str = "17"
    #: Aimed rows in a bucket of the seeded order.
    bucket_rows: int = 50_000
    #: The column with a document's tokens, and the names of the columns that are added.
    tokens: str = "n_tokens"
    epoch: str = "epoch"
    taken: str = "take_tokens"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(mix: Mixture, k: int) -> Column:
    out = F.lit(mix.defaults[k])
    for name, w in mix.weights[k].items():
        out = F.when(F.col(mix.levels[k]) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """nodes has w, cap and budget (the parent's); adds got: whole tokens, by weight up to cap, the remainder by largest fraction, then name."""
    wide = "decimal(38,0)"
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = own.orderBy(F.col("cap") / F.col("w"), name)
    x = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0)).withColumn("w", F.greatest("w", F.lit(1)))
    x = x.withColumn("b", F.least("budget", F.sum("cap").over(own)).cast(wide))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(wide)
    later = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(wide)
    x = x.withColumn("full", F.col("cap") * later <= (F.col("b") - before) * F.col("w"))
    x = x.withColumn("left", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(own))
    x = x.withColumn("wl", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(own))
    x = x.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast((left * w) div greatest(wl, 1) as bigint)")))
    x = x.withColumn("frac", F.when(F.col("full"), F.lit(-1)).otherwise(F.expr("cast((left * w) % greatest(wl, 1) as bigint)")))
    x = x.withColumn("spare", F.col("b") - F.sum("part").over(own))
    rank = F.row_number().over(own.orderBy(F.col("frac").desc(), name))
    x = x.withColumn("got", (F.col("part") + F.when(~F.col("full") & (rank <= F.col("spare")), 1).otherwise(0)).cast("long"))
    return x.drop("b", "full", "left", "wl", "part", "frac", "spare")


def budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """leaves: the levels and supply (tokens in one epoch). Adds alloc, the leaf's tokens. Groups are as many as leaves, not documents."""
    levels = list(mix.levels)
    # what a subtree can give: nothing where a weight is 0
    cap = F.col("supply") * mix.max_epochs
    for k in range(len(levels)):
        cap = F.when(_weight(mix, k) > 0, cap).otherwise(0)
    leaves = leaves.withColumn("leaf_cap", cap)
    total = leaves.agg(F.sum("supply").alias("all"))
    if mix.budget_tokens is None:
        root = total.select(F.expr(f"coalesce((cast(all as decimal(38,0)) * {mix.budget_permille}) div 1000, 0)").cast("long").alias("budget"))
    else:
        root = total.select(F.lit(mix.budget_tokens).cast("long").alias("budget"))
    above: list[str] = []
    given = root
    for k, level in enumerate(levels):
        nodes = leaves.groupBy(*above, level).agg(F.sum("leaf_cap").alias("cap")).withColumn("w", _weight(mix, k))
        nodes = nodes.join(given, above) if above else nodes.crossJoin(F.broadcast(given))  # one row, or one for each parent
        given = share(nodes, above, level).select(*above, level, F.col("got").alias("budget"))
        above.append(level)
    return leaves.join(given, above).select(*levels, "supply", F.col("budget").alias("alloc"))


def _order(mix: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def _bucket(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def _rows(docs: DataFrame, mix: Mixture, id_col: str, *more: Column) -> DataFrame:
    """id, the levels as l0, l1, ... and n (tokens) of the rows that have tokens; nothing of docs is beside them but `more`."""
    levels = [F.coalesce(quoted(x), F.lit("")).alias(f"l{k}") for k, x in enumerate(mix.levels)]
    return docs.select(quoted(id_col).alias("id"), *levels, quoted(mix.tokens).cast("long").alias("n"), *more).where("n > 0")


def plan(docs: DataFrame, mix: Mixture, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """docs has the levels and tokens. By leaf (l0, l1, ...): alloc, whole epochs, tokens of the last one, and the bucket of the seeded order where those end."""
    levels = [f"l{k}" for k in range(len(mix.levels))]
    base = stage(_rows(docs, mix, id_col), "mix")
    digits = min(7, max(2, math.ceil(math.log(max(1, base.count() / mix.bucket_rows), 16))))
    leaves = stage(base.groupBy(*levels).agg(F.sum("n").alias("supply")), "leaves")
    got = budgets(leaves.withColumnsRenamed(dict(zip(levels, mix.levels, strict=True))), mix).withColumnsRenamed(dict(zip(mix.levels, levels, strict=True)))
    got = stage(got.withColumns({"full": F.expr("alloc div supply"), "rest": F.expr("alloc % supply")}), "alloc")
    rows = base.join(small(got), levels).where("rest > 0").withColumn("bucket", _bucket(_order(mix, F.col("full")), digits))
    sums = rows.groupBy(*levels, "bucket").agg(F.sum("n").alias("t"), F.first("rest").alias("rest"))
    w = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("t").over(w) - F.col("t")).where("before < rest and before + t >= rest")
    ends = sums.select(*levels, F.col("bucket").alias("end"), "before")
    return stage(got.join(ends, levels, "left"), "mixplan"), digits


def select(docs: DataFrame, mix: Mixture, id_col: str = "doc_id") -> DataFrame:
    """docs (with the levels and tokens) as often as it is taken: all its columns, epoch and take_tokens.

    Documents without tokens are never taken; null levels count as the name ''. Rows with the same id and epoch tie and
    are ordered by their tokens. Columns of docs with the names of the two added ones are replaced, all others come back as
    they were, whatever their names. Each document is moved only if it is in the bucket where its leaf's budget ends.
    """
    levels = [f"l{k}" for k in range(len(mix.levels))]
    kept = [quoted(c) for c in docs.columns if c not in (mix.epoch, mix.taken)]
    leaf, digits = plan(docs, mix, id_col)
    leaf = small(leaf.select(*levels, "full", "rest", "end", "before"))
    rows = _rows(docs, mix, id_col, F.struct(*kept).alias("row")).join(leaf, levels)
    rows = rows.withColumn("key", _order(mix, F.col("full"))).withColumn("bucket", _bucket(F.col("key"), digits))
    times = F.col("full") + F.when(F.col("bucket") < F.col("end"), 1).otherwise(0)
    whole = rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("epoch"), F.col("n").alias("taken"))
    w = Window.partitionBy(*levels).orderBy("key", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("bucket = end").withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum("n").over(w), F.lit(0))).where("room > 0")
    both = whole.unionByName(edge.select("row", F.col("full").alias("epoch"), F.least("n", "room").alias("taken")))
    return both.select("row.*", F.col("epoch").alias(mix.epoch), F.col("taken").alias(mix.taken))


def prefix(text: Column, taken: Column, all_tokens: Column) -> Column:
    """The text's first words; a cut text has single spaces between them, a whole one is as it was."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(taken >= all_tokens, text).otherwise(F.array_join(F.slice(words, 1, F.greatest(taken, F.lit(1)).cast("int")), " "))
