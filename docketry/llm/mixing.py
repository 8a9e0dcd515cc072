"""Mixing sources to target weights by hierarchical budgets. Built-in functions only.

The levels (say domain, language, source) make a tree whose nodes have weights among their siblings. The token
budget runs down from the root: a node's children share its budget by weight, but none gets more than its leaves
can give in max_epochs readings; what one cannot take goes to its siblings, by weight, and only what all of them
cannot take is missing from their parent and so goes to the parent's siblings. A leaf then gives whole epochs and,
for the rest, a prefix of one more epoch in an order seeded by the epoch and the document's id; the last document
is cut so that the tokens are exactly the budget.

A leaf may hold a third of all rows, so nothing is ordered by leaf alone: the cut of the last epoch is found first
among 4096 ranges of the order's hash, by sums, and then within one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD_SQL, stored

MAX_EPOCHS = 3
SEED = "mix-1"
RANGE_DIGITS = 3  # hexadecimal digits of the hash: 4096 ranges
MOST_LEAVES = 20_000  # a leaf table of more rows is joined without broadcasting it

Level = tuple[str, Column, Column]  # name, the node's name, its weight among its siblings


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_SQL)), F.lit(0)).cast("long")


def _key(name: str) -> str:
    return f"__k_{name}"


def level_keys(levels: list[Level]) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("null")).alias(_key(n)) for n, name, _ in levels]


def narrow_rows(docs: DataFrame, id_col: str, tokens: Column, levels: list[Level]) -> DataFrame:
    """Id, tokens, and key and weight of each level; keys are texts, null being a node of its own."""
    weights = [F.greatest(F.coalesce(w.cast("long"), F.lit(0)), F.lit(0)).alias(f"__w_{n}") for n, _, w in levels]
    return docs.select(F.col(id_col).alias("__id"), tokens.cast("long").alias("__n"), *level_keys(levels), *weights)


def share_budget(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Split each parent's `budget` among its nodes (columns cap and w, both above 0) as column `alloc`.

    In the order of cap / w, the nodes that fill up come first; the rest share what remains by weight, rounded so
    that the parts sum to it. Sums and products are exact decimals.
    """
    whole = Window.partitionBy(*parent)
    order = whole.orderBy(F.col("cap").cast("double") / F.col("w"), key)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = lambda c: c.cast("decimal(24,0)")
    small = lambda c: c.cast("decimal(13,0)")
    step = nodes.withColumns({"__c": F.sum("cap").over(running) - F.col("cap"), "__v": F.sum("w").over(running) - F.col("w"), "__t": F.sum("w").over(whole)})
    fits = big(F.col("cap")) * small(F.col("__t") - F.col("__v")) <= big(F.col("budget") - F.col("__c")) * small(F.col("w"))
    step = step.withColumn("__f", F.when(fits, 1).otherwise(0)).withColumn("__f", F.min("__f").over(running) == 1)
    free = F.when(F.col("__f"), 0).otherwise(F.col("w"))
    step = step.withColumns({"__rest": F.col("budget") - F.sum(F.when(F.col("__f"), F.col("cap")).otherwise(0)).over(whole), "__free": F.sum(free).over(whole), "__cum": F.sum(free).over(running)})
    step = step.withColumns({"__p": big(F.col("__rest")) * small(F.col("__cum")), "__q": big(F.col("__rest")) * small(F.col("__cum") - F.col("w")), "__free": small(F.col("__free"))})
    part = F.expr("case when __f then cap when __free > 0 then (__p div __free) - (__q div __free) else 0 end").cast("long")
    return step.withColumn("alloc", part).select(*nodes.columns, "alloc")


def leaf_budgets(rows: DataFrame, names: list[str], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """One row per leaf: keys, supply, alloc. The budget is share[0] / share[1] of all tokens of weighted leaves."""
    keys = [_key(n) for n in names]
    leaves = rows.groupBy(*keys).agg(F.sum("__n").alias("supply"), *(F.max(f"__w_{n}").alias(f"__w_{n}") for n in names))
    weighted = reduce(lambda a, b: a & b, (F.col(f"__w_{n}") > 0 for n in names))
    leaves = stored(leaves.where(weighted & (F.col("supply") > 0)).withColumns({"cap": F.col("supply") * max_epochs, "__root": F.lit(0)}), "mix-leaves")
    above = leaves.groupBy("__root").agg(F.expr(f"least(sum(supply) * {share[0]} div {share[1]}, sum(cap))").cast("long").alias("budget"))
    for depth, name in enumerate(names):
        parent = ["__root", *keys[:depth]]
        nodes = leaves.groupBy(*parent, keys[depth]).agg(F.sum("cap").alias("cap"), F.max(f"__w_{name}").alias("w"))
        above = share_budget(nodes.join(above, parent), parent, keys[depth]).select(*parent, keys[depth], F.col("alloc").alias("budget"))
    return above.drop("__root").withColumnRenamed("budget", "alloc").join(leaves.select(*keys, "supply"), keys)


def _order(seed: str, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("null"))))


def leaf_cuts(rows: DataFrame, names: list[str], share: tuple[int, int] = (1, 1), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per leaf that gives anything: keys, epochs (whole ones), cut (hash of the last document of the partial
    epoch, null without one) and take (that document's tokens)."""
    keys = [_key(n) for n in names]
    plan = leaf_budgets(rows, names, share, max_epochs).withColumn("epochs", F.expr("alloc div supply")).withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply"))
    plan = stored(plan.where("alloc > 0"), "mix-plan")
    partial = with_leaves(rows, plan.where("rest > 0"), keys).withColumn("h", _order(seed, F.col("epochs"), F.col("__id")))
    partial = partial.withColumn("range", F.substring("h", 1, RANGE_DIGITS))
    sums = partial.groupBy(*keys, "rest", "range").agg(F.sum("__n").alias("n"))
    up_to = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    last = stored(sums.where("before < rest and rest <= before + n").select(*keys, "range", "before"), "mix-range")
    inside = with_leaves(partial, last, [*keys, "range"]).groupBy(*keys, "rest", "before", "h").agg(F.sum("__n").alias("n"))
    up_to = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("before", F.col("before") + F.sum("n").over(up_to) - F.col("n"))
    cuts = inside.where("before < rest and rest <= before + n").select(*keys, F.col("h").alias("cut"), (F.col("rest") - F.col("before")).alias("take"))
    return stored(plan.select(*keys, "epochs").join(cuts, keys, "left"), "mix-cuts")


def with_leaves(rows: DataFrame, leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a stored table of one row per leaf: broadcast if its counted rows are few, else as Spark likes."""
    small = leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES
    return rows.join(F.broadcast(leaves) if small else leaves, keys)


def take_epochs(rows: DataFrame, cuts: DataFrame, names: list[str], seed: str = SEED) -> DataFrame:
    """Rows (with keys, __id, __n) repeated for each epoch that takes them, with `epoch`, `take_tokens` and __take, the
    tokens that are left of a document that is cut."""
    keys = [_key(n) for n in names]
    joined = with_leaves(rows, cuts, keys).withColumn("h", _order(seed, F.col("epochs"), F.col("__id")))
    more = F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    out = joined.withColumn("epoch", F.explode(F.expr("sequence(0, cast(epochs as int))"))).withColumn("__more", more)
    out = out.where((F.col("epoch") < F.col("epochs")) | (F.col("__more") == 1))
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("h") == F.col("cut"))
    out = out.withColumns({"take_tokens": F.when(cut, F.least("__n", "take")).otherwise(F.col("__n")), "__take": F.when(cut, F.col("take"))})
    return out.drop("epochs", "cut", "take", "h", "__more")


def mix(
    docs: DataFrame,
    levels: list[Level],
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    share: tuple[int, int] = (1, 1),
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The documents that fill the budget: one row per document and epoch.

    levels: from the root down; share: the budget as a fraction of all tokens of leaves with weight. Returns the
    id column, one column per level, epoch, n_tokens, take_tokens. A leaf with a weight of 0 (or less, or null)
    at any level gives nothing and counts for nothing; nodes named null are nodes of their own; texts that are
    null or empty have no tokens and come with whole epochs; rows with the same id have the same place in the
    order, and if the cut falls on them each is cut alike. Other columns are ignored; an empty table gives no rows.
    """
    names = [n for n, _, _ in levels]
    rows = stored(narrow_rows(docs, id_col, word_tokens(F.col(text_col)) if tokens is None else tokens, levels), "mix-rows")
    out = take_epochs(rows, leaf_cuts(rows, names, share, max_epochs, seed), names, seed)
    shown = [F.when(F.col(_key(n)) != "null", F.substring(F.col(_key(n)), 2, 1 << 30)).alias(n) for n in names]
    return out.select(F.col("__id").alias(id_col), *shown, "epoch", F.col("__n").alias("n_tokens"), "take_tokens")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; n is 1 at least."""
    blank = r"[\x20\x09-\x0D]+"
    led = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)  # the split begins with an empty part then
    limit = (n + led + 1).cast("int")
    parts = F.split(text, blank, limit)
    rest = F.length(F.element_at(parts, -1))
    return F.when(F.size(parts) == limit, F.regexp_replace(F.left(text, F.length(text) - rest), blank + "$", "")).otherwise(text)


def mix_documents(docs: DataFrame, levels: list[Level], id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (1, 1), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The same selection as rows of `docs`, repeated by epoch; the last document of a leaf's partial epoch is cut
    behind the words that the budget leaves it, so the texts' words are the budget.

    Texts are not shuffled, unless the tree has more than MOST_LEAVES leaves. Nulls, ties and repeated ids are as in mix().
    """
    names = [n for n, _, _ in levels]
    rows = narrow_rows(docs, id_col, word_tokens(F.col(text_col)), levels)
    cuts = leaf_cuts(stored(rows, "mix-rows"), names, share, max_epochs, seed)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    keyed = docs.select(whole, F.col(id_col).alias("__id"), F.lit(0).cast("long").alias("__n"), *level_keys(levels))
    text = F.col("__row").getField(text_col)
    cut = F.when(F.col("__take").isNotNull(), first_words(text.cast("string"), F.col("__take"))).otherwise(text)
    fields = [(cut if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns]
    return take_epochs(keyed, cuts, names, seed).select(*fields)
