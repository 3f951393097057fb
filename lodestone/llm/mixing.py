"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A total token budget runs down a domain-language-source tree. At each node it
is dealt to the children by weight; a child that cannot use its share (all its
tokens in every allowed epoch, without what lies below a weight of 0) returns the
rest to its siblings, and only what a whole subtree cannot use goes to the
subtree's own siblings. With the children sorted by capacity over weight this has
a closed form in two running sums, so there is no loop. Each leaf then takes the
prefix of its documents, in a seeded order that differs by epoch, whose tokens
reach its budget.

A leaf's order is never gathered: bucket sums find the bucket where the budget
ends, only that bucket is ordered, and its last key becomes a filter on a plain
scan. No text is shuffled: what moves is sums by bucket, and the leaves' table is
sent to the scans while it has at most BROADCAST_LEAVES rows (beyond, it is joined
by a shuffle, whose hot leaves adaptive execution splits). A third of all rows in
one source is therefore no different from others.

Defined results: null domain, language or source is the leaf value ``?``; a null
or empty text has no tokens and is taken where the prefix before it is short of
the budget; rows with equal ids share a place in the order; a budget or weight
of 0 selects nothing there, and what it would have got goes to its siblings; an
empty table gives an empty result; columns besides the named ones are carried
along, whatever their names; the column added is ``epoch``, with as many
underscores behind it as it takes to differ from all others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

LEAF = ("_domain", "_lang", "_source")
SEED, MAX_EPOCHS = 20, 2
#: Hex digits of the order key that make a bucket: 4,096 buckets a leaf and epoch.
BUCKET_DIGITS = 3
#: Leaves (domain, language, source: some 100 bytes each) that are broadcast at most.
BROADCAST_LEAVES = 50_000

#: Production weights: three domains of sources, four languages; any other value weighs 1.
DOMAIN_OF_SOURCE = {"web": [f"src{k}" for k in range(0, 8)], "forum": [f"src{k}" for k in range(8, 14)], "books": [f"src{k}" for k in range(14, 20)]}
DOMAIN_WEIGHTS = {"web": 5.0, "forum": 2.0, "books": 3.0}
LANG_WEIGHTS = {"en": 6.0, "fr": 2.0, "de": 2.0, "es": 2.0}
SOURCE_WEIGHTS: dict[str, float] = {"src0": 2.0}


def domain_of(source: Column) -> Column:
    out = F
    for name, members in DOMAIN_OF_SOURCE.items():
        out = out.when(source.isin(*members), F.lit(name))
    return out.otherwise(F.lit("other"))


def weight_of(value: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, w in weights.items():
        out = F.when(value == k, F.lit(float(w))).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def word_count(text: str = "text") -> Column:
    """Tokens of a document: runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def deal(children: DataFrame, parent: list[str], budget: str, weight: str, cap: str, tie: str) -> DataFrame:
    """Add ``_share``: the parent's ``budget`` over its children by weight, none above its ``cap``.

    Sorted by cap/weight, the first children to fill up are a prefix; the rest
    get weight times the level at which the budget is used up.
    """
    ratio = F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(0.0))
    up = Window.partitionBy(*parent).orderBy("_ratio", tie)
    down = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    usable = F.when(F.col(weight) > 0, F.col(cap)).otherwise(F.lit(0))
    out = (
        children.withColumn("_ratio", ratio)
        .withColumn("_filled", F.coalesce(F.sum(usable).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum(weight).over(down))
        .withColumn("_level", F.when(F.col("_open") > 0, F.greatest(F.lit(0.0), (F.col(budget) - F.col("_filled")) / F.col("_open"))).otherwise(F.lit(0.0)))
        .withColumn("_full", F.when(F.col("_level") >= F.col("_ratio"), F.lit(True)).otherwise(F.lit(False)))
        .withColumn("_rate", F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*parent)))
    )
    share = F.when(F.col(weight) <= 0, F.lit(0.0)).when(F.col("_full"), F.col(cap).cast("double")).otherwise(F.col("_rate") * F.col(weight))
    return out.withColumn("_share", share).drop("_ratio", "_filled", "_open", "_level", "_full", "_rate")


def leaf_budgets(leaves: DataFrame, fraction: float, max_epochs: int, domain_weights: Mapping, lang_weights: Mapping, source_weights: Mapping) -> DataFrame:
    """(leaf, _tokens, _budget): whole tokens for each leaf, of ``fraction`` of all tokens."""
    weighed = lambda df, name, weights: df.withColumn("_w", weight_of(F.col(name), weights)).withColumn("_cap", F.when(F.col("_w") > 0, F.col("_cap")).otherwise(F.lit(0)))
    leaf = weighed(leaves.withColumn("_cap", F.col("_tokens") * max_epochs), "_source", source_weights)
    sums = [F.sum("_cap").alias("_cap"), F.sum("_tokens").alias("_tokens")]
    lang = weighed(leaf.groupBy("_domain", "_lang").agg(*sums), "_lang", lang_weights)
    domain = weighed(lang.groupBy("_domain").agg(*sums), "_domain", domain_weights)
    root = domain.agg(F.floor(F.sum("_tokens") * F.lit(float(fraction))).cast("double").alias("_budget"))
    domain = domain.crossJoin(F.broadcast(root)).withColumn("_all", F.lit(1))
    domain = deal(domain, ["_all"], "_budget", "_w", "_cap", "_domain").select("_domain", F.col("_share").alias("_budget"))
    lang = deal(lang.join(domain, "_domain"), ["_domain"], "_budget", "_w", "_cap", "_lang").select("_domain", "_lang", F.col("_share").alias("_budget"))
    leaf = deal(leaf.join(lang, ["_domain", "_lang"]), ["_domain", "_lang"], "_budget", "_w", "_cap", "_source")
    return leaf.select(*LEAF, "_tokens", F.floor(F.col("_share") + 1e-6).cast("long").alias("_budget"))


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def mix(
    docs: DataFrame, fraction: float, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", domain: Column | None = None, lang: str = "lang", source: str = "source",
    domain_weights: Mapping = DOMAIN_WEIGHTS, lang_weights: Mapping = LANG_WEIGHTS, source_weights: Mapping = SOURCE_WEIGHTS,
) -> DataFrame:
    """The selected rows with all their columns and ``epoch`` (from 0).

    ``fraction`` of the corpus's tokens is the budget; ``docs`` is read three times, so pass a stable table.
    """
    some = lambda c: F.coalesce(c, F.lit("?"))
    # Inside, columns go by place, so that no name of the input meets one of ours.
    own = [f"c{k}" for k in range(len(docs.columns))]
    id_, words = own[docs.columns.index(key)], word_count(own[docs.columns.index(text)])
    leaf = [some(domain if domain is not None else domain_of(F.col(source))), some(F.col(lang)), some(F.col(source))]
    tagged = docs.select("*", *leaf).toDF(*own, *LEAF)
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_).cast("string"), F.lit("?"))))
    # One bucket sum for each epoch that can be the partial one; a text's words are counted once.
    narrow = tagged.select(*LEAF, words.alias("_t"), F.col(id_)).select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("_epoch"))
    buckets = cut(
        narrow.withColumn("_bucket", F.substring(order(F.col("_epoch")), 1, BUCKET_DIGITS)).groupBy(*LEAF, "_epoch", "_bucket").agg(F.sum("_t").alias("_t")),
        "buckets",
    )
    leaves = buckets.where(F.col("_epoch") == 0).groupBy(*LEAF).agg(F.sum("_t").alias("_tokens"))
    plan = leaf_budgets(leaves, fraction, max_epochs, domain_weights, lang_weights, source_weights)
    plan = plan.withColumn("_whole", F.when(F.col("_tokens") > 0, F.floor(F.col("_budget") / F.col("_tokens"))).otherwise(F.lit(0)).cast("int"))
    plan = cut(plan.withColumn("_rest", F.col("_budget") - F.col("_whole") * F.col("_tokens")), "leaf-budgets")
    small = plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    sent = lambda df: F.broadcast(df) if small else df
    # The bucket in which the partial epoch's prefix ends; at most 16 ** BUCKET_DIGITS rows a leaf.
    ahead = Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        buckets.join(sent(plan), [*LEAF])
        .where((F.col("_epoch") == F.col("_whole")) & (F.col("_rest") > 0))
        .withColumn("_ahead", F.coalesce(F.sum("_t").over(ahead), F.lit(0)))
        .where(F.col("_ahead") < F.col("_rest"))
        .groupBy(*LEAF)
        .agg(F.max(F.struct("_bucket", (F.col("_rest") - F.col("_ahead")).alias("_left"), "_whole")).alias("_end"))
        .select(*LEAF, F.col("_end._bucket").alias("_last_bucket"), F.col("_end._left").alias("_left"), F.col("_end._whole").alias("_whole"))
    )
    last = cut(last, "leaf-ends")
    inside = (
        tagged.join(sent(last), [*LEAF])
        .withColumn("_key", order(F.col("_whole")))
        .where(F.substring("_key", 1, BUCKET_DIGITS) == F.col("_last_bucket"))
        .select(*LEAF, "_left", "_key", words.alias("_t"))
        .groupBy(*LEAF, "_left", "_key")
        .agg(F.sum("_t").alias("_t"))
    )
    within = Window.partitionBy(*LEAF).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("_ahead", F.coalesce(F.sum("_t").over(within), F.lit(0)))
        .where(F.col("_ahead") < F.col("_left"))
        .groupBy(*LEAF)
        .agg(F.max("_key").alias("_last_key"))
    )
    decided = cut(plan.join(cuts, [*LEAF], "left").select(*LEAF, "_whole", "_last_key"), "leaf-cuts")
    taken = F.array_append(
        F.when(F.col("_whole") > 0, F.sequence(F.lit(0), F.col("_whole") - 1)).otherwise(F.array().cast("array<int>")),
        F.when(F.col("_key") <= F.col("_last_key"), F.col("_whole")),
    )
    out = tagged.join(sent(decided), [*LEAF]).withColumn("_key", order(F.col("_whole")))
    out = out.select(*own, F.explode(F.filter(taken, lambda e: e.isNotNull())).alias("_taken"))
    return out.toDF(*docs.columns, free_name("epoch", docs.columns))
