"""Document lookup by whatever a caller calls a document, and complements of what loosely worded queries name.

Both are cascades: a step sees only what no earlier step has answered (an anti-join), so the dearer steps run on few rows.

Lookup, the first step that finds something: the key itself; without white space around; the same words in lower case
with any separators; the words in a row within a key; what follows the first colon. Keys are source type and title, id, title, and type and
title stripped; a key of several documents is the first's (the smallest id). Where several keys fit, the first document's counts.
The step of words in a row meets keys at its rarest word, so no id is compared with all keys; ids without a letter or digit match
by the other steps only. Null and empty ids find nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.conflicts import complementary
from lodestone.storage import cut

#: Characters that separate the words of a key.
SEPARATORS = r"[\s:_\-]+"
WORD = r"[\p{L}\p{N}_]+"


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), SEPARATORS, " ")


def keys(documents: DataFrame) -> DataFrame:
    """(key, doc_id, kind): every key with the document that it names; ``documents`` has doc_id, document_id, source_type, source_title."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    type_, title = F.coalesce("source_type", F.lit("unknown")), F.coalesce("source_title", F.lit(""))
    listed = F.array(F.concat(type_, F.lit(":"), title), strip(F.col("document_id").cast("string")), strip(F.col("source_title")), F.concat(strip(type_), F.lit(":"), strip(title)))
    each = documents.select("doc_id", F.posexplode(listed).alias("kind", "key")).where("key IS NOT NULL AND key <> ''")
    return each.groupBy("key").agg(F.min(F.struct("doc_id", "kind")).alias("m")).select("key", "m.doc_id", "m.kind")


def find(ids: DataFrame, documents: DataFrame, cut=cut) -> DataFrame:
    """(id, doc_id, step) of the distinct ``ids`` (a column id) that name a document; step 1 to 5."""
    k = cut(keys(documents), "keys")
    left = cut(ids.select("id").where("id IS NOT NULL AND id <> ''").distinct(), "ids")
    found = []

    def answered(step: int, hits: DataFrame) -> None:
        nonlocal left
        best = hits.groupBy("id").agg(F.min(F.struct("doc_id", "kind")).alias("m")).select("id", "m.doc_id", F.lit(step).alias("step"))
        found.append(cut(best, "found"))
        left = left.join(found[-1].select("id"), "id", "left_anti")

    answered(1, left.join(k, left["id"] == k["key"]))
    answered(2, left.withColumn("key", F.regexp_replace("id", r"^\s+|\s+$", "")).join(k, "key"))
    named = cut(k.select(normal(F.col("key")).alias("name"), "doc_id", "kind").groupBy("name").agg(F.min(F.struct("doc_id", "kind")).alias("m")).select("name", "m.*"), "names")
    asked = lambda: left.withColumn("name", normal(F.col("id")))
    answered(3, asked().join(named, "name"))
    word = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    posted = named.select("name", "doc_id", "kind", F.explode(word("name")).alias("word"))
    often = posted.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # An id goes to its rarest word; a word that no key holds leaves it without a match.
    own = asked().select("id", F.col("name").alias("asked"), F.explode(word("name")).alias("word"))
    rarest = own.join(often, "word", "left").groupBy("id", "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).where("w.n > 0").select("id", "asked", "w.word")
    pattern = F.concat(F.lit(r"(^|\b|[\s:_\-])\Q"), F.col("asked"), F.lit(r"\E($|\b|[\s:_\-])"))
    answered(4, rarest.join(posted, "word").where(F.instr("name", F.col("asked")) > 0).where(F.rlike("name", pattern)))
    answered(5, left.where(F.instr("id", ":") > 0).withColumn("key", F.expr("substring(id, instr(id, ':') + 1)")).join(k, "key"))
    return functools.reduce(DataFrame.unionByName, found)


#: Words that a query loses first, words of the forms that follow it.
RELAXED_STOP_WORDS = ("the", "and", "or", "of", "for", "to", "a", "an", "phase", "kickoff")
RELAXED, SHORT = 4, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def forms(text: Column) -> list[Column]:
    """A query's words, the first four that say something, and two of these; ever weaker."""
    all_ = words(text)
    kept = F.filter(all_, lambda w: ~w.isin(*RELAXED_STOP_WORDS))
    kept = F.when(F.size(kept) > 0, kept).otherwise(all_)
    return [F.array_distinct(all_), F.array_distinct(F.slice(kept, 1, RELAXED)), F.array_distinct(F.slice(kept, 1, SHORT))]


def targets(queries: DataFrame, docs: DataFrame, cut=cut) -> DataFrame:
    """(query_id, form, doc_id): for each query the document that holds all words of its strongest form that any document does:
    the one that holds them most often, then that with the smallest id.

    Texts are read once, for the words of the first form, which are those of all forms. A query meets only the documents
    that hold its rarest word, and of the whole matches a task hands on the best of each query."""
    left = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    named = cut(left.select(F.explode(words(F.col("text"))).alias("word")).distinct(), "words")
    listed = docs.select("doc_id", F.explode(words(F.coalesce("text", F.lit("")))).alias("word"))
    counted = listed.join(named, "word").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    held = cut(counted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "tf"))).alias("held")), "held")
    often = cut(held.select(F.explode(F.map_keys("held")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "often")
    found = []
    for number, form in enumerate(forms(F.col("text"))):
        asked = left.select("query_id", form.alias("w")).where(F.size("w") > 0)
        each = asked.select("query_id", F.explode("w").alias("word")).join(often, "word", "left").select("query_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word").alias("w"))
        # The rarest words come first; a word that no document holds leaves its query without a match.
        ordered = each.groupBy("query_id").agg(F.sort_array(F.collect_list("w")).alias("w")).where(F.col("w")[0]["n"] > 0)
        ordered = cut(ordered.select("query_id", F.col("w")[0]["word"].alias("word"), F.transform("w", lambda x: x["word"]).alias("w")), "forms")
        # Where a document and a query meet is written without the document's words, and so of known size.
        met = cut(held.select("doc_id", F.explode(F.map_keys("held")).alias("word")).join(ordered.select("query_id", "word"), "word").select("query_id", "doc_id"), "met")
        whole = held.join(met, "doc_id").join(ordered.select("query_id", "w"), "query_id").where(F.forall("w", lambda x: F.map_contains_key("held", x)))
        tf = F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.element_at("held", x))
        best = whole.groupBy("query_id").agg(F.min(F.struct((-tf).alias("t"), "doc_id")).alias("b")).select("query_id", F.lit(number).alias("form"), F.col("b.doc_id").alias("doc_id"))
        found.append(cut(best, "targets"))
        left = left.join(found[-1].select("query_id"), "query_id", "left_anti")
    return functools.reduce(DataFrame.unionByName, found)


def complements(queries: DataFrame, docs: DataFrame, k: int = 5, cut=cut) -> DataFrame:
    """(query_id, form, target, doc_id, score, reason, rank): complements of each query's target."""
    t = cut(targets(queries, docs, cut), "targets")
    best = complementary(docs, k, targets=t.select("doc_id"))
    return t.join(best, F.col("doc_id") == F.col("a")).select("query_id", "form", F.col("a").alias("target"), F.col("b").alias("doc_id"), "score", "reason", "rank")
