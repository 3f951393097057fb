"""Complementary content and conflicts between results."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import jaccard
from lodestone.operators.similarity import _low, items, sharing_pairs, with_sides
from lodestone.storage import cut

# Title words that tell a document's part in a project.
REQUIREMENTS = ("requirements", "specification", "user story", "feature", "functional")
IMPLEMENTATION = ("implementation", "technical", "architecture", "api", "code", "development")
LEVELS = (
    ("strategy", "vision", "overview", "executive", "business case"),
    ("requirements", "features", "user story", "epic", "specification"),
    ("design", "architecture", "workflow", "process", "wireframe"),
    ("implementation", "code", "api", "technical", "development", "configuration"),
)
TYPES = (
    ("compliance", ("security", "compliance", "audit", "policy")),
    ("testing", ("test", "testing", "qa", "quality")),
    ("tutorial", ("tutorial", "how-to", "walkthrough")),
    ("reference", ("reference", "manual")),
    ("example", ("example", "sample", "demo")),
    ("user_story", ("user story", "epic", "feature")),
    ("technical_spec", ("technical", "specification", "api", "implementation")),
    ("architecture", ("architecture", "design", "system")),
    ("process", ("workflow", "process", "procedure", "guide")),
    ("user_story", ("requirement",)),
)
CHALLENGES = (
    ("authentication", "login", "auth", "signin"),
    ("scalability", "performance", "optimization", "scale"),
    ("compliance", "regulation", "audit", "governance"),
    ("integration", "api", "interface", "connection"),
    ("security", "privacy", "protection", "safety"),
    ("migration", "upgrade", "transition", "conversion"),
)
BUSINESS = ("business", "user", "requirements", "workflow", "process", "feature")
TECHNICAL = ("technical", "architecture", "api", "implementation", "code", "development")
FEATURE = ("feature", "functionality")
SECURITY = ("security", "authentication", "authorization", "compliance", "audit")
# Words of domains, and of patterns of architecture.
DOMAINS = (
    ("healthcare", "medical", "patient", "clinical"),
    ("finance", "payment", "banking", "financial"),
    ("ecommerce", "retail", "shopping", "commerce"),
    ("education", "learning", "student", "academic"),
    ("iot", "device", "sensor", "embedded"),
    ("mobile", "app", "ios", "android"),
)
PATTERNS = (
    ("microservices", "service", "microservice"),
    ("api", "rest", "graphql", "endpoint"),
    ("database", "data", "storage", "persistence"),
    ("authentication", "auth", "identity", "oauth"),
    ("messaging", "queue", "event", "pub-sub"),
    ("cache", "caching", "redis", "memory"),
    ("monitoring", "logging", "observability", "metrics"),
)
# Technologies that two titles may share, and those of them that count as none where their number matters.
TECHNOLOGIES = ("react", "angular", "vue", "node", "node.js", "python", "java", "golang", "docker", "kubernetes", "aws", "azure", "gcp", "postgres", "mysql", "mongodb", "jwt", "oauth", "rest", "graphql", "grpc")
UNCOUNTED = ("golang", "gcp", "rest", "graphql", "grpc")
# Phrases that point to a conflict, and phrases that contradict each other.
INDICATORS = ("should not", "avoid", "deprecated", "recommended", "best practice", "anti-pattern", "wrong", "correct", "instead", "better", "worse")
OPPOSITES = (("must", "must not"), ("always", "never"), ("enable", "disable"), ("allow", "deny"), ("required", "optional"), ("supported", "unsupported"), ("should", "should not"))


def has_any(title: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(title).contains(w) for w in words])


def abstraction_level(title: Column) -> Column:
    out = F.lit(2)
    for k in range(len(LEVELS) - 1, -1, -1):
        out = F.when(has_any(title, LEVELS[k]), F.lit(k)).otherwise(out)
    return out


def document_type(title: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(TYPES):
        out = F.when(has_any(title, words), F.lit(name)).otherwise(out)
    return out


def challenges(title: Column) -> Column:
    return F.filter(F.array(*[F.when(has_any(title, w), F.lit(k)) for k, w in enumerate(CHALLENGES)]), lambda x: x.isNotNull())


#: Word groups of a title by their bit: those that make a pair where one title holds some and the other the rest, those that two
#: titles must both hold, and technologies, all of them and those that are counted.
SIDES = (REQUIREMENTS, IMPLEMENTATION, BUSINESS, TECHNICAL, FEATURE, SECURITY)
NAMED = tuple((w,) for w in TECHNOLOGIES)
COUNTED = sum(1 << k for k, w in enumerate(TECHNOLOGIES) if w not in UNCOUNTED)


def held(title: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """The word groups of which a title holds a word, a bit for each."""
    return reduce(lambda a, b: a + b, [F.when(has_any(title, g), F.lit(1 << k)).otherwise(F.lit(0)) for k, g in enumerate(groups)])


def described(results: DataFrame) -> DataFrame:
    """What complements look at, once a document: (doc_id, f)."""
    t = F.coalesce("source_title", F.lit(""))
    words = F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    kinds = {name: k for k, name in enumerate(dict.fromkeys(["general", *[name for name, _ in TYPES]]))}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), document_type(t))
    masks = {"sides": SIDES, "challenges": CHALLENGES, "domains": DOMAINS, "patterns": PATTERNS, "named": NAMED}
    return results.select("doc_id", F.struct(
        "project_id", _low("topics").alias("topics"), _low("entities").alias("entities"), words.alias("words"), abstraction_level(t).alias("level"), kind.alias("kind"),
        *[held(t, g).alias(k) for k, g in masks.items()],
    ).alias("f"))


def complementary(results: DataFrame, k: int, least: float = 0.15, targets: DataFrame | None = None) -> DataFrame:
    """The best complements of every result, or of those whose ids ``targets`` (doc_id) holds, among those that share a topic:
    (a, b, score, reason, rank).

    Titles and lists are read once a document; a pair carries both sides' bits, is scored once, and counts for either side.
    """
    mirrored = targets is None
    if mirrored:
        pairs = sharing_pairs(results, "topics").select("a", "b")
    else:
        i = items(results, "topics")
        own = i.join(targets.select("doc_id").distinct(), "doc_id", "left_semi").select("item", F.col("doc_id").alias("a"))
        pairs = own.join(i.select("item", F.col("doc_id").alias("b")), "item").where("a <> b").select("a", "b").distinct()
    facts = cut(described(results), "described")
    side = lambda key, name: facts.select(F.col("doc_id").alias(key), F.col("f").alias(name))
    p = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    s = p.select("a", "b", *complement_score()).where(F.col("score") > least)
    if mirrored:
        s = s.select(F.explode(F.array(F.struct("a", "b", "score", "reason"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score", "reason"))).alias("s")).select("s.*")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b", "score", "reason", F.col("rank").cast("long").alias("rank"))


def complement_score() -> list[Column]:
    """(score, reason) of a pair with the facts x and y of its sides.

    Several factors: the first and a tenth of the others, .95 at most; the first is the pair of requirements and
    implementation, else the largest. No factor: what topics, entities and title words are shared.
    """
    both = lambda c: F.col(f"x.{c}").bitwiseAND(F.col(f"y.{c}"))
    bit = lambda s, k: F.col(f"{s}.sides").bitwiseAND(F.lit(1 << k)) > 0
    either = lambda i, j: (bit("x", i) & bit("y", j)) | (bit("x", j) & bit("y", i))
    in_both = lambda name: F.size(F.array_intersect(f"x.{name}", f"y.{name}"))
    shared, entities, common = in_both("topics"), in_both("entities"), in_both("words")
    same = F.col("x.project_id").eqNullSafe(F.col("y.project_id"))
    req, gap = either(0, 1), F.abs(F.col("x.level") - F.col("y.level"))
    technologies = F.when(entities > 0, entities).otherwise(F.bit_count(both("named").bitwiseAND(F.lit(COUNTED))))
    fallback = F.least(
        F.lit(0.5),
        F.greatest(
            F.when(shared > 0, 0.2 + 0.05 * shared).otherwise(0.0), F.when(entities > 0, 0.15 + 0.05 * entities).otherwise(0.0), F.when(common > 1, 0.1 + 0.02 * common).otherwise(0.0)
        ),
    )
    known = lambda parts: F.sort_array(F.filter(parts, lambda x: x.isNotNull()), asc=False)
    intra = known(F.array(
        F.when(gap > 0, 0.7 + 0.1 * gap),
        F.when(either(2, 3) | either(4, 5), F.lit(0.75)),
        F.when((shared > 0) & (F.col("x.kind") != F.col("y.kind")), F.least(F.lit(0.65), 0.35 + 0.1 * shared)),
    ))
    intra = F.concat(F.when(req, F.array(F.lit(0.85))).otherwise(F.array().cast("array<double>")), intra)
    inter = known(F.array(
        F.when(both("challenges") > 0, F.lit(0.8)),
        F.when(both("domains") > 0, F.lit(0.75)),
        F.when(both("patterns") > 0, F.lit(0.7)),
        F.when((entities > 0) | (both("named") > 0), F.least(F.lit(0.6), 0.3 + 0.1 * technologies)),
    ))

    def blend(s: Column) -> Column:
        rest = F.aggregate(F.slice(s, 2, 10), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(s) > 1, F.least(F.lit(0.95), F.get(s, F.lit(0)) + 0.1 * rest)).when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(fallback)

    score = F.when(same & (shared >= 3), F.least(F.lit(0.95), blend(intra) * 1.2)).when(same, blend(intra)).otherwise(blend(inter) * 0.8)
    reason = F.when(same & req, "requirements").when(same & (gap > 0), "abstraction").when(same, "topics").otherwise("across projects")
    return [F.round(score, 6).alias("score"), reason.alias("reason")]


def whole_word(phrase: str) -> str:
    """A phrase as whole words; one that may be negated does not match its negation."""
    return rf"\b{phrase}\b" + (r"(?!\s+not\b)" if phrase in ("must", "should") else "")


def phrase_count(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(low.contains(p), 1).otherwise(0) for p in INDICATORS])


def opposite_sides(text: Column) -> Column:
    """For each contradiction, whether the text holds its first and its second phrase."""
    low = F.lower(text)
    # Java's look-ahead and RE2's lack of it: the negated forms are taken out first instead.
    bare = lambda p: F.regexp_replace(low, rf"\b{p}\s+not\b", " ") if p in ("must", "should") else low
    hit = lambda p: (bare(p) if "not" not in p else low).rlike(rf"\b{p}\b")
    return F.array(*[F.struct(hit(p).alias("p"), hit(q).alias("q")) for p, q in OPPOSITES])


def opposite_pairs(x: Column, y: Column) -> Column:
    """Which contradictions stand between two texts, by number; of their ``opposite_sides``."""
    between = lambda k: (x[k]["p"] & y[k]["q"]) | (x[k]["q"] & y[k]["p"])
    return F.filter(F.array(*[F.when(between(k), F.lit(k)) for k in range(len(OPPOSITES))]), lambda v: v.isNotNull())


def detect(results: DataFrame) -> DataFrame:
    """(a, b, text_confidence, metadata_weight, opposites, category) of pairs that share an entity and conflict in some way.

    Both texts must have ten characters and differ. Each text is read once, whole; pairs carry what was found in it.
    """
    t = F.col("text")
    read = results.select("doc_id", "entities", "source_type", "project_id", "created_day", F.length(t).alias("length"), F.sha2(t.cast("binary"), 256).alias("digest"), phrase_count(t).alias("said"), opposite_sides(t).alias("sides"))
    p = with_sides(sharing_pairs(results, "entities"), read, ("entities", "source_type", "project_id", "created_day", "length", "digest", "said", "sides"))
    p = p.where((F.col("x.length") >= 10) & (F.col("y.length") >= 10) & (F.col("x.digest") != F.col("y.digest")))
    shared = jaccard(_low("x.entities"), _low("y.entities"))
    said = F.col("x.said") + F.col("y.said")
    text = F.when((shared > 0.3) & (said > 0), F.least(F.lit(1.0), shared * said / 10)).otherwise(F.lit(0.0))
    types = F.array_sort(F.array("x.source_type", "y.source_type"))
    between = F.when(types == F.array(F.lit("confluence"), F.lit("git")), 0.2).when(types == F.array(F.lit("confluence"), F.lit("jira")), 0.1).otherwise(0.0)
    meta = F.when(F.abs(F.col("x.created_day") - F.col("y.created_day")) > 365, 0.3).otherwise(0.0) + between + F.when(F.col("x.project_id").eqNullSafe(F.col("y.project_id")), 0.0).otherwise(0.1)
    opposites = opposite_pairs(F.col("x.sides"), F.col("y.sides"))
    out = p.select("a", "b", F.round(text, 6).alias("text_confidence"), F.round(F.when(meta > 0.2 + 1e-9, F.least(F.lit(1.0), meta)).otherwise(0.0), 6).alias("metadata_weight"), F.array_join(opposites, ",").alias("opposites"))
    category = F.when(F.col("opposites") != "", "procedural").when(F.col("text_confidence") > 0, "general").otherwise("metadata")
    return out.where((F.col("text_confidence") > 0) | (F.col("metadata_weight") > 0) | (F.col("opposites") != "")).withColumn("category", category)


# How texts name a version of themselves, and one of what they run on.
VERSION, RUNTIME = r"version\s+([0-9]+\.[0-9]+\.[0-9]+)", r"(?:python|node|java|version)\s*([0-9]+\.[0-9]+(?:\.[0-9]+)?)"


def version_conflicts(results: DataFrame) -> DataFrame:
    """(a, b, versions_a, versions_b, kind) of pairs that share an entity and name different versions: ``version`` where their
    lists of versions differ, ``runtime`` where any two numbers of what they run on do. Each text is read once."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    read = results.select("doc_id", "entities", found(VERSION).alias("own"), found(RUNTIME).alias("on")).where(F.size("on") > 0)
    p = with_sides(sharing_pairs(read, "entities"), read, ("own", "on"))
    differ = lambda c: (F.size(f"x.{c}") > 0) & (F.size(f"y.{c}") > 0)
    own = differ("own") & (F.col("x.own") != F.col("y.own"))
    on = differ("on") & (F.size(F.array_union("x.on", "y.on")) > 1)
    kind = F.when(own, "version").when(on, "runtime")
    return p.select("a", "b", F.array_join("x.on", ",").alias("versions_a"), F.array_join("y.on", ",").alias("versions_b"), kind.alias("kind")).where("kind IS NOT NULL")


#: Vectors that meet in one block of pairs from either side, on average.
VECTOR_BLOCK = 2048
#: How far below and above a band a product of single precision may lie that is then computed in double precision.
MARGIN = 1e-4


def vector_band(points: DataFrame, low: float = 0.6, high: float = 0.95, by: str = "label", block: int = VECTOR_BLOCK) -> DataFrame:
    """Pairs of equal ``by`` whose cosine lies in the band, tiered: 0.8 and over first, 0.5 second.

    The rows of a value are dealt into blocks, and each two blocks meet under a key of their own as two matrices; pairs
    near the band are then computed in double precision, an entry after the other. ``low`` lies above 0, the cosine of what
    has no direction: a vector that is null or zero, holds nulls or is of another length.
    """
    if low <= 0:
        raise ValueError("low must be positive")
    p = points.where(F.col(by).isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).select(F.col(by).alias("of"), F.size("v").alias("d"), "doc_id", "v")
    n = p.groupBy("of", "d").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    p = p.join(n, ["of", "d"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = p.select("of", "d", "doc_id", "v", "own", other).select("of", "d", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "v")
    kind = points.schema["doc_id"].dataType.simpleString()
    met = dealt.groupBy("of", "d", "low", "high").applyInArrow(_near_band(low, high), f"a {kind}, b {kind}, cosine double")
    scored = met.select("a", "b", F.round("cosine", 6).alias("score")).where(F.col("score").between(low, high))
    tier = F.when(F.col("score") >= 0.8, "primary").when(F.col("score") >= 0.5, "secondary").otherwise("tertiary")
    return scored.select("a", "b", "score", tier.alias("tier"))


def _near_band(low: float, high: float, rows: int = 512):
    """Of a block's rows, the pairs near the band with their cosine: of two blocks those across, of one all."""

    def of(key, table):
        import pyarrow as pa

        first, second = key[2].as_py(), key[3].as_py()
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
        ids, own = table.column("doc_id").to_numpy(), table.column("own").to_numpy()
        ok = np.isfinite(v).all(1)
        v, ids, own = v[ok], ids[ok], own[ok]
        length = np.sqrt(_dots(v, v))
        with np.errstate(all="ignore"):
            unit = np.where(length[:, None] > 0, v / length[:, None], 0.0).astype(np.float32)
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        found = []
        for at in range(0, len(left), rows):
            some = left[at : at + rows]
            near = unit[some] @ unit[right].T
            i, j = np.nonzero((near > low - MARGIN) & (near < high + MARGIN))
            i, j = some[i], right[j]
            if first == second:
                kept = ids[i] < ids[j]
                i, j = i[kept], j[kept]
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            found.append((ids[i], ids[j], _dots(v[i], v[j]) / (length[i] * length[j])))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"a": a, "b": b, "cosine": c})

    return of


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed in the order of their entries."""
    s = np.zeros(len(x))
    for k in range(x.shape[1]):
        s += x[:, k] * y[:, k]
    return s


def capped_by_tier(pairs: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The best pairs of each tier, for a reviewer: a top-k report."""
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "a", "b"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("tier"))
    # The largest cap as a number lets Spark cut each task's pairs before they are shuffled.
    return pairs.withColumn("rank", rank).where(F.col("rank") <= max(caps.values())).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("long"))


def snippet(text: Column, word: str, around: int = 40) -> Column:
    """What stands around the first place of a word, null where it is missing."""
    at = F.instr(F.lower(text), F.lit(word))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - around), 2 * around + len(word)))
