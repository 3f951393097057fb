"""What a user did before: sessions, transitions between intents, and the weights that they give the next query.

A session is a user's events without a gap of over GAP minutes. Windows run over one user's events, which are dealt by user.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Minutes without an event that end a session; intents that are looked back on.
GAP, BACK = 30, 5
# Intents that commonly follow one another, and what that weighs.
NEXT = {
    "informational": ("procedural", "technical_lookup"),
    "technical_lookup": ("procedural", "troubleshooting"),
    "business_context": ("vendor_evaluation", "technical_lookup"),
    "vendor_evaluation": ("business_context", "technical_lookup"),
    "procedural": ("troubleshooting", "technical_lookup"),
    "troubleshooting": ("procedural", "technical_lookup"),
}
NEXT_WEIGHT = 1.2
# Intents of kinds of sessions; above the share, each weighs as much more as its share of this part.
PATTERNS = (("technical_lookup", "procedural"), ("business_context", "vendor_evaluation"), ("informational", "exploratory", "procedural"), ("troubleshooting", "procedural", "technical_lookup"))
PATTERN_SHARE, PATTERN_PART = 0.5, 0.3
# Weights by domain, role and urgency.
BY_DOMAIN = {"technical": {"technical_lookup": 1.3, "procedural": 1.2}, "business": {"business_context": 1.3, "vendor_evaluation": 1.2}}
BY_ROLE = {
    **dict.fromkeys(("developer", "engineer", "architect"), {"technical_lookup": 1.2, "procedural": 1.1}),
    **dict.fromkeys(("manager", "analyst", "consultant"), {"business_context": 1.2, "vendor_evaluation": 1.1}),
}
BY_URGENCY = {"high": {"troubleshooting": 1.4, "procedural": 1.2}}


def sessions(events: DataFrame, gap: int = GAP, user: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """``events`` with ``session``, a user's sessions numbered from 0 in order of time."""
    by = Window.partitionBy(user).orderBy(time, key)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    far = at - F.lag(at).over(by) > gap * 60_000_000
    return events.withColumn("session", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def before(events: DataFrame, intent: str = "intent", back: int = BACK, user: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Events of ``sessions`` with ``previous``, the last intents of the same session, oldest first."""
    by = Window.partitionBy(user, "session").orderBy(time, key)
    return events.withColumn("previous", F.collect_list(intent).over(by.rowsBetween(-back, -1)))


def transitions(events: DataFrame, intent: str = "intent", user: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """(from_intent, to_intent, n, share): how often one intent follows another within a session, and of all that follow it."""
    by = Window.partitionBy(user, "session").orderBy(time, key)
    steps = events.select(F.lag(intent).over(by).alias("from_intent"), F.col(intent).alias("to_intent")).where("from_intent IS NOT NULL AND to_intent IS NOT NULL")
    n = steps.groupBy("from_intent", "to_intent").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_intent")))


def behaviour_weight(intent: Column, previous: Column) -> Column:
    """What the intents before weigh on a score: a likely next one, and kinds of sessions that fit for more than half."""
    last = F.try_element_at(previous, F.lit(-1))
    likely = reduce(lambda a, b: a | b, [(last == a) & intent.isin(*b) for a, b in NEXT.items()])
    out = F.when((F.size(previous) > 0) & likely, F.lit(NEXT_WEIGHT)).otherwise(F.lit(1.0))
    of = lambda pattern: F.filter(previous, lambda x: x.isin(*pattern))
    for pattern in PATTERNS:
        fits = F.size(of(pattern)) / len(pattern)
        out = out * F.when(intent.isin(*pattern) & (fits > PATTERN_SHARE), 1 + PATTERN_PART * fits).otherwise(F.lit(1.0))
    return out


def session_weight(intent: Column, domain: Column, role: Column, urgency: Column) -> Column:
    """What a session's domain, role and urgency weigh on a score."""
    out = F.lit(1.0)
    for given, weights in ((domain, BY_DOMAIN), (role, BY_ROLE), (urgency, BY_URGENCY)):
        one = F.lit(1.0)
        for value, by_intent in weights.items():
            for name, w in by_intent.items():
                one = F.when((given == value) & (intent == name), F.lit(w)).otherwise(one)
        out = out * one
    return out


def weighted(scores: DataFrame, contexts: DataFrame, key: str = "query_id") -> DataFrame:
    """``scores`` (key, intent, score) after ``contexts`` (key, previous, domain, role, urgency), of which any may be null."""
    c = scores.join(contexts, key, "left")
    previous = F.coalesce("previous", F.array().cast("array<string>"))
    w = behaviour_weight(F.col("intent"), previous) * session_weight(F.col("intent"), F.col("domain"), F.col("role"), F.col("urgency"))
    return c.select(key, "intent", F.round(F.col("score") * w, 6).alias("score"))
