"""Lookup, relaxed complements and behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import behaviour, lookup
from lodestone.plans.analysis_queries import _COMPLEMENT_SQL
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table

_ID = """CASE doc_id % 7 WHEN 0 THEN document_id WHEN 1 THEN concat('  ', source_type, ':', source_title, ' ') WHEN 2 THEN concat(upper(source_type), '__', replace(source_title, ' ', '-')) WHEN 3 THEN SLICE
 WHEN 4 THEN concat('missing:', source_title) WHEN 5 THEN 'nothing like this' ELSE substr(source_title, 1, 5) END"""
_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_NORMAL = lambda c: rf"regexp_replace(lower({_STRIP(c)}), '[\s:_-]+', ' ', 'g')"
_BEST = lambda step, join: f"SELECT id, arg_min(doc_id, doc_id * 4 + kind) AS doc_id, {step} AS step FROM {join} GROUP BY id"
_REST = lambda *names: "(SELECT id FROM ids WHERE " + " AND ".join(f"id NOT IN (SELECT id FROM {n})" for n in names) + ") i"


@query("document_lookup", rf"""WITH {R}, ids AS (SELECT DISTINCT {_ID.replace('SLICE', "array_to_string(string_split(source_title, ' ')[2:3], ' ')")} AS id FROM results),
 k0 AS (SELECT doc_id, unnest([concat(source_type, ':', source_title), {_STRIP('document_id')}, {_STRIP('source_title')}, concat({_STRIP('source_type')}, ':', {_STRIP('source_title')})]) AS key, unnest([0, 1, 2, 3]) AS kind FROM results),
 k AS (SELECT key, min(doc_id * 4 + kind) // 4 AS doc_id, min(doc_id * 4 + kind) % 4 AS kind, {_NORMAL('key')} AS name FROM k0 WHERE key <> '' GROUP BY key),
 s1 AS ({_BEST(1, 'ids JOIN k ON key = id')}), s2 AS ({_BEST(2, f"{_REST('s1')} JOIN k ON key = {_STRIP('id')}")}), s3 AS ({_BEST(3, f"{_REST('s1', 's2')} JOIN k ON name = {_NORMAL('id')}")}),
 s4 AS ({_BEST(4, f"{_REST('s1', 's2', 's3')} JOIN k ON contains(concat(' ', name, ' '), concat(' ', {_NORMAL('id')}, ' '))")}), s5 AS ({_BEST(5, f"{_REST('s1', 's2', 's3', 's4')} JOIN k ON contains(id, ':') AND key = substr(id, instr(id, ':') + 1)")})
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5""")
def document_lookup(spark, sf):
    r = results(spark, sf)
    return lookup.find(r.select(F.expr(_ID.replace("SLICE", "array_join(slice(split(source_title, ' '), 2, 2), ' ')")).alias("id")), r)


_STOPS = ", ".join(f"'{w}'" for w in lookup.RELAXED_STOP_WORDS)
_FORM = lambda n, form, left: f"a{n} AS (SELECT query_id, len({form}) AS m, unnest({form}) AS word FROM q WHERE {left}), w{n} AS (SELECT query_id, doc_id, sum(tf) AS tf FROM a{n} JOIN dw USING (word) GROUP BY query_id, doc_id, m HAVING count(*) = m), t{n} AS (SELECT query_id, {n} AS form, arg_min(doc_id, (-tf, doc_id)) AS target FROM w{n} GROUP BY query_id)"
_TARGETS = f"""q AS (SELECT item_id AS query_id, w, CASE WHEN len(list_filter(w, x -> x NOT IN ({_STOPS}))) > 0 THEN list_filter(w, x -> x NOT IN ({_STOPS})) ELSE w END AS kept FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS w FROM benchmark)),
 dw AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS word FROM documents) GROUP BY ALL),
 {_FORM(0, 'list_distinct(w)', 'true')}, {_FORM(1, 'list_distinct(kept[1:4])', 'query_id NOT IN (SELECT query_id FROM t0)')}, {_FORM(2, 'list_distinct(kept[1:2])', 'query_id NOT IN (SELECT query_id FROM t0 UNION ALL SELECT query_id FROM t1)')},
 ts AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"""


@query("complement_targets", f"WITH {_TARGETS} SELECT query_id, form, target AS doc_id FROM ts")
def complement_targets(spark, sf):
    return lookup.targets(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), results(spark, sf))


_HEAD, _TAIL = _COMPLEMENT_SQL.rsplit(" SELECT a, b, score, reason,", 1)


@query("complement_relaxed", f"{_HEAD}, {_TARGETS} SELECT query_id, form, target, b AS doc_id, score, reason, CAST(rank AS BIGINT) AS rank FROM ts JOIN k ON k.a = target WHERE rank <= 5")
def complement_relaxed(spark, sf):
    return lookup.complements(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), results(spark, sf), 5)


_INTENT = "CASE event_type WHEN 'view' THEN 'informational' WHEN 'click' THEN 'technical_lookup' WHEN 'signup' THEN 'procedural' WHEN 'error' THEN 'troubleshooting' ELSE 'vendor_evaluation' END"
_MINUTES = 720
_SESSIONS = f"""e AS (SELECT event_id, ts, user_id, event_type, {_INTENT} AS intent FROM events), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > {_MINUTES * 60_000_000} THEN 1 ELSE 0 END AS far FROM e),
 s AS (SELECT *, CAST(sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""


def acted(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.expr(_INTENT).alias("intent"))
    return behaviour.sessions(e, _MINUTES)


@query("behaviour_sessions", f"WITH {_SESSIONS} SELECT user_id, session, CAST(count(*) AS BIGINT) AS n, count(DISTINCT intent) AS intents, epoch_us(max(ts)) - epoch_us(min(ts)) AS lasted FROM s GROUP BY ALL")
def behaviour_sessions(spark, sf):
    lasted = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return acted(spark, sf).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("intent").alias("intents"), lasted.alias("lasted"))


@query("behaviour_transitions", f"WITH {_SESSIONS}, t AS (SELECT lag(intent) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS from_intent, intent AS to_intent FROM s), n AS (SELECT from_intent, to_intent, count(*) AS n FROM t WHERE from_intent IS NOT NULL GROUP BY ALL) SELECT from_intent, to_intent, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY from_intent), 9) AS share FROM n")
def behaviour_transitions(spark, sf):
    return behaviour.transitions(acted(spark, sf)).withColumn("share", F.round("share", 9))


_BASE = "(VALUES ('informational'), ('technical_lookup'), ('procedural'), ('troubleshooting'), ('vendor_evaluation'), ('business_context'), ('exploratory')) i(intent)"
_NEXT = " OR ".join(f"(last = '{a}' AND intent IN ({', '.join(repr(x) for x in b)}))" for a, b in behaviour.NEXT.items())
_FITS = lambda p: f"(len(list_filter(previous, x -> x IN ({', '.join(repr(x) for x in p)}))) / {len(p)})"
_PATTERN = " * ".join(f"(CASE WHEN intent IN ({', '.join(repr(x) for x in p)}) AND {_FITS(p)} > 0.5 THEN 1 + 0.3::DOUBLE * {_FITS(p)} ELSE 1.0::DOUBLE END)" for p in behaviour.PATTERNS)
_BY = lambda c, weights: "CASE " + " ".join(f"WHEN {c} = '{v}' AND intent = '{i}' THEN {w}::DOUBLE" for v, by in weights.items() for i, w in by.items()) + " ELSE 1.0::DOUBLE END"
_DOMAIN, _ROLE, _URGENCY = "CASE user_id % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'business' END", "CASE user_id % 4 WHEN 0 THEN 'developer' WHEN 1 THEN 'manager' WHEN 2 THEN 'guest' END", "CASE WHEN event_type = 'error' THEN 'high' ELSE 'normal' END"


@query("behaviour_intents", f"""WITH {_SESSIONS}, p AS (SELECT *, coalesce(list(intent) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS previous, {_DOMAIN} AS domain, {_ROLE} AS role, {_URGENCY} AS urgency FROM s),
 x AS (SELECT event_id, previous, previous[-1] AS last, domain, role, urgency, i.intent, CASE WHEN i.intent = p.intent THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS base FROM p, {_BASE}),
 y AS (SELECT event_id, intent, round(base * ((CASE WHEN {_NEXT} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) * {_PATTERN} * (({_BY('domain', behaviour.BY_DOMAIN)}) * ({_BY('role', behaviour.BY_ROLE)}) * ({_BY('urgency', behaviour.BY_URGENCY)}))), 6) AS score FROM x)
SELECT event_id, intent, score FROM y QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, intent) = 1""")
def behaviour_intents(spark, sf):
    e = behaviour.before(acted(spark, sf))
    names = F.array(*[F.lit(x) for x in ("informational", "technical_lookup", "procedural", "troubleshooting", "vendor_evaluation", "business_context", "exploratory")])
    scores = e.select("event_id", "intent", F.explode(names).alias("i")).select("event_id", F.col("i").alias("intent"), F.when(F.col("i") == F.col("intent"), 0.5).otherwise(0.4).alias("score"))
    contexts = e.select("event_id", "previous", F.expr(_DOMAIN).alias("domain"), F.expr(_ROLE).alias("role"), F.expr(_URGENCY).alias("urgency"))
    w = behaviour.weighted(scores, contexts, "event_id")
    best = w.groupBy("event_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "intent")).alias("b"))
    return best.select("event_id", "b.intent", (-F.col("b.s")).alias("score"))
