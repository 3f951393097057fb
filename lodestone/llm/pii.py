"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall generators propose spans that may overlap: the four fixed patterns,
and looser forms of each kind. Every candidate is described by a few small
integer features of its format and context, so the whole corpus's candidates
condense to one table of feature patterns with their counts, of at most
``PATTERNS`` rows whatever the corpus's size. Boosted trees are fitted to that
table (label: does the candidate's normal form pass its kind's format check,
which no feature sees), calibrated on held-out documents, and turned into one Column expression.
Candidates that pass the checks stay; the others are added where the calibrated
probability reaches their kind's threshold.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; an empty table gives an empty result; other columns are carried along by
``redact``, whatever their names, and ignored by ``find``. Offsets are code points, ends exclusive.
Patterns use possessive forms and look-behinds, places and overlaps come from
sweeps over sorted candidates, and a redacted text is put together from pieces,
so that no text, however long or full of candidates, costs the square of either.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, held_out

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns. A look-behind keeps a run from being tried again from its middle, where no new match can begin.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators of the same kinds: written-out addresses, broken-up numbers, numbers without a plus sign.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{2,63}+\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}+(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}+(?:\[\.\]|\x20?\.\x20?)[0-9]{1,3}+(?![0-9.])",
    "card": r"(?<![0-9.])[0-9]{4}+(?:[\x20./-]{0,2}+[0-9]{4}+){2}(?:[\x20./-]{0,2}+[0-9]{1,4}+)(?![0-9.])",
    "phone": r"(?<![0-9+])\(?0?[0-9]{2,4}+\)?[\x20./-]{1,2}+[0-9]{3,4}+[\x20./-]{1,2}+[0-9]{3,4}+(?![0-9])",
}
#: A cheap test that must hold before a kind's patterns are tried.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
#: Words near a candidate that speak for its kind.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|address",
    "ip": r"(?i)\bip\b|host|server|addr|gateway",
    "card": r"(?i)card|visa|credit|payment|account",
    "phone": r"(?i)phone|\btel|call|mobile|fax",
}
CONTEXT_CHARS = 32

#: Nothing that a check reads is a feature: no digit counts, no lengths, no octets.
#: Feature names and their numbers of values; their product bounds the pattern table.
FEATURES = {"kind": 4, "groups": 6, "separators": 5, "before": 4, "after": 4, "context": 2, "loose": 2}
PATTERNS = math.prod(FEATURES.values())

TREES, DEPTH, RATE = 40, 2, 0.3
#: Items that a sweep takes together, and characters of a piece of text.
SWEPT, PIECE = 128, 4096

#: A kind's threshold is the least calibrated probability whose held-out precision reaches this.
PRECISION, LEAST_THRESHOLD = 0.9, 0.5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sweep(xs: Column, zero: Column, step, state: str, item: str, last=None) -> Column:
    """array<item>: what ``step(state, x)`` -> struct<state, item> gives from left to right, and ``last(state)`` at the end.

    ``aggregate`` copies what it has gathered at every step. So the array is cut into short ones: one pass finds
    the state at the start of each, and each gathers its own items.
    """

    def gather(x: Column) -> Column:
        begun = F.struct(zero.alias("now"), F.array().cast(f"array<{state}>").alias("at"))
        states = F.aggregate(
            x["cuts"],
            begun,
            lambda a, some: F.struct(F.aggregate(some, a["now"], lambda s, v: step(s, v)["state"]).alias("now"), F.array_append(a["at"], a["now"]).alias("at")),
        )
        return _let(F.struct(x["cuts"].alias("cuts"), states.alias("s")), gathered)

    def gathered(x: Column) -> Column:
        empty = F.array().cast(f"array<{item}>")

        def items(some: Column, s0: Column) -> Column:
            def add(a: Column, v: Column) -> Column:
                r = step(a["state"], v)
                return F.struct(r["state"].alias("state"), F.array_append(a["items"], r["item"]).alias("items"))

            return F.aggregate(some, F.struct(s0.alias("state"), empty.alias("items")), add, lambda a: a["items"])

        out = F.flatten(F.zip_with(x["cuts"], x["s"]["at"], items))
        return F.array_append(out, last(x["s"]["now"])) if last else out

    cuts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x["xs"]) - 1) / SWEPT).cast("int")), lambda i: F.slice(x["xs"], i * SWEPT + 1, SWEPT))
    nothing = F.array(last(zero)) if last else F.array().cast(f"array<{item}>")
    whole = _let(F.struct(xs.alias("xs")), lambda x: F.when(F.size(x["xs"]) > 0, _let(F.struct(cuts(x).alias("cuts")), gather)))
    return F.coalesce(whole, nothing)


MATCH = "struct<start:int,value:string,near:string,next:string>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start,value,near,next>> of a pattern's matches: place, match, some of what is before, what is behind.

    ``split`` gives what lies between the matches, hence their places and neighbourhood without a look into the text.
    """

    def placed(x: Column) -> Column:
        n = F.size(x["found"])
        some = lambda c, at: F.when(n > 0, F.slice(c, at, n))
        gap, behind = some(x["gaps"], 1), some(x["gaps"], 2)
        before, after = F.concat(F.array(F.lit("")), some(x["found"], 1)), some(x["found"], 2)
        rows = F.arrays_zip(x["found"].alias("m"), gap.alias("g"), behind.alias("h"), before.alias("b"), after.alias("a"))
        rows = F.slice(rows, 1, n)
        near = lambda r: F.right(F.concat(r["b"], F.coalesce(r["g"], F.lit(""))), F.lit(CONTEXT_CHARS))
        behind_it = lambda r: F.substring(F.concat(F.coalesce(r["h"], F.lit("")), F.coalesce(r["a"], F.lit(""))), 1, 1)
        step = lambda pos, r: F.struct((pos + F.length(r["g"]) + F.length(r["m"])).alias("state"), F.struct((pos + F.length(r["g"])).alias("start"), r["m"].alias("value"), near(r).alias("near"), behind_it(r).alias("next")).alias("item"))
        return sweep(rows, F.lit(0), step, "int", MATCH)

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The fixed check of a base match."""
    n = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return (n >= 9) & (n <= 15)


def _normal(kind: str, value: Column) -> Column:
    """A loose match as its kind is plainly written: no spaces, signs for words, a plus sign."""
    bare = F.regexp_replace(value, r"\x20", "")
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(bare, r"\(at\)|\[at\]", "@"), r"\(dot\)|\[dot\]", ".")
    if kind == "ip":
        return F.regexp_replace(bare, r"\[\.\]", ".")
    return F.concat(F.lit("+"), bare) if kind == "phone" else bare


def _char_class(c: Column) -> Column:
    """0 edge or space, 1 letter, 2 digit, 3 other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


CANDIDATE = "struct<start:bigint,base:boolean,kind:int,end:bigint,code:int,ok:boolean>"


def _candidate(kind: str, loose: bool, m: Column) -> Column:
    k, value, start = KINDS.index(kind), m["value"], m["start"].cast("long")
    groups = F.size(F.regexp_extract_all(value, F.lit("[0-9]++"), F.lit(0)))
    others = F.regexp_replace(value, r"[0-9A-Za-z@+_%]", "")
    feature = {
        "kind": F.lit(k),
        "groups": F.least(groups, F.lit(5)),
        "separators": F.when(others == "", 0).when(others.rlike(r"^\.+$"), 1).when(others.rlike(r"^-+$"), 2).when(others.rlike(r"^\x20+$"), 3).otherwise(4),
        "before": _char_class(F.right(m["near"], F.lit(1))),
        "after": _char_class(m["next"]),
        "context": m["near"].rlike(CONTEXT[kind]).cast("int"),
        "loose": F.lit(int(loose)),
    }
    code = F.lit(0)
    for name, values in FEATURES.items():
        code = code * values + feature[name]
    ok = F.coalesce(_passes(kind, _normal(kind, value) if loose else value), F.lit(False))
    base = F.lit(False) if loose else ok
    return F.struct(start.alias("start"), base.alias("base"), F.lit(k).alias("kind"), (start + F.length(value)).alias("end"), code.cast("int").alias("code"), ok.alias("ok"))


def _described(kind: str, loose: bool):
    return lambda m: _candidate(kind, loose, m)


#: Beyond any place in a text.
FAR = 1 << 40
LABELLED = "struct<start:bigint,base:boolean,kind:int,end:bigint,code:int,ok:boolean,other:boolean,clash:boolean>"


def candidates(text: Column) -> Column:
    """array<struct<start,base,kind,end,code,ok,y,clash>>: what all generators propose in one text.

    ``y`` is true where a candidate's normal form passes its kind's check and no checked span of another kind overlaps
    it, or where it covers a checked span of its own kind; ``clash`` where it overlaps another, checked span.
    """
    parts = []
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind in KINDS:
            p = patterns[kind]
            some = F.transform(_matches(text, p), _described(kind, loose))
            parts.append(F.when(text.rlike(HINT[kind]) & text.rlike(p), some).otherwise(F.array().cast(f"array<{CANDIDATE}>")))

    kinds = range(len(KINDS))
    mine = lambda c, k: c["kind"] == k

    def forward(ends: Column, c: Column) -> Column:
        """``ends``: the last end of the checked spans so far, by kind."""
        hit = [ends[k] > c["start"] for k in kinds]
        other = _any([hit[k] & ~mine(c, k) for k in kinds])
        new = F.array(*[F.when(c["base"] & mine(c, k), F.greatest(ends[k], c["end"])).otherwise(ends[k]) for k in kinds])
        fields = [c[f].alias(f) for f in ("start", "base", "kind", "end", "code", "ok")]
        return F.struct(new.alias("state"), F.struct(*fields, other.alias("other"), _any(hit).alias("clash")).alias("item"))

    def backward(next_: Column, c: Column) -> Column:
        """``next_``: start and end of the next checked span, by kind."""
        hit = [next_[2 * k] < c["end"] for k in kinds]
        other = c["other"] | _any([hit[k] & ~mine(c, k) for k in kinds])
        covers = c["base"] | _any([mine(c, k) & (next_[2 * k + 1] <= c["end"]) for k in kinds])
        new = F.array(*[F.when(c["base"] & mine(c, k), c[f]).otherwise(next_[2 * k + j]) for k in kinds for j, f in enumerate(("start", "end"))])
        fields = [c[f].alias(f) for f in ("start", "base", "kind", "end", "code", "ok")]
        return F.struct(new.alias("state"), F.struct(*fields, (covers | (c["ok"] & ~other)).alias("y"), (c["clash"] | _any(hit)).alias("clash")).alias("item"))

    def labelled(some: Column) -> Column:
        there = sweep(some, F.array(*[F.lit(0).cast("long") for _ in kinds]), forward, "array<bigint>", LABELLED)
        return sweep(F.reverse(there), F.array(*[F.lit(FAR).cast("long") for _ in (*kinds, *kinds)]), backward, "array<bigint>", LABELLED.replace("other", "y"))

    # Loose candidates sort before checked ones with the same start, so what they cover lies behind them.
    return _let(F.array_sort(F.concat(*parts)), lambda some: F.when(F.size(some) > 0, labelled(some)).otherwise(F.array().cast(f"array<{LABELLED.replace('other', 'y')}>")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def features_of(code: np.ndarray) -> np.ndarray:
    out = []
    for values in reversed(FEATURES.values()):
        out.append(code % values)
        code = code // values
    return np.stack(out[::-1], 1)


def fit_trees(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Boosted trees of logistic loss over weighted patterns. A tree is a leaf value or (feature, value, less-or-equal tree, greater tree)."""
    total = pos + neg
    prior = math.log((pos.sum() + 1) / (neg.sum() + 1))
    f, grown = np.full(len(x), prior), []

    def grow(rows: np.ndarray, depth: int):
        p = 1 / (1 + np.exp(-f[rows]))
        g, h = (pos[rows] - total[rows] * p), total[rows] * p * (1 - p)
        best, here = (1e-6, None), g.sum() ** 2 / (h.sum() + 1)
        for k in range(x.shape[1]) if depth else ():
            for v in np.unique(x[rows, k])[:-1]:
                low = x[rows, k] <= v
                gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - here
                if gain > best[0]:
                    best = (gain, (k, int(v), low))
        if best[1] is None:
            return float(np.clip(rate * g.sum() / (h.sum() + 1), -4, 4))
        k, v, low = best[1]
        return (k, v, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    for _ in range(trees if len(x) else 0):
        tree = grow(np.arange(len(x)), depth)
        grown.append(tree)
        f = f + predict(tree, x)
    return prior, grown


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    k, v, low, high = tree
    return np.where(x[:, k] <= v, predict(low, x), predict(high, x))


class Model:
    """Prior, trees, calibration and a threshold per kind."""

    def __init__(self, prior: float, trees: list, slope: float, shift: float, thresholds: list[float]):
        self.prior, self.trees, self.slope, self.shift, self.thresholds = prior, trees, slope, shift, thresholds

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.prior + sum((predict(t, x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -35, 35)))

    def column(self, code: Column) -> Column:
        """The same probability as an expression over a candidate's code."""
        feature, rest = [], code
        for values in reversed(FEATURES.values()):
            feature.append(rest % values)
            rest = F.floor(rest / values).cast("int")
        feature = feature[::-1]

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            k, v, low, high = tree
            return F.when(feature[k] <= v, of(low)).otherwise(of(high))

        z = F.lit(self.prior)
        for t in self.trees:
            z = z + of(t)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * z + F.lit(self.shift))))

    def threshold(self, kind: Column) -> Column:
        out = F.lit(2.0)
        for k, t in enumerate(self.thresholds):
            out = F.when(kind == k, F.lit(t)).otherwise(out)
        return out


def fit(found: DataFrame) -> Model:
    """Fit on (doc_id, _cands), from the counts of feature patterns by label."""
    c = found.select(held_out().alias("_h"), F.explode(F.transform("_cands", lambda c: F.struct(c["code"].alias("code"), c["y"].alias("y")))).alias("_c"))
    y, h = F.when(F.col("_c.y"), 1).otherwise(0), F.when(F.col("_h"), 1).otherwise(0)
    counts = c.select(F.col("_c.code").alias("code"), y.alias("y"), h.alias("h")).groupBy("code", "y", "h").agg(F.count(F.lit(1)).alias("n"))
    table = {}
    for r in counts.collect():  # at most 4 * PATTERNS rows
        table.setdefault(r.code, np.zeros((2, 2)))[r.h, r.y] += r.n
    codes = np.array(sorted(table), np.int64)
    x = features_of(codes)
    n = np.array([table[k] for k in codes]).reshape(-1, 2, 2)
    prior, trees = fit_trees(x, n[:, 0, 1], n[:, 0, 0])
    model = Model(prior, trees, 1.0, 0.0, [2.0] * len(KINDS))
    if not len(codes):
        return model
    z = np.log(np.clip(model.probability(x), 1e-12, 1)) - np.log(np.clip(1 - model.probability(x), 1e-12, 1))
    model.slope, model.shift = calibrate(z, n[:, 1, 1], n[:, 1, 0])
    p = model.probability(x)
    for k in range(len(KINDS)):
        mine = x[:, 0] == k
        for t in np.unique(p[mine])[::-1]:
            at = mine & (p >= t)
            if t >= LEAST_THRESHOLD and n[at, 1, 1].sum() >= PRECISION * n[at, 1].sum() > 0:
                model.thresholds[k] = float(t) - 1e-9
    return model


def calibrate(z: np.ndarray, pos: np.ndarray, neg: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's slope and shift on weighted counts, by damped Newton steps."""
    if not pos.sum() or not neg.sum():
        return 1.0, 0.0
    a, b, total = 1.0, 0.0, pos + neg
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        e, k = total * p - pos, total * p * (1 - p)
        h = np.array([[(k * z * z).sum() + 1, (k * z).sum()], [(k * z).sum(), k.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([(e * z).sum() + (a - 1), e.sum()]))
        a, b = a - float(np.clip(d[0], -0.5, 0.5)), b - float(np.clip(d[1], -1, 1))
    return max(a, 1e-3), b


SPAN = "struct<start:bigint,kind:int,end:bigint,p:double>"


def select(cands: Column, model: Model) -> Column:
    """The spans that stay: checked ones, and others that overlap none of these and reach their threshold. Where such
    others overlap each other, from left to right the likelier one stays, the first of equals."""
    base = F.transform(F.filter(cands, lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(True).alias("base")))
    loose = F.transform(F.filter(cands, lambda c: ~c["base"] & ~c["clash"]), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), model.column(c["code"]).alias("p")))
    likely = F.array_sort(F.filter(loose, lambda c: c["p"] >= model.threshold(c["kind"])))

    def settle(last: Column, c: Column) -> Column:
        apart = last.isNull() | (last["end"] <= c["start"])
        return F.struct(F.when(apart | (c["p"] > last["p"]), c).otherwise(last).alias("state"), F.when(apart, last).alias("item"))

    kept = F.filter(sweep(likely, F.lit(None).cast(SPAN), settle, SPAN, SPAN, lambda last: last), lambda c: c.isNotNull())
    kept = F.when(F.size(likely) > 0, F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(False).alias("base"))))
    return F.array_sort(F.concat(base, F.coalesce(kept, F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"))))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,base>>) for every row; ``kind`` indexes KINDS, spans by kind, then start."""
    found = cut(docs.select(F.col(key).alias("doc_id"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("_cands")), "pii")
    return found.select(F.col("doc_id").alias(key), select(F.col("_cands"), fit(found)).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        key,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null. Reads ``docs`` twice."""
    # Inside, columns go by place, so that no name of the input meets one of ours.
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)
    rows = docs.toDF(*own)
    whole = F.coalesce(F.col(own[at]), F.lit(""))
    found = cut(rows.select(F.col(own[docs.columns.index(key)]).alias("doc_id"), candidates(whole).alias("_cands")), "pii")
    model = fit(found)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(select(F.col("_cands"), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put_together(x: Column) -> Column:
        """Pieces between the spans, each cut from the few pieces of text that hold it."""

        def part(a: Column, b: Column) -> Column:
            i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            head = F.substring(F.get(x["pieces"], i), (a % PIECE + 1).cast("int"), F.least(b - a, F.lit(PIECE)).cast("int"))
            tail = F.concat(F.array_join(F.slice(x["pieces"], i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(x["pieces"], j), F.lit(1), (b - j * PIECE).cast("int")))
            return F.when(a >= b, F.lit("")).when(i == j, head).otherwise(F.concat(head, tail))

        def step(pos: Column, s: Column) -> Column:
            out = F.when(s["start"] >= pos, F.concat(part(pos, s["start"]), F.get(marks, s["kind"]))).otherwise(F.lit(""))
            return F.struct(F.greatest(pos, s["end"]).alias("state"), out.alias("item"))

        return F.array_join(sweep(x["spans"], F.lit(0).cast("long"), step, "bigint", "string", lambda pos: part(pos, x["length"])), "")

    pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    done = _let(F.struct(F.col("_spans").alias("spans"), pieces.alias("pieces"), F.length(whole).cast("long").alias("length")), put_together)
    hit = rows.withColumn("_cands", candidates(whole)).withColumn("_spans", ordered)
    clean = F.when(F.size("_spans") == 0, F.col(own[at])).otherwise(done)
    return hit.withColumn(own[at], clean).select(*own).toDF(*docs.columns)
