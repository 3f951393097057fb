"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

Candidate strings are long runs of key characters. Each is read once per
character class with counts that gain the entering and lose the leaving
character, so a window costs a constant amount; a span is reported where some
window's entropy reaches its class's threshold and the allow-list does not know it:
neither by its shape nor as words that could be spoken, however they are joined.

Defined results: a null or empty text has no spans; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored. Offsets
are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import short_batches, text_bytes

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Window length in characters, and per class its alphabet and the bits a window must reach.
WINDOW = 20
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    ("lower", re.compile(r"[a-z0-9]{20,}"), 3.7),
    ("upper", re.compile(r"[A-Z0-9]{20,}"), 3.7),
    ("letters", re.compile(r"[A-Za-z]{20,}"), 4.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9),
)
#: Allow-list: known harmless shapes of a whole candidate.
ALLOWED = (
    re.compile(r"[0-9]+"),  # a number
    re.compile(r"(.{1,4})\1+"),  # a rule or a repeated filler
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # a UUID
)
#: And what reads as words: pieces of letters (camel case parts are pieces of their own) that could be spoken, as long as they
#: make up this part of the letters and digits.
PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
WORDS_SHARE = 0.75
LEAST_PIECE, LONGEST_CLUSTER, LONGEST_NUMBER, VOWELS = 3, 6, 8, "aeiouy"

#: n * log2(n) for the counts of a window.
_PLOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def peak_entropy(run: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy of any window of ``run`` (of the whole, if shorter), by incremental counts."""
    plog = _PLOG if window <= WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, best, size = 0.0, 0.0, min(window, len(run))
    if not size:
        return 0.0
    for k, c in enumerate(run):
        n = counts.get(c, 0)
        total += plog[n + 1] - plog[n]
        counts[c] = n + 1
        if k >= size:
            old = run[k - size]
            n = counts[old]
            total += plog[n - 1] - plog[n]
            counts[old] = n - 1
        if k >= size - 1:
            best = max(best, math.log2(size) - total / size)
    return best


def spoken(piece: str) -> bool:
    """Whether letters could be a word: vowels in a usual share, no long run of consonants, few rare letters, q before u."""
    w = piece.lower()
    if len(w) < LEAST_PIECE or not w.isalpha():
        return False
    vowels = sum(c in VOWELS for c in w)
    cluster = max(map(len, re.split(f"[{VOWELS}]+", w)))
    rare = sum(c in "jqxz" for c in w)
    return 0.2 <= vowels / len(w) <= 0.8 and cluster <= min(LONGEST_CLUSTER, len(w) - 1) and rare <= 1 + len(w) // 10 and w.count("q") == w.count("qu")


def wordy(candidate: str) -> bool:
    """Whether a candidate is words, joined or not: a path, a link, an identifier, a long compound."""
    # Numbers that stand alone, as in dates, say nothing.
    pieces = [p for token in re.split(r"[/_=+-]+", candidate) if not (token.isdigit() and len(token) <= LONGEST_NUMBER) for p in PIECE.findall(token)]
    total = sum(map(len, pieces))
    return total > 0 and sum(len(p) for p in pieces if spoken(p)) >= WORDS_SHARE * total


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def entropy_spans(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans that entropy adds: candidates with a window of high entropy, outside the spans taken already.

    ``taken`` is sorted by start, and so are candidates, which do not overlap: one sweep over both.
    """
    out, k, reach = [], 0, 0  # reach: the last end of the taken spans that begin before the candidate's end
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][2]), k + 1
        whole = m.group()
        if reach > m.start() or any(a.fullmatch(whole) for a in ALLOWED) or wordy(whole):
            continue
        if any(peak_entropy(run.group()) >= least for _, runs, least in CLASSES for run in runs.finditer(whole)):
            out.append((m.start(), "entropy", m.end()))
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,end,value>>) for every row, ordered by start, then kind."""
    short_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                whole = raw.decode("utf-8", "replace")
                base = base_spans(whole)
                found = sorted(base + entropy_spans(whole, base), key=lambda s: (s[0], KINDS.index(s[1])))
                rows.append([{"kind": k, "start": a, "end": b, "value": whole[a:b]} for a, k, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["key", "spans"])

    out = docs.select(F.col(key).alias("key"), text_bytes(text).alias("b")).mapInArrow(find, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return out.withColumnRenamed("key", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, base digest and span list of ``scan``'s result."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        key,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )


def brute_force_digest(text: str | None) -> tuple[int, int, int, str]:
    """The base result by the plainest means, for tests."""
    text = text or ""
    found = []
    for rank, (kind, pattern) in enumerate((("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))):
        for m in pattern.finditer(text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    count = lambda k: sum(f[2] == k for f in found)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(said.encode()).hexdigest()
