"""Text profiling as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide results.
LANGUAGE_WORDS = ("the", "and", "of", "to", "a", "in", "is", "it", "you", "that")
KEYWORD_STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "over",
)


def words(text: Column) -> Column:
    """Non-empty pieces between ASCII white space."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def letters(text: Column) -> Column:
    """Lower-case words that are ASCII letters throughout."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def content_flags(text: Column) -> dict[str, Column]:
    n = F.size(words(text)).cast("long")
    return {
        "has_code": text.contains("```"),
        "has_table": text.rlike(r"\|.*\|"),
        "has_link": text.rlike(r"https?://"),
        "word_count": n,
        "char_count": F.length(text).cast("long"),
        "read_time": F.greatest(F.lit(1), F.floor(n / 200)).cast("long"),
    }


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"\."), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def chunk_statistics(text: Column) -> dict[str, Column]:
    w, s = F.size(words(text)).cast("long"), F.size(sentences(text)).cast("long")
    p = F.size(F.filter(F.split(text, "\n\n"), lambda x: ~x.rlike(r"^\s*$"))).cast("long")
    return {
        "word_count": w,
        "sentence_count": s,
        "paragraph_count": p,
        "avg_words_per_sentence": F.round(w / F.greatest(F.lit(1), s), 4),
        "density": F.when(F.length(text) > 0, F.round(F.length(F.replace(text, F.lit(" "), F.lit(""))) / F.length(text), 4)).otherwise(F.lit(0.0)),
    }


def diversity(text: Column) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, F.round(F.size(F.array_distinct(F.transform(w, F.lower))) / F.size(w), 3)).otherwise(F.lit(0.0))


def average_sentence(text: Column) -> Column:
    s = sentences(text)
    n = F.aggregate(s, F.lit(0), lambda a, x: a + F.size(words(x)))
    return F.when(F.size(s) > 0, F.round(n / F.size(s), 1)).otherwise(F.lit(0.0))


def readability(average: Column, diverse: Column) -> Column:
    return F.when((average < 10) & (diverse > 0.7), "easy").when((average < 20) & (diverse > 0.5), "moderate").when(average < 30, "difficult").otherwise("very_difficult")


def completeness(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    points = [
        (t.rlike(r"[.!?]$"), 0.3),
        (t.rlike(r"^[A-Z]"), 0.2),
        (count("(") == count(")"), 0.2),
        ((count('"') + count("'")) % 2 == 0, 0.1),
        (text.contains("\n\n") | text.contains("."), 0.2),
    ]
    return F.round(reduce(lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(F.lit(0.0)) for c, p in points]), 2)


#: Patterns of text characteristics.
CHARACTERISTICS = {
    "has_numbers": r"[0-9]+",
    "has_dates": r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b",
    "has_urls": r"https?://\S+",
    "has_email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "has_phone": r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
    "has_currency": r"\$[0-9]+(?:\.[0-9]{2})?",
    "has_formatting": r"[*_`#]",
}


def characteristics(text: Column) -> dict[str, Column]:
    out = {k: text.rlike(p) for k, p in CHARACTERISTICS.items()}
    out["has_quotes"] = text.contains('"') | text.contains("'")
    out["has_parentheses"] = text.contains("(") & text.contains(")")
    return out


def paragraph_features(text: Column) -> dict[str, Column]:
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "questions": F.regexp_count(text, F.lit(r"\?")).cast("long"),
        "exclamations": F.regexp_count(text, F.lit("!")).cast("long"),
        "capital_ratio": F.round(F.regexp_count(text, F.lit("[A-Z]")) / n, 4),
        "numbers": F.regexp_count(text, F.lit("[0-9]+")).cast("long"),
    }


def language(text: Column) -> Column:
    w = letters(text)
    hits = F.size(F.filter(w, lambda x: x.isin(*LANGUAGE_WORDS)))
    return F.when((F.size(w) > 0) & (hits / F.greatest(F.size(w), F.lit(1)) >= 0.1), "en").otherwise("unknown")


def category(has_code: Column, has_math: Column, has_tables: Column, has_headers: Column, has_lists: Column) -> Column:
    return F.when(has_code, "technical").when(has_math, "academic").when(has_tables & has_headers, "structured").when(has_lists, "informational").otherwise("narrative")


def breadcrumb(title: Column, parents: Column) -> dict[str, Column]:
    path = F.concat(parents, F.array(title))
    return {"breadcrumb": F.array_join(path, " > "), "depth": F.size(path).cast("long"), "parent": F.get(parents, F.size(parents) - 1), "root": F.get(path, F.lit(0))}


def slug(title: Column) -> Column:
    kept = F.regexp_replace(F.lower(title), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "-"), "^-+|-+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when either is empty."""
    n, u = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), n / F.greatest(u, F.lit(1))).otherwise(F.lit(0.0))


def skip_semantics(text: Column, flagged: Column | None = None) -> Column:
    short = (F.length(text) < 100) | (F.size(words(text)) < 20) | (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < 3)
    return short if flagged is None else short | flagged


#: What one cross reference looks like.
REFERENCE = r"(?i)\b(section|chapter|figure|table|appendix)\s+([0-9]+(?:\.[0-9]+)*|[A-Z]\b)"

#: Words that make a value secret in a log line.
SECRET_VALUE = r"(?i)\b(password|secret|token|api_?key)(\"?\s*[:=]\s*\"?)([^\s\"',;]+)"


def redact(text: Column) -> Column:
    return F.regexp_replace(text, SECRET_VALUE, "$1$2***")


def complexity(code: Column) -> dict[str, Column]:
    """Branches, line density and a maintainability index of source code, from counts alone."""
    n_lines = F.size(F.split(code, "\n"))
    filled = F.size(F.filter(F.split(code, "\n"), lambda s: F.trim(s) != ""))
    branches = 1 + F.regexp_count(code, F.lit(r"\b(if|elif|else|for|while|case|catch|except|and|or)\b"))
    volume = F.greatest(F.size(words(code)), F.lit(1))
    index = 171 - 5.2 * F.log(volume.cast("double")) - 0.23 * branches - 16.2 * F.log(F.greatest(filled, F.lit(1)).cast("double"))
    return {"complexity": branches.cast("long"), "line_density": F.round(filled / n_lines, 4), "maintainability": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index * 100 / 171)), 3)}
