"""Identity rules: document ids, chunk ids, state URIs and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _uuid(hex_digest: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hex_digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def normal_url(url: Column) -> Column:
    """Lower case, without query, fragment and closing slashes of the path; an empty path is ``/``."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"[?#;].*$", "")
    bare = F.regexp_replace(bare, "/+$", "")
    return F.when(bare.rlike(r"^[a-z][a-z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare)


def document_id(source_type: Column, source: Column, url: Column) -> Column:
    key = F.concat_ws(":", F.lower(F.trim(source_type)), F.lower(F.trim(source)), normal_url(url))
    return _uuid(F.sha2(key.cast("binary"), 256))


def chunk_id(document: Column, index: Column) -> Column:
    return _uuid(F.sha2(F.concat_ws("_", document, index.cast("string")).cast("binary"), 256))


def state_uri(source_type: Column, source: Column, url: Column) -> Column:
    """``type:source:percent-encoded url`` with RFC 3986's unreserved characters left plain."""
    coded = F.url_encode(F.regexp_replace(url, "/+$", ""))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat_ws(":", source_type, source, coded)


def content_hash(content: Column, title: Column, **metadata: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys; line ends are normalised, a null is the word ``null``."""
    plain = lambda c: F.coalesce(F.replace(c.cast("string"), F.lit("\r\n"), F.lit("\n")), F.lit("null"))
    md = F.struct(*[plain(metadata[k]).alias(k) for k in sorted(metadata)]) if metadata else F.struct(F.lit("").alias("none"))
    return F.sha2(F.to_json(F.struct(plain(content).alias("content"), md.alias("metadata"), plain(title).alias("title"))).cast("binary"), 256)
