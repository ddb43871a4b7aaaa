"""Content identity URL and link resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, lits, strip

# Query keys that never decide what a page shows.
TRACKING_KEYS = ["entry", "fbclid", "from", "gclid", "mc_cid", "mc_eid", "ref", "referrer"]
TRACKING_PREFIX = "utm_"

# Scheme, authority, path, query, fragment, split as in RFC 3986 appendix B.
_PARTS = r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _decode(text: Column) -> Column:
    # A percent sign that starts no escape is literal text.
    return F.try_url_decode(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_query(query: Column) -> Column:
    """Drop tracking keys, sort by key and value, and encode again."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda part: part != ""),
        lambda part: F.struct(
            _decode(F.regexp_extract(part, r"\A[^=]*", 0)).alias("k"),
            _decode(F.regexp_replace(part, r"\A[^=]*=?", "")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~(
            F.array_contains(lits(TRACKING_KEYS), F.lower(p["k"]))
            | F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX))
        ),
    )
    return F.array_join(
        F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))),
        "&",
    )


def normalize_url(url: Column) -> Column:
    """Identity of a page: no fragment, no tracking keys, canonical host and path."""
    clean = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    authority = _part(clean, 2)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"\A(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)), r"[\[\]]", "")
    port = F.regexp_extract(authority, r"\A(?:.*@)?(?:\[[^\]]*\]|[^:]*):(\d+)\z", 1)
    parts = F.struct(
        F.lower(_part(clean, 1)).alias("scheme"),
        host.alias("host"),
        port.try_cast("int").alias("port"),
        _part(clean, 3).alias("path"),
        normalize_query(_part(clean, 4)).alias("query"),
    )

    def build(p: Column) -> Column:
        default_port = ((p["scheme"] == "http") & (p["port"] == 80)) | (
            (p["scheme"] == "https") & (p["port"] == 443)
        )
        return F.concat(
            p["scheme"],
            F.lit("://"),
            p["host"],
            F.when(p["port"].isNull() | default_port, F.lit("")).otherwise(
                F.concat(F.lit(":"), p["port"].cast("string"))
            ),
            F.when(p["path"].isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(p["path"], r"/+\z", "")),
            F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])),
        )

    return let(parts, build)


def url_host(url: Column) -> Column:
    """Lower-case host name, NULL where the text is no absolute URL."""
    authority = _part(url, 2)
    host = F.lower(F.regexp_extract(authority, r"\A(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.when((_part(url, 1) != "") & (host != ""), host)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` → ``[a.b.c, b.c, c]``: turns suffix matching into an equi join."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    segments = F.slice(parts, F.lit(2), F.size(parts))
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    trailing = F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(resolved, "/"), trailing)
    return F.when(
        path.rlike(r"(?:\A|/)\.\.?(?:/|\z)"),
        F.when(joined.rlike(r"\A//\z"), F.lit("/")).otherwise(joined),
    ).otherwise(path)


def _escape(text: Column, extra: str) -> Column:
    """Percent-encode white space, non-ASCII characters and the given ones."""
    unsafe = rf"[^\x21-\x7E]|[{extra}]"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?:{unsafe})++|[\x21-\x7E&&[^{extra}]]++"), F.lit(0))
    encoded = F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(unsafe), F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))).otherwise(p),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def absolute_url(raw: Column, base: Column) -> Column:
    """Resolve a link against its page; dangerous schemes give NULL."""
    link = F.regexp_replace(strip(raw), r"[\t\r\n]", "")
    parts = F.struct(
        F.lower(_part(link, 1)).alias("scheme"),
        F.regexp_extract(link, r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//)", 1).alias("slashes"),
        _part(link, 2).alias("authority"),
        _part(link, 3).alias("path"),
        F.regexp_extract(link, r"\A[^#]*?(\?[^#]*)", 1).alias("query"),
        F.regexp_extract(link, r"(#[\s\S]*)\z", 1).alias("fragment"),
        F.lower(_part(base, 1)).alias("b_scheme"),
        _part(base, 2).alias("b_authority"),
        _part(base, 3).alias("b_path"),
        F.regexp_extract(base, r"\A[^#]*?(\?[^#]*)", 1).alias("b_query"),
    )

    def resolve(p: Column) -> Column:
        same = p["scheme"] == ""
        scheme = F.when(same, p["b_scheme"]).otherwise(p["scheme"])
        own_authority = p["slashes"] != ""
        authority = F.lower(F.when(own_authority, p["authority"]).otherwise(p["b_authority"]))
        b_path = F.when(p["b_path"] == "", F.lit("/")).otherwise(p["b_path"])
        merged = (
            F.when(own_authority & (p["path"] == ""), F.lit("/"))
            .when(own_authority | F.startswith(p["path"], F.lit("/")), p["path"])
            .when(p["path"] == "", b_path)
            .otherwise(F.concat(F.regexp_replace(b_path, r"[^/]*\z", ""), p["path"]))
        )
        path = _escape(_remove_dot_segments(merged), '"<>`{}')
        keep_query = same & ~own_authority & (p["path"] == "") & (p["query"] == "")
        query = _escape(F.when(keep_query, p["b_query"]).otherwise(p["query"]), "\"<>'")
        special = scheme.isin("http", "https", "ftp")
        default_port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443"))
        shown = F.when(
            default_port.isNotNull() & F.endswith(authority, default_port),
            F.regexp_replace(authority, r":\d+\z", ""),
        ).otherwise(authority)
        return F.when(
            same | special,
            F.concat(scheme, F.lit("://"), shown, path, query, _escape(p["fragment"], '"<>`')),
        )

    opaque = (_part(link, 1) != "") & ~F.lower(_part(link, 1)).isin("http", "https", "ftp")
    return (
        F.when(raw.rlike(r"(?i)\A(?:javascript:|data:text/html|vbscript:)"), F.lit(None).cast("string"))
        .when(opaque, F.concat(F.lower(_part(link, 1)), F.regexp_replace(link, r"\A[^:]*", "")))
        .when(url_host(base).isNull() & (_part(link, 1) == ""), F.lit(None).cast("string"))
        .otherwise(let(parts, resolve))
    )


def absolute_srcset(raw: Column, base: Column) -> Column:
    """Resolve every ``url descriptor`` candidate of a source set."""
    candidates = F.transform(F.split(raw, ","), lambda part: F.split(strip(part), r"(?U)\s+"))
    resolved = F.transform(
        candidates,
        lambda words: let(
            absolute_url(words[0], base),
            lambda url: F.when(
                url.isNotNull(), F.array_join(F.concat(F.array(url), F.slice(words, F.lit(2), F.size(words))), " ")
            ),
        ),
    )
    return F.array_join(F.filter(resolved, lambda c: c.isNotNull()), ", ")
