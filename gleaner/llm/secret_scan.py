"""Secret scan by a trigram index: Boolean trigram queries from each pattern, postings intersected, candidates verified.

Everything on the main path is a DataFrame operation; the queries are derived on the
driver from the patterns alone.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The first three are the base kinds, in their listed order.
BASE_KINDS = 3
#: A key from its first line through its last; without that through the last line of base64. Whatever stands between,
#: a group is repeated a bounded number of times, as Java takes stack for each.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,200}-{5,}END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[ \t\r\n]*(?:Proc-Type|DEK-Info):[^\r\n]*){0,4}(?:[ \t\r\n\\]*[A-Za-z0-9+/=]{16,}){1,60}(?:[A-Za-z0-9+/=\\\r\n]*(?:[\r\n]|$))?)?"
)
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
    Rule("private_key", PRIVATE_KEY),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
)

#: Alternatives that one query may have, and literals of a character class that are told apart.
ALTERNATIVES, CLASS_SIZE = 64, 6


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that all occur in any match of it.

    An empty set among them means that a match need not have any trigram. Repeats,
    large classes and anything else that is no plain literal end a run of letters.
    """
    Run = tuple[str, frozenset[str]]  # the last two letters of the open run, the trigrams so far

    def put(runs: list[Run], c: str) -> list[Run]:
        c = c.lower()
        return [((tail + c)[-2:], seen | {tail + c} if len(tail) == 2 and len(c) == 1 else seen) for tail, seen in runs]

    def close(runs: list[Run]) -> list[Run]:
        return [("", seen) for _, seen in runs]

    def walk(parsed, runs: list[Run]) -> list[Run]:
        for op, value in parsed:
            if op is rc.LITERAL:
                runs = put(runs, chr(value))
            elif op is rc.IN and len(value) <= CLASS_SIZE and all(o is rc.LITERAL for o, _ in value):
                runs = [r for _, c in value for r in put(runs, chr(c))]
            elif op is rc.SUBPATTERN:
                runs = walk(value[3], runs)
            elif op is rc.BRANCH:
                runs = [r for branch in value[1] for r in walk(branch, runs)]
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[:2] == (0, 1):
                runs = runs + walk(value[2], runs)
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] >= 1:
                runs = close(walk(value[2], runs))
            else:
                runs = close(runs)
            runs = list(dict.fromkeys(runs))
            if len(runs) > ALTERNATIVES:
                runs = list(dict.fromkeys(close(runs)))[:1] if len(set(close(runs))) == 1 else [("", frozenset.intersection(*[s for _, s in runs]))]
        return runs

    found = {seen for _, seen in walk(rp.parse(pattern), [("", frozenset())])}
    return sorted((s for s in found if not any(t < s for t in found)), key=sorted)


def trigram_index(documents: DataFrame, trigrams: list[str], id: str, text: str) -> DataFrame:
    """Postings (trigram, id) of the wanted trigrams over lower-case texts.

    Only trigrams that a query asks for are indexed, as the scan reads its index once.
    """
    folded = F.lower(F.col(f"`{text}`"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("t"), F.lit(g)), F.lit(g)) for g in trigrams]))
    return documents.select(F.col(f"`{id}`").alias("id"), folded.alias("t")).select("id", F.explode(held).alias("trigram"))


def index_candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """Rows (id, rules): the rules of which some alternative has all its trigrams in the document.

    An alternative's postings are intersected as bits, which Spark combines before the
    shuffle: a frequent trigram sends one row per document and alternative at most.
    """
    terms = [(t, rule, k, 1 << bit, (1 << min(len(alt), 62)) - 1) for rule, alts in queries.items() for k, alt in enumerate(alts) for bit, t in enumerate(sorted(alt)[:62])]
    table = index.sparkSession.createDataFrame(terms, "trigram string, rule int, alternative int, bit long, all_bits long")
    met = index.join(F.broadcast(table), "trigram").groupBy("id", "rule", "alternative", "all_bits").agg(F.bit_or("bit").alias("bits"))  # bounded by the rules
    return met.filter("bits = all_bits").groupBy("id").agg(F.collect_set("rule").alias("rules"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def prefix_sums(numbers: Column) -> Column:
    """Sum of all earlier elements for each element, by blocks of about the square root of the length."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def blocks(n: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(n))).cast("int"))
        return let(width, lambda w: let(heads(n, w), lambda h: F.transform(n, lambda _, i: h[(i / w).cast("int")] + total(F.slice(n, (i / w).cast("int") * w + 1, i % w)))))

    def heads(n: Column, w: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / w).cast("int")), lambda k: total(F.slice(n, k * w + 1, w)))
        return let(sums, lambda s: F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))))

    return F.when(F.size(numbers) > 0, let(numbers, blocks)).otherwise(numbers)


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans (start, kind, end) of one rule in code points, the end exclusive.

    Texts between the matches and the matches themselves alternate, so their lengths
    give the places.
    """
    pattern = F.lit(rule.java)
    parts = F.struct(
        F.transform(F.split(text, rule.java, -1), lambda x: F.length(x)).alias("gaps"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("sizes"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("judged"),
    )

    def place(p: Column) -> Column:
        steps = F.zip_with(p["gaps"], p["sizes"], lambda g, s: g + F.coalesce(s, F.lit(0)))
        spans = let(prefix_sums(steps), lambda before: F.transform(p["sizes"], lambda s, i: F.struct((before[i] + p["gaps"][i]).alias("start"), F.lit(kind).alias("kind"), (before[i] + p["gaps"][i] + s).alias("end"))))
        return F.filter(spans, lambda _, i: p["judged"][i] >= rule.least)

    return F.when(F.rlike(text, pattern), let(parts, place)).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)"))


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the document with all its columns) and ``spans``, sorted by start, then kind.

    A kind is the number of its rule. Null texts have no spans. Rows with the same id
    (null too) share their candidate rules and are verified alone. An empty table gives
    no rows; extra columns stay inside ``row``.
    """
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if all(q)}
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    rows = documents.select(F.struct("*").alias("row"))
    found = rows
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    ruled = F.lit(None)
    if indexed:
        wanted = sorted({t for q in indexed.values() for alt in q for t in alt})
        candidates = index_candidates(trigram_index(documents, wanted, id, text), indexed)
        found = rows.join(candidates, F.col("row")[id].eqNullSafe(F.col("id")), "left")
        ruled = F.col("rules")
    spans = [
        F.when(F.array_contains(ruled, F.lit(i)), rule_spans(whole, r, i)).otherwise(none) if i in indexed else rule_spans(whole, r, i)
        for i, r in enumerate(rules)
    ]
    return found.select("row", F.array_sort(F.concat(*spans)).alias("spans"))


def render(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def secret_digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: how many spans of each base kind, their digest, and all spans."""
    found = scan_secrets(documents, rules, id, text)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{rules[kind].kind}")

    counts = [count(i) for i in range(BASE_KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select(F.col("row")[id].alias("doc_id"), *counts, F.sha2(render(base, rules).cast("binary"), 256).alias("base_sha256"), render(F.col("spans"), rules).alias("spans"))


def redact_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """The documents with every span replaced by the mask; overlapping spans count as one. Null texts stay null.

    ``length`` names a column that gets the new number of code points where a text has changed.
    """
    found = scan_secrets(documents, rules, id, text)
    whole = F.col("row")[text]
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        more = F.concat(state["parts"], F.array(F.substring(whole, state["at"] + 1, s["start"] - state["at"])))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(state["parts"]).alias("parts"))

    def finish(state: Column) -> Column:
        return F.array_join(F.concat(state["parts"], F.array(F.substring(whole, state["at"] + 1, F.length(whole)))), mask)

    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(whole)
    masked = found.select("row", clean.alias("_clean"), (F.size("spans") > 0).alias("_changed"))
    new = {text: F.col("_clean")}
    if length is not None:
        new[length] = F.when(F.col("_changed"), F.length("_clean").cast(documents.schema[length].dataType)).otherwise(F.col("row")[length])
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest in SQL, every rule over every text."""
    parts = []
    for i, r in enumerate(rules):
        pattern = ("(?i)" if r.ignore_case else "") + r.pattern
        pattern = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {i} AS k, unnest(range(1, len(m) + 1)) AS i, m, q, g FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS m, "
            f"regexp_extract_all(text, '{pattern}', {r.group}) AS q, string_split_regex(text, '{pattern}') AS g FROM documents) WHERE len(m) > 0"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules))
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, kind, k, length(m[i]) AS n, length(q[i]) AS judged,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM found),
kept AS (SELECT doc_id, k, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS said FROM placed WHERE judged >= CASE k {least} END),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(said, ',' ORDER BY s, k) FILTER (k < {BASE_KINDS}) AS base, string_agg(said, ',' ORDER BY s, k) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)
""".strip()
