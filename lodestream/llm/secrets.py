"""Secret scans: candidates by a trigram inverted index, verified by the patterns themselves. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import let, table
from lodestream.llm.trigram import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that `group` of a match needs, else it is dropped (but has used its text up)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is what is left of all runs when those of fewer are dropped.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^/\x20\x09-\x0D:@]+:[^/\x20\x09-\x0D:@]+@"),
)
RULES = BASE + MORE


def _key() -> Column:
    """A row by what it holds. Two rows with one key share their candidates, which verification sorts out."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(trigram, key): the inverted index of docs(doc_id, text) for the trigrams that rules ask for, in lower case.

    Lists of other trigrams would never be read, so they aren't written.
    """
    low = docs.select(_key().alias("key"), F.lower(text).alias("low"))  # a column of its own: lower-cased once
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the rules whose trigram query a row satisfies, for rows that satisfy any.

    Lists are intersected by counting: a row that is on all lists of a clause is a candidate of the clause's rule. Rules
    that need no trigram aren't here; they scan every text.
    """
    clauses = [(r * 1000 + n, c) for r, rule in enumerate(rules) for n, c in enumerate(sorted(map(sorted, trigram_query(rule.pattern)))) if c]
    trigrams = sorted({t for _, c in clauses for t in c})
    if not clauses:
        return docs.select(_key().alias("key"), F.array(F.lit(0)).alias("rules")).limit(0)
    if max(len(c) for _, c in clauses) > 63:
        raise ValueError("a clause of more than 63 trigrams")
    # Which clauses a list belongs to, and as which of its bits, is part of the rules: a literal, of the rules' own size.
    lists = F.create_map(*(x for t in trigrams for x in (F.lit(t), F.array(*(F.struct(F.lit(k).alias("clause"), F.lit(1 << c.index(t)).cast("bigint").alias("bit")) for k, c in clauses if t in c)))))
    whole = F.create_map(*(x for k, c in clauses for x in (F.lit(k), F.lit((1 << len(c)) - 1).cast("bigint"))))
    posted = postings(docs, trigrams).select("key", F.explode(lists[F.col("trigram")]).alias("x")).select("key", "x.clause", "x.bit")
    # A repeated row is on a list more than once, but sets the same bit.
    met = posted.groupBy("key", "clause").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == whole[F.col("clause")])
    return met.groupBy("key").agg(F.collect_set(F.floor(F.col("clause") / 1000).cast("int")).alias("rules"))


def _spans(text: Column, rule: Rule, index: int) -> Column:
    """(start, kind index, end) of a rule's matches: what stands between matches and the matches add up to positions."""
    rx = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.char_length).alias("size"),
        F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), F.char_length).alias("part"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def ends(block: Column, at: Column) -> Column:
        """Where each match of a block ends, if what is before the block ends at `at`."""
        return F.aggregate(block, F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, x: let(a["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0)), lambda e: F.struct(e.alias("at"), F.concat(a["out"], F.array(e)).alias("out"))), lambda a: a["out"])

    def spans(p: Column) -> Column:
        # Sums up to each match in blocks of about the root of their number: an array that grows one by one is copied each time.
        n = F.size(p)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(p, (k * width + 1).cast("int"), width))
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.coalesce(x["size"], F.lit(0)))
        begins = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, c: F.struct((a["at"] + total(c)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        at = F.flatten(F.zip_with(blocks, begins, ends))
        all_ = F.transform(F.arrays_zip(p.alias("p"), at.alias("end")), lambda x: F.struct((x["end"] - x["p"]["size"]).alias("start"), F.lit(index).alias("kind"), x["end"].alias("end"), x["p"]["part"].alias("part")))
        return F.transform(F.filter(all_, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return F.when(text.rlike(rule.pattern), let(parts, spans)).otherwise(empty)


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs (doc_id, text, and more) with spans: array of (start, kind, end) by start, then by the rules' order.

    Positions are code points, end exclusive; per rule leftmost matches that don't overlap. kind is the rule's number.
    A null text counts as empty; repeated rows come out each. A column named spans is replaced.
    """
    scans_all = {r for r, rule in enumerate(rules) if trigram_query(rule.pattern) == ANY}
    keep = [c for c in docs.columns if c != "spans"]
    found = candidates(docs.where("text IS NOT NULL"), rules)
    rows = docs.select(*keep, _key().alias("__key")).join(found.select(F.col("key").alias("__key"), F.col("rules").alias("__rules")), "__key", "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    each = [_spans(text, rule, r) if r in scans_all else F.when(F.array_contains("__rules", r), _spans(text, rule, r)).otherwise(none) for r, rule in enumerate(rules)]
    return rows.select(*keep, F.sort_array(F.concat(*each)).alias("spans"))


def spans_text(spans: Column, rules=RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules=RULES, mark: str = "<secret>") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one)."""
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))),
    )
    return scan(docs, rules).withColumn("text", F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    each = "\nUNION ALL\n".join(
        f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, unnest(range(len(m))) AS i, gaps, m, g, {r.least} AS least FROM (SELECT doc_id, "
        f"string_split_regex(text, {q(r.pattern)}) AS gaps, regexp_extract_all(text, {q(r.pattern)}, 0) AS m, regexp_extract_all(text, {q(r.pattern)}, {r.group}) AS g FROM documents) WHERE len(m) > 0"
        for k, r in enumerate(RULES)
    )
    return f"""
WITH found AS ({each}),
spans AS (
  SELECT doc_id, kind, name, s AS "start", s + length(m[i + 1]) AS "end" FROM (
    SELECT *, list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s FROM found WHERE length(g[i + 1]) >= least)
), agg AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(name || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", kind) FILTER (kind < {len(BASE)}) AS base,
    string_agg(name || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", kind) AS a FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(a, '') AS spans FROM documents d LEFT JOIN agg USING (doc_id)
"""


OP1_SQL = _sql()
