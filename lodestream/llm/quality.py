"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import SPACE_RX, SPACES, ascii_lower, let, table

#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for with as on by was from this or an be are it "
    "der die das und in den von zu mit für ist auf im dem ein eine des sich auch als "
    "le la les de et des un une du que en dans pour est avec par sur au pas plus "
    "el los las y que se con no su para por una del al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric has to be within lo and hi, both allowed and None for open. at_least_words: shorter texts pass."""

    metric: str
    lo: float | None = None
    hi: float | None = None
    at_least_words: int = 0


#: Lenient on purpose: a rule rejects what is no prose, not what is merely unusual.
RULES = (
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.005, None, 80),
    Rule("dup_line_ratio", None, 0.50),
    Rule("mean_line_words", 1.5, None, 80),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by hash, so equal ones are neighbours."""
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    starts = let(
        F.sort_array(windows),
        lambda s: F.sort_array(
            F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])
        ),
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("c")),
        lambda a, d: F.struct(d.alias("p"), (a["c"] + F.least(F.lit(3), d - a["p"])).alias("c")),
        lambda a: a["c"],
    )
    return F.when(n >= 3, covered).otherwise(F.lit(0).cast("long"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measures(text: Column) -> Column:
    """All measures of a text as one struct. Its words and lines are bound once, so that no rewriting of the plan (a
    filter pushed below, two projections made one) can put their computation into a loop over words."""
    t = F.coalesce(text, F.lit(""))
    count = lambda c: c.cast("long")

    def of(words: Column, lines: Column) -> Column:
        n = F.size(words)
        return F.struct(
            count(n).alias("n_words"),
            count(F.char_length(F.translate(t, SPACES, ""))).alias("word_chars"),
            count(F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).alias("n_symbols"),
            count(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            _repeat_words(words, n).alias("n_repeat_words"),
            count(F.size(lines)).alias("n_lines"),
            count(F.size(F.filter(words, lambda x: ascii_lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
        )

    words = F.filter(F.split(t, SPACE_RX, -1), lambda x: x != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words, lambda w: let(lines, lambda x: of(w, x)))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "mean_line_words": ("n_words", "n_lines"),
}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def verdict(m: Column, rules=RULES) -> Column:
    """The conjunction of the rule table, as one boolean over a struct of measures."""
    out = F.lit(True)
    for r in rules:
        a, b = RATIOS[r.metric]
        x, ok = F.coalesce(F.try_divide(m[a].cast("double"), m[b].cast("double")), F.lit(0.0)), F.lit(True)
        if r.lo is not None:
            ok = ok & (x >= r.lo)
        if r.hi is not None:
            ok = ok & (x <= r.hi)
        out = out & (ok | (m["n_words"] < r.at_least_words))
    return out


def is_kept(text: Column, rules=RULES) -> Column:
    """A filter condition: neither base_failed nor rejected by the rules. It measures a text once."""
    return let(measures(text), lambda m: ~base_failed(m) & verdict(m, rules))


def quality(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed and kept; to drop what isn't kept, filter docs by is_kept().

    All of a text is looked at, whatever its length; a null text counts as an empty one. Repeated rows are measured each
    on its own, empty in is empty out. Columns of docs that have the name of a measure or verdict are replaced by it.
    """
    own = [c for c in docs.columns if c not in (*MEASURES, "base_failed", "kept")]
    m = F.col("__m")
    return docs.select(*own, measures(F.col(text)).alias("__m")).select(*own, *(m[k].alias(k) for k in MEASURES), base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same measures and thresholds in SQL."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = {"mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_word_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "mean_line_words": "n_words / greatest(n_lines, 1)"}
    rules = " AND ".join(f"(n_words < {r.at_least_words} OR " + " AND ".join(f"{ratio[r.metric]} {op} {v}" for op, v in ((">=", r.lo), ("<=", r.hi)) if v is not None) + ")" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
q AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({stop}))) AS n_stop FROM s LEFT JOIN q USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {rules} AS kept FROM f
"""


OP5_SQL = _sql()
