"""Cross-site boilerplate lines: spread over sites by HyperLogLog, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import let, table, written

#: Distinct sites that make a line boilerplate; the sketch's lg k, and how far (in shares of the threshold) an estimate
#: may be off: with lg k = 9 the standard error is under 4.6 %, so a quarter is over five of them.
SITES, LG_K, MARGIN = 3, 9, 0.25
#: A line is common if more than one in so many lines is like it: there are fewer such lines than this.
COMMON = 1000


def line_key(line: Column) -> Column:
    """128 bits of a line, as two bigints: equal keys stand for equal lines."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """row (128 bits of doc_id and text), doc_id, site, pos (from 0), a, b for every line with a word."""
    t = F.col(text)
    base = docs.where(t.isNotNull()).select(row_key(doc_id, text).alias("row"), F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.split(t, "\n", -1).alias("l"))
    flat = base.select("row", "doc_id", "site", F.posexplode("l").alias("pos", "line")).where(_has_word(F.col("line")))
    return flat.select("row", "doc_id", "site", "pos", line_key(F.col("line")).alias("k")).select("row", "doc_id", "site", "pos", "k.a", "k.b")


def row_key(doc_id: str, text: str) -> Column:
    """A row by what it holds: rows of the same doc_id and text are treated alike."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("row"), F.col(text), F.col(doc_id)).alias("b"))


def _meet(flat: DataFrame, found: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """flat joined with lines found (a, b, times). A line on more than one row in COMMON of the total is one of fewer than
    COMMON such lines, so these are broadcast and their rows stay where they are; no partition gets all rows of one."""
    common = F.col("times") * COMMON > total
    hot = flat.join(F.broadcast(found.where(common).drop("times")), ["a", "b"], how)
    return hot.unionByName(flat.join(found.where(~common).drop("times"), ["a", "b"], how))


def boilerplate(flat: DataFrame, sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN) -> tuple[DataFrame, int]:
    """a, b, times, first_id, first_pos of the lines that `sites` distinct sites have, or more: how often they stand and
    where first. And the number of lines of flat, rounded up.

    Sketches are built before the shuffle and merged after it, so a line on all pages is a row per task. An estimate
    further from the threshold than the margin decides; the lines nearer to it, few, are counted exactly. A null site
    is no site. Lines of fewer occurrences than sites need no sketch.
    """
    often = flat.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("times"),
        F.count("site").alias("n"),
        F.hll_sketch_agg("site", lg_k).alias("sketch"),
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("pos"))).alias("first"),
    )
    spread = often.where(F.col("n") >= sites).select("a", "b", "times", F.hll_sketch_estimate("sketch").alias("estimate"), F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    spread = written(spread, "spread")
    total = flat.count()
    near = F.col("estimate").between(sites * (1 - margin) - 1, sites * (1 + margin) + 1)
    sure = spread.where((F.col("estimate") >= sites) & ~near).drop("estimate")
    unsure = spread.where(near).drop("estimate")
    pairs = _meet(flat.where("site IS NOT NULL").select("a", "b", "site"), unsure.select("a", "b", "times"), total, "left_semi").distinct()
    exact = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites).select("a", "b")
    return sure.unionByName(unsure.join(exact, ["a", "b"], "left_semi")), total


def dedup_lines(docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", removed: str | None = None) -> DataFrame:
    """docs without boilerplate lines: each stays where it first stands (least doc_id, then position) and goes elsewhere.

    Every column stays, n_chars (if there is one) is the new text's length where the text has changed. removed: the name
    of one more column, with the number of lines that went. Null and empty texts stay as they are, repeated rows are
    treated alike, rows with a null doc_id come after all others. Lines without a word never go.
    """
    flat = written(lines(docs, text, site, doc_id), "lines")
    found, total = boilerplate(flat, sites)
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))
    out = _meet(flat.select("a", "b", "row", "doc_id", "pos"), found, total).where(~first).groupBy("row").agg(F.collect_set("pos").alias("__gone"))
    rows = docs.withColumn("__row", row_key(doc_id, text)).join(out.withColumnRenamed("row", "__row"), "__row", "left")
    # The lines that stay, by their places: a set difference, whatever the number of lines and of those that go.
    rest = let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n"))
    changed = F.col("__gone").isNotNull()
    rows = rows.withColumn(text, F.when(changed, rest).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    own = [c for c in docs.columns if c != removed]
    return rows.select(*own, *([F.when(changed, F.size("__gone")).otherwise(0).cast("bigint").alias(removed)] if removed else []))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = dedup_lines(docs, removed="n_removed")
    return out.select("doc_id", "n_removed", F.char_length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), spread AS (
  SELECT line, min(doc_id * 1000000 + pos) AS first FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {SITES}
), kept AS (
  SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AND s.first <> l.doc_id * 1000000 + l.pos AS gone
  FROM l LEFT JOIN spread s ON l.line = s.line
), t AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM kept GROUP BY doc_id
)
SELECT doc_id, n_removed::BIGINT AS n_removed, length(text)::BIGINT AS n_chars_left, sha256(text) AS text_sha256 FROM t
"""
