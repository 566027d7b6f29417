"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Written, table, tidy

#: Words of a window, and words of items in one automaton at most (about 1 KB of Python objects a word).
WINDOW, SHARD_WORDS = 10, 200_000
#: A word's bytes: digits, letters and all that isn't ASCII. A-Z to a-z, any other byte to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; streams a text and reports where items' windows occur.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}  # of states of `window` words or more: the items that have their words
        self.whole: dict[int, set] = {}  # of states that are all of a short item
        ends: list[tuple[int, object, list[int]]] = []
        for name, words in items:
            if words:
                last, path = 0, [self.ids.setdefault(w, len(self.ids)) for w in words]
                for c in path:
                    last = self._extend(last, c)
                ends.append((last, name, path))
        for _, name, path in ends:
            at = 0
            for n, c in enumerate(path, 1):
                at = self.next[at][c]
                up = at
                if n >= window:
                    while up > 0 and self.length[up] >= window and name not in self.items.setdefault(up, set()):
                        self.items[up].add(name)
                        up = self.link[up]
            if len(path) < window:
                self.whole.setdefault(at, set()).add((len(path), name))
        # The nearest state up the links, itself included, that has whole short items.
        self.short = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]]
        self.least = min([window, *(n for got in self.whole.values() for n, _ in got)])

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, codes: list[int], at: int, spans: list[tuple[int, int]], found: set) -> None:
        """Streams codes, whose first is word `at` of a text: appends (start, end) of hit words and adds items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for i, c in enumerate(codes, at + 1):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= window:
                spans.append((i - window, i))
                top = state
                while length[link[top]] >= window:
                    top = link[top]
                found |= self.items[top]
            s = self.short[state]
            while s:
                for n, name in self.whole[s]:
                    if n <= matched:
                        spans.append((i - n, i))
                        found.add(name)
                s = self.short[link[s]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (start, end) of the hit words of a text, and the items whose windows occur in it."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if self.ids:
            get = self.ids.get
            codes = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
            # Only runs of enough words that items have can hold a window.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                if b - a >= self.least:
                    self.scan(codes[a:b].tolist(), int(a), spans, found)
        return merge(spans), found


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(items: DataFrame, item_id: str, text: str, shard_words: int, window: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of bounded size, one block in the driver at a time. A longer item is in more blocks than one,
    in parts that overlap by all but one word of a window, so each of its windows is in one part at least."""
    block, size = [], 0
    most = max(shard_words, 2 * window)
    for name, t in items.select(item_id, text).toLocalIterator():
        words = words_of(t)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):
            w = words[at : at + most]
            if block and size + len(w) > most:
                yield block
                block, size = [], 0
            block.append((name, w))
            size += len(w)
    yield block


HITS = "__n_words bigint, __spans array<struct<start:bigint,end:bigint>>, __items array<string>"


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with __n_words, __spans (merged hit words, from start up to end) and __items (their ids as strings).

    A null text has no words, an item without words no window, an item without id counts as 'null'. Repeated rows and
    items each count. Columns of docs with one of these names are replaced. Items go to the executors in blocks of
    shard_words words. One block, the usual case, is one pass over docs without a shuffle. More blocks are passes one
    after the other, each in a job of its own that writes the rows it hits, so that a worker holds one automaton at a time
    and the driver one block; rows then meet what was written by 128 bits of their text.
    """
    own = [c for c in docs.columns if c not in ("__n_words", "__spans", "__items")]
    docs = docs.select(*own)
    blocks = _shards(items, item_id, item_text, shard_words, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return docs.mapInArrow(tidy(_scanner(docs, block, text, window)), f"{_ddl(docs)}, {HITS}")
    texts = docs.select(F.col(text).alias("__text"))
    parts = []
    while block is not None:
        found = texts.mapInArrow(tidy(_scanner(texts, block, "__text", window)), f"{_ddl(texts)}, {HITS}")
        parts.append(Written(found.where(F.size("__spans") > 0).select(*_key("__text"), "__spans", "__items").distinct(), "hits").df)
        block, after = after, next(blocks, None)
    met = reduce(DataFrame.unionByName, parts).groupBy("__a", "__b").agg(F.flatten(F.collect_list("__spans")).alias("__s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__i"))
    none = docs.mapInArrow(tidy(_scanner(docs, [], text, window)), f"{_ddl(docs)}, {HITS}").drop("__spans", "__items")
    rows = none.select("*", *_key(text)).join(met, ["__a", "__b"], "left")
    spans, names = HITS.split(", ")[1].split(" ")[1], "array<string>"

    @F.pandas_udf(spans)
    def merged(s):
        import pandas as pd

        return pd.Series([[{"start": a, "end": z} for a, z in merge([(y["start"], y["end"]) for y in x])] for x in s])

    return rows.select(
        *own,
        "__n_words",
        F.when(F.col("__s").isNull(), F.expr(f"cast(array() as {spans})")).otherwise(merged(F.coalesce("__s", F.expr(f"cast(array() as {spans})")))).alias("__spans"),
        F.coalesce("__i", F.expr(f"cast(array() as {names})")).alias("__items"),
    )


def _key(text: str) -> tuple[F.Column, F.Column]:
    return F.xxhash64(text).alias("__a"), F.xxhash64(F.lit("hits"), F.col(text)).alias("__b")


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)


_BUILT: dict[str, Automaton] = {}


def _scanner(docs: DataFrame, block: list[tuple[object, list[bytes]]], text: str, window: int):
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast([(n, b" ".join(w)) for n, w in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestream.llm import decontaminate as here

        if key not in here._BUILT:
            here._BUILT.clear()
            here._BUILT[key] = here.Automaton([(n, w.split()) for n, w in sent.value], window)
        automaton = here._BUILT[key]
        for b in batches:
            counts, spans, names = [], [], []
            for x in b.column(b.schema.names.index(text)):
                words = here.words_of(x.as_py())
                got, found = automaton.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": z} for a, z in got])
                names.append(sorted({str(n) if n is not None else "null" for n in found}))
            out = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "__n_words", "__spans", "__items"])

    return run


def n_hit() -> F.Column:
    return F.aggregate("__spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """keep (doc_id), n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs; see find_hits()."""
    keep = keep or ["doc_id"]
    hits = find_hits(docs.select(*keep, "text"), items, **how)
    return hits.select(
        *keep,
        F.col("__n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    clean = raw.translate(_TABLE)
    flags = np.frombuffer(clean, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    for a, b in spans:
        out.append(raw[at : edges[2 * a]])
        at = int(edges[2 * b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", most_share: float = 0.5, **how) -> DataFrame:
    """docs without what items' windows hit: hit spans are cut out of texts, and a document with more than most_share of
    its words hit, or with nothing but them, goes.

    The columns of docs stay as they are, n_chars (if there is one) is the new text's length. Documents without hits,
    null and empty texts come out unchanged.
    """
    hits = find_hits(docs, items, text, **how)
    kept = hits.where((F.size("__spans") == 0) | (n_hit() <= most_share * F.col("__n_words")))

    @F.pandas_udf("string")
    def cut(t, s):
        import pandas as pd

        return pd.Series([cut_spans(x, [(y["start"], y["end"]) for y in z]) if len(z) else x for x, z in zip(t, s, strict=True)])

    new = F.when(F.size("__spans") > 0, cut(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    out = kept.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Windows of items and documents as joined words, met in a join.
OP10_SQL = """
WITH dw AS (SELECT r, doc_id, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)) JOIN win USING (n, g)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM dw LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
