"""SimHash fingerprints, linked by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Written, table, tidy
from lodestream.llm.graph import components

#: Bytes of a fingerprint, and bits that a near copy may differ in. 2 bits touch 2 bytes at most, so 6 of 8 agree.
BYTES, MAX_BITS = 8, 2
LEAST_SHARED = BYTES - MAX_BITS
#: Posting lists of more fingerprints than this are split by one-bit neighbours instead of being paired.
LONG_LIST = 48
_CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if over half of the shingles' XXH64 have it. No word: 0."""
    import xxhash

    digest = xxhash.xxh64_digest
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        return int.from_bytes(digest(b" ".join(w), 42), "big")
    total, n = np.zeros(64, np.int64), len(w) - words + 1
    for at in range(0, n, _CHUNK):
        part = w[at : at + _CHUNK + words - 1]
        raw = b"".join([digest(b" ".join(x), 42) for x in zip(*(part[i:] for i in range(words)), strict=False)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", words: int = 3) -> DataFrame:
    """The columns keep of docs, with fp: the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(len(keep))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    schema = picked.select(*keep, F.lit(0).cast("bigint").alias("fp")).schema
    return picked.mapInArrow(tidy(run), schema)


def _shared_bytes(x: Column) -> Column:
    """How many positional bytes two fingerprints share, from their XOR."""
    return sum((F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(255) == 0, 1).otherwise(0) for i in range(BYTES)), F.lit(0))


def _postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the six pairs of its four aligned byte pairs.

    A list of one positional byte would hold a 256th of all rows, so lists are intersected before they are written: if 6
    of 8 bytes agree, 2 of the 4 byte pairs do, and so one key of four positional bytes is the same.
    """
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = [F.lit(n << 32).bitwiseOR(F.shiftleft(part[i], 16)).bitwiseOR(part[j]) for n, (i, j) in enumerate(pairs)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """(u, v), u < v: links between distinct fingerprints fps(fp) that connect all which differ in max_bits (0 to 2).

    Lists of up to long_list fingerprints: each pair's shared positional bytes are tallied, pairs with 8 - max_bits or more
    are compared bit by bit. Longer lists: two members within 2 bits are both within 1 bit of a third value, and at most 65
    values are, so each member goes under itself and its one-bit neighbours and those under one value form a star. That
    links the same fingerprints with rows in proportion to the list.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("max_bits: 0, 1 or 2")
    posted = _postings(fps)
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = posted.join(sizes, "key")
    short = listed.where(F.col("n") <= long_list).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    pair = F.explode(
        F.flatten(
            F.transform(
                "l",
                lambda x, i: F.transform(
                    F.filter(F.slice("l", i + 2, F.greatest(F.size("l") - i - 1, F.lit(0))), lambda y: (_shared_bytes(x.bitwiseXOR(y)) >= BYTES - max_bits) & (F.bit_count(x.bitwiseXOR(y)) <= max_bits)),
                    lambda y: F.struct(x.alias("u"), y.alias("v")),
                ),
            )
        )
    )
    paired = short.select(pair.alias("p")).select("p.u", "p.v")
    long = listed.where(F.col("n") > long_list).select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    if max_bits == 2:
        stars = long.select("fp", F.explode(near).alias("key")).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("l")).where(F.size("l") > 1)
        starred = stars.select(F.col("l")[0].alias("u"), F.explode(F.slice("l", 2, 65)).alias("v"))
    else:
        starred = long.select("fp", F.explode(near).alias("other")).join(long.select(F.col("fp").alias("other")), "other", "left_semi").select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).where("u <> v")
        starred = starred if max_bits else starred.limit(0)
    return paired.unionByName(starred).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """keep (doc_id at least), fingerprint and component_id for each row of docs.

    component_id is the least doc_id that links lead to. Equal texts have equal fingerprints and are one node. A null or
    empty text has fingerprint zero and is linked like any other. Rows with a null doc_id are members, but don't give
    their component its name (null if there is no other). Repeated rows each come out. Other columns of docs are ignored.
    """
    keep = list(dict.fromkeys([doc_id, *(keep or [])]))
    rows = Written(with_fingerprint(docs, keep, text, words), "fingerprints").df
    fps = Written(rows.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "fps").df
    roots = components(links(fps, max_bits)).select(F.col("node").alias("fp"), "root")
    named = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(*keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
