"""Language identification by bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Written, table, tidy

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """n-gram lengths; log2 of the filter's slots; hashes of an n-gram; the share of a language's n-grams that one needs
    to be in its filter, so that a few mislabelled texts don't put theirs there."""

    sizes: tuple[int, ...] = (2, 3)
    bits: int = 17
    hashes: int = 2
    least_share: float = 2e-5


_LETTERS: np.ndarray | None = None
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Characters that are looked at together.
_CHUNK = 1 << 20


def _letters() -> np.ndarray:
    """By code point: True if it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _grams(text: str, how: Settings) -> Iterator[np.ndarray]:
    """Slots (hashes x n-grams) of all n-grams of a text; runs of what aren't letters count as one space."""
    letters = _letters()
    overlap = max(how.sizes) - 1
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(text), _CHUNK):
        c = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters[c], c, 0).astype(np.uint32)
        c = np.concatenate([tail, c, np.zeros(int(at + _CHUNK >= len(text)), np.uint32)])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.uint64)
        for n in how.sizes:
            skip = max(0, len(tail) - (n - 1)) if at else 0  # n-grams that the chunk before has had
            if len(c) - skip < n:
                continue
            h = np.zeros(len(c) - n + 1 - skip, np.uint64)
            for i in range(n):
                h = (h ^ c[skip + i : len(c) - n + 1 + i]) * _MULTIPLIERS[0] + np.uint64(n)
                h ^= h >> np.uint64(29)
            yield np.stack([((h * m) >> np.uint64(64 - how.bits)).astype(np.int64) for m in _MULTIPLIERS[: how.hashes]])
        tail = c[-overlap:].astype(np.uint32)


def _counts(rows: DataFrame, languages: list[str], how: Settings) -> DataFrame:
    """(lang, slot, n): how often n-grams of a language's texts fell into a slot of the counting filter."""
    at = {x: i for i, x in enumerate(languages)}
    slots = how.hashes << how.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(slots, np.int64)
                for g in _grams(text.as_py(), how):
                    for k in range(how.hashes):
                        slot, n = np.unique(g[k] + (k << how.bits), return_counts=True)
                        total[lang][slot] += n
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), at[lang]), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used])], names=["lang", "slot", "n"])

    found = rows.where(F.col("lang").isin(languages)).select("lang", "text").mapInArrow(tidy(run), "lang int, slot int, n bigint")
    return found.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class Filters:
    """masks[word, k, slot]: a bit per language that has an n-gram there for hash k, 64 languages to a word. An n-gram's
    languages are the AND of its slots; a language's false positive rate is the product over k of the share of slots
    that it has set."""

    def __init__(self, languages: list[str], masks: np.ndarray, how: Settings):
        self.languages, self.masks, self.how = languages, masks, how
        bits = [((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean(axis=1) for i in range(len(languages))]
        self.wrong = np.array([b.prod() for b in bits]) if languages else np.zeros(0)

    def languages_of(self, slots: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages 64 * word to 64 * word + 63 of each n-gram, as bits."""
        found = self.masks[word, 0][slots[0]]
        for k in range(1, len(slots)):
            found = found & self.masks[word, k][slots[k]]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the most n-grams, corrected for false positives, and its share of the text's n-grams."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for g in _grams(text, self.how):
            n += g.shape[1]
            for word in range(len(self.masks)):
                by_mask, count = np.unique(self.languages_of(g, word), return_counts=True)
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hits[i] += count[(by_mask >> np.uint64(i & 63)) & np.uint64(1) == 1].sum()
        if not n or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        right = np.clip((hits - n * self.wrong) / np.maximum(n * (1 - self.wrong), 1e-9), 0, 1)
        best = int(np.argmax(right))
        return self.languages[best], float(right[best])


def train(docs: DataFrame, how: Settings = Settings()) -> Filters:  # noqa: B008
    """Filters from all rows of docs with text and lang, whatever the number of languages. What comes to the driver is the
    filters themselves: a word for each slot and 64 languages. No such row: no language."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    masks = np.zeros((-(-len(languages) // 64), how.hashes, 1 << how.bits), np.uint64)
    if languages:
        counts = Written(_counts(rows, languages, how), "slot-counts").df
        least = counts.groupBy("lang").agg((F.sum("n") / how.hashes * how.least_share).alias("least"))  # a row a language, as the driver has them
        set_ = counts.join(F.broadcast(least), "lang").where(F.col("n") >= F.greatest(F.lit(1.0), "least"))
        bit = F.expr("shiftleft(1L, lang & 63)")
        got = set_.groupBy(F.shiftright("lang", 6).alias("word"), "slot").agg(F.bit_or(bit).alias("bits")).toArrow()
        word, slot, bits = (got.column(i).to_numpy() for i in range(3))
        masks.reshape(len(masks), -1)[word, slot] = bits.view(np.uint64)
    return Filters(languages, masks, how)


def predict(docs: DataFrame, filters: Filters, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred and score (0 to 1) of each row. `und` with score 0: a null text, one without letters, or nothing learned."""
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(*sent.value)
        for b in batches:
            got = [f.predict(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    picked = docs.select(*keep, F.col(text).alias("__text"))
    return picked.mapInArrow(tidy(run), picked.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """crc32(doc_id as text) mod folds is fold; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    filters = train(docs.where("NOT held_out").select("text", "lang"))
    return predict(docs, filters, ["doc_id", "held_out"])
