"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.llm.common import Written, small, table, tidy

CAPACITY, SEPARATOR_ID = 2048, 0
#: Islands that a task evolves, about.
ISLANDS = 8


@dataclass(frozen=True)
class Evolution:
    """Islands per block of items; on each, `population` packings evolve for `generations`, in `epochs` with the `elite`
    best of each island moving to the next one in between. Blocks hold about `block` items; those of bins below `full`
    are packed again in later levels, together with other blocks' ones."""

    islands: int = 2
    population: int = 8
    generations: int = 30
    epochs: int = 2
    elite: int = 2
    block: int = 2048
    full: float = 0.985
    levels: int = 4


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = SEPARATOR_ID, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each row's pieces: all of them but the last have capacity ids.

    A null text is an empty one: its only id is the end. Repeated rows give pieces of their own.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestream.llm.tokens import encoder

        e = encoder(tokenizer)
        for b in small(batches, 1, 4 << 20):
            ids, off = e.encode(b.column(1), end)
            sizes = np.diff(off)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            at = off[:-1][row] + start
            raw = ids.astype("<u4", copy=False)
            crc = np.fromiter((zlib.crc32(raw[i : i + k]) for i, k in zip(at, length, strict=True)), np.int64, len(row))
            out = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), schema)


class Bins:
    """Groups of items with best fit: the bin with the least room that is enough."""

    def __init__(self, capacity: int):
        self.capacity, self.members, self.fill = capacity, [], []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms = 0  # bit r: a bin with room r

    def add(self, members: list[int], fill: int) -> None:
        self.members.append(members)
        self.fill.append(fill)
        self._offer(len(self.fill) - 1)

    def _offer(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        self.by_room[room].append(b)
        self.rooms |= 1 << room

    def best_fit(self, item: int, size: int) -> None:
        fits = self.rooms >> size
        if not fits:
            self.add([item], size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.by_room[room]
        b = at.pop()
        if not at:
            self.rooms ^= 1 << room
        self.members[b].append(item)
        self.fill[b] += size
        self._offer(b)


def packed(sizes: list[int], order, capacity: int) -> Bins:
    out = Bins(capacity)
    for i in order:
        out.best_fit(i, sizes[i])
    return out


def score(bins: Bins) -> tuple[int, int]:
    """Fewer bins, then fuller ones: less is better."""
    return len(bins.fill), -sum(f * f for f in bins.fill)


def trade(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Bins get one larger displaced item for one or two of theirs, where it fits; the displaced items after that, which
    are as many or more, but smaller and so easier to place."""
    free = sorted((sizes[i], i) for i in displaced)
    for m in bins:
        room = capacity - sum(sizes[i] for i in m)
        if not room or not free:
            continue
        best = (0, 0, ())
        for k, i in enumerate(m):
            for go in ((i,), *((i, j) for j in m[k + 1 : k + 4])):
                held = sum(sizes[x] for x in go)
                at = bisect(free, (held + room, len(sizes))) - 1
                if at >= 0 and free[at][0] - held > best[0]:
                    best = (free[at][0] - held, at, go)
        if best[0]:
            m.append(free.pop(best[1])[1])
            for x in best[2]:
                m.remove(x)
                insort(free, (sizes[x], x))
    return [i for _, i in free]


def crossover(into: Bins, donor: Bins, sizes: list[int], rng: np.random.Generator) -> Bins:
    """Whole well-filled bins of donor are injected; bins of `into` with the same items are broken up; what they held
    besides is best-fitted, largest first, after trade() has made it smaller. A few of the emptiest bins are broken up
    too, as mutation."""
    level = sorted(donor.fill)[len(donor.fill) // 2]
    well = [b for b, f in enumerate(donor.fill) if f >= level]
    chosen = [well[i] for i in np.flatnonzero(rng.random(len(well)) < 0.5)] or well[:1]
    kept, injected = [], set()
    for b in chosen:
        kept.append(list(donor.members[b]))
        injected.update(donor.members[b])
    emptiest = sorted(into.fill)[min(len(into.fill) - 1, int(rng.integers(1, 4)))]
    displaced = []
    for m, f in zip(into.members, into.fill, strict=True):
        if f <= emptiest or not injected.isdisjoint(m):
            displaced += [i for i in m if i not in injected]
        else:
            kept.append(list(m))
    displaced = trade(kept, displaced, sizes, into.capacity)
    out = Bins(into.capacity)
    for m in kept:
        out.add(m, sum(sizes[i] for i in m))
    noise = rng.random(len(displaced)) * 0.05
    for k in sorted(range(len(displaced)), key=lambda k: -sizes[displaced[k]] * (1 + noise[k])):
        out.best_fit(displaced[k], sizes[displaced[k]])
    return out


def evolve(sizes: list[int], elites: list[list[int]], seed: list[int], how: Evolution, capacity: int) -> list[list[int]]:
    """The best packings of an island, each as a bin number per item, after some generations from elites on."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // capacity)
    groups = []
    for e in elites:
        by = defaultdict(list)
        for i, b in enumerate(e):
            by[b].append(i)
        bins = Bins(capacity)
        for m in by.values():
            bins.add(m, sum(sizes[i] for i in m))
        groups.append(bins)
    largest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    if not groups:
        groups.append(packed(sizes, largest, capacity))
    while len(groups) < how.population and min(len(g.fill) for g in groups) > bound:
        noise = 1 + rng.random(len(sizes)) * 0.2
        groups.append(packed(sizes, sorted(largest, key=lambda i: -sizes[i] * noise[i]), capacity))
    groups.sort(key=score)
    for _ in range(how.generations):
        if len(groups[0].fill) <= bound:
            break
        a, b = sorted(rng.choice(len(groups), 2, replace=False)) if len(groups) > 1 else (0, 0)
        groups.append(crossover(groups[a], groups[b], sizes, rng))
        groups = sorted(groups, key=score)[: how.population]
    out = []
    for g in groups[: how.elite]:
        number = [0] * len(sizes)
        for b, m in enumerate(g.members):
            for i in m:
                number[i] = b
        out.append(number)
    return out


_ISLAND = "block bigint, island int, sizes array<int>, elites array<array<int>>"


def _epoch(islands: DataFrame, epoch: int, level: int, how: Evolution, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                r["elites"] = evolve(r["sizes"], r["elites"], [r["block"], r["island"], epoch, level], how, capacity)
                yield pa.RecordBatch.from_pylist([r], schema=pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("elites", pa.list_(pa.list_(pa.int32())))]))

    return islands.mapInArrow(tidy(run), _ISLAND)


def _solve(blocks: DataFrame, n: int, level: int, how: Evolution, capacity: int) -> DataFrame:
    """block and bins (a bin number per item): the best packing of any island of the block."""
    islands = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"), F.transform("items", lambda x: x["length"].cast("int")).alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("elites"))
    # By number, as few bytes are much work here: a task has ISLANDS islands.
    islands = _epoch(islands.repartition(max(1, -(-n * how.islands // ISLANDS)), "block", "island"), 0, level, how, capacity)
    for e in range(1, how.epochs):
        islands = Written(islands, "islands").df
        moved = islands.select("block", F.pmod(F.col("island") + 1, F.lit(how.islands)).alias("island"), F.lit(None).cast("array<int>").alias("sizes"), "elites")
        met = islands.unionByName(moved).groupBy("block", "island").agg(F.max("sizes").alias("sizes"), F.flatten(F.collect_list("elites")).alias("elites"))
        islands = _epoch(met, e, level, how, capacity)
    best = islands.select("block", "island", "sizes", F.explode("elites").alias("bins"))
    return best.groupBy("block").agg(F.min_by("bins", F.struct(F.array_max("bins"), "island")).alias("bins"))


def pack(items: DataFrame, capacity: int = CAPACITY, how: Evolution = Evolution()) -> DataFrame:  # noqa: B008
    """items (with length, from 1 to capacity, and any other columns) with sequence_id and offset.

    Items of the full length are a sequence each. The rest is dealt at random to blocks of bounded size, a block evolves
    on its islands, and what its fuller bins hold is settled; the others' items go to a next level with fewer blocks,
    down to one block or the last level. So no task sees more than a block, however many items there are.
    """
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = Written(items.select(*columns), "items").df
    serial = F.monotonically_increasing_id()
    done = [rows.where(F.col("length") >= capacity).select(*columns, (F.lit(1 << 62) + serial).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    left = rows.where(F.col("length") < capacity)
    for level in range(how.levels):
        n = left.count()
        if not n:
            break
        blocks_n = max(1, round(n / how.block))
        last = blocks_n == 1 or level == how.levels - 1
        dealt = left.select(F.pmod(F.xxhash64(serial, F.lit(level)), F.lit(blocks_n)).alias("block"), F.struct(*columns).alias("x"))
        blocks = Written(dealt.groupBy("block").agg(F.collect_list("x").alias("items")), "blocks").df
        solved = blocks.join(_solve(blocks, blocks_n, level, how, capacity), "block")
        placed = Written(_placed(solved, columns, level, 2.0 if last else how.full, capacity), "placed").df
        done.append(placed.where("NOT __again").select(*columns, "sequence_id", "offset"))
        left = placed.where("__again").select(*columns)
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _placed(solved: DataFrame, columns: list[str], level: int, full: float, capacity: int) -> DataFrame:
    """A row per item: its sequence, its offset there, and whether it is to be packed again (its bin isn't full)."""
    w = F.transform(F.arrays_zip(F.col("items"), F.col("bins")), lambda z: F.struct(z["bins"].alias("b"), z["items"]["length"].alias("n"), z["items"].alias("x")))
    rows = solved.select("block", F.posexplode(w).alias("i", "z"))
    bin_ = Window.partitionBy("block", "z.b")
    before = F.coalesce(F.sum("z.n").over(bin_.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = F.lit(False) if full > 1 else F.sum("z.n").over(bin_) < full * capacity
    number = F.lit(level << 56) + F.shiftleft("block", 16) + F.col("z.b")
    return rows.select(*(F.col("z.x")[c].alias(c) for c in columns), number.alias("sequence_id"), before.cast("bigint").alias("offset"), again.alias("__again"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
