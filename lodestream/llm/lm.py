"""A small causal self-attention language model in numpy over subword ids, trained and applied where the texts are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import Written, small, table, tidy

VOCABULARY, BOUNDARY = 50_257, 50_256
#: Bytes of text and ids that a task looks at together (a longer text is looked at whole).
TEXT_BYTES, IDS = 2 << 20, 1 << 18


@dataclass(frozen=True)
class Settings:
    """symbols: the most frequent ids each are one, all others share symbol 0. classes: of symbols, which attention tells
    apart. window, stride: a context window's ids, of which the last stride ones are scored. rounds: all windows of a
    training row are dealt over them, so each goes through gradient steps (once; again in another round where a row has
    fewer windows than there are rounds). head: words whose counts every task gets."""

    symbols: int = 1024
    classes: int = 64
    width: int = 16
    window: int = 32
    stride: int = 16
    rounds: int = 2
    batch: int = 48
    rate: float = 2e-2
    head: int = 1 << 17


# ---- the model -----------------------------------------------------------------------------------------------------


class Tables:
    """What corpus counts give: symbols, their classes, class and member probabilities after a symbol, and the rest's."""

    def __init__(self, unigrams: np.ndarray, how: Settings):
        self.how = how
        k = how.symbols
        order = np.argsort(-unigrams, kind="stable")[: k - 1]
        self.symbol = np.zeros(VOCABULARY, np.int64)  # as wide as an index, which is what it is used for
        self.symbol[order] = np.arange(1, k)
        if unigrams[BOUNDARY] == 0 or self.symbol[BOUNDARY] == 0:
            self.symbol[BOUNDARY] = k - 1
            self.symbol[order[k - 2]] = 0
        rest = np.where(self.symbol == 0, unigrams + 0.5, 0.0)
        self.rest = np.log(rest / rest.sum(), where=rest > 0, out=np.full(VOCABULARY, -np.inf)).astype(np.float32)

    def fit(self, bigrams: np.ndarray) -> Tables:
        """bigrams: (symbols x symbols), how often one follows the other."""
        how, k = self.how, self.how.symbols
        seen = bigrams.sum(axis=0) + 0.1
        unigram = seen / seen.sum()
        # Interpolated: a symbol's own followers, as far as it has been seen, and everybody's.
        total, kinds = bigrams.sum(axis=1, keepdims=True), (bigrams > 0).sum(axis=1, keepdims=True)
        trust = total / np.maximum(total + kinds + 1, 1)
        after = trust * bigrams / np.maximum(total, 1) + (1 - trust) * unigram
        # Classes by what comes before: symbols with the same predecessors are told apart by the symbol before, not by context.
        share = np.log1p(bigrams / np.maximum(seen, 1) / np.maximum(total / max(total.sum(), 1), 1e-9))
        _, s, vt = np.linalg.svd(share - share.mean(axis=1, keepdims=True), full_matrices=False)
        points = (vt[: how.width].T * s[: how.width]) / (s[0] + 1e-9)
        self.embedding = (points / (np.linalg.norm(points, axis=1, keepdims=True) + 1e-6)).astype(np.float32)
        self.classof = _clusters(points, unigram, how.classes)
        in_class = np.zeros((k, how.classes), np.float32)
        in_class[np.arange(k), self.classof] = 1
        by_class = after @ in_class
        by_class = np.maximum(by_class, 1e-30)
        self.class_after = np.log(by_class).astype(np.float32)
        self.member_after = (np.log(after) - np.log(by_class)[:, self.classof]).astype(np.float32)
        return self


def _clusters(points: np.ndarray, weight: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    centre = points[np.argsort(-weight, kind="stable")[:n]].copy()
    for _ in range(rounds):
        at = ((points**2).sum(1)[:, None] - 2 * points @ centre.T + (centre**2).sum(1)[None]).argmin(axis=1)
        for c in range(len(centre)):
            if (m := at == c).any():
                centre[c] = np.average(points[m], axis=0, weights=weight[m])
    return at.astype(np.int64)


def _fine(total: np.ndarray) -> bool:
    """Sums of exponentials that float32 holds well, so that no maximum has to be taken away first."""
    return not total.size or bool(total.min() > 1e-20 and total.max() < 1e20)


class Model:
    """log P(class | context) = softmax(class_after[previous symbol] + attention(previous symbols)): one head over the
    window with a bias per distance. P(symbol | class) comes from the symbol before, P(id | symbol 0) from its count."""

    def __init__(self, tables: Tables, flat: np.ndarray | None = None):
        self.t, h = tables, tables.how
        d, rng = h.width, np.random.default_rng(7)
        self.shapes = {"e": (h.symbols, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, h.classes), "b": (h.window,)}
        self.p = {
            "e": tables.embedding.copy(),
            **{n: (rng.normal(size=(d, d)) / np.sqrt(d)).astype(np.float32) for n in "qkv"},
            "o": np.zeros((d, h.classes), np.float32),
            "b": np.zeros(h.window, np.float32),
        }
        if flat is not None:
            at = 0
            for n, s in self.shapes.items():
                size = int(np.prod(s))
                self.p[n] = flat[at : at + size].reshape(s).astype(np.float32)
                at += size
        i, j = np.arange(h.stride)[:, None] + h.window - h.stride, np.arange(h.window)[None]
        self.tables = None
        self.distance, self.causal = np.clip(i - j, 0, h.window - 1), j <= i
        self.cells = np.arange(h.symbols * d + d).reshape(-1, d)  # of a symbol's embedding, in one row of all; masked: beyond

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.shapes])

    def _attend(self, q: np.ndarray, x: np.ndarray, bias: np.ndarray, valid: np.ndarray):
        """Exponentials of the scores of all windows, one over their sums, and the means of x by them. x: embeddings and a
        column of ones, which adds the exponentials up; a row of zeros is masked."""
        for safe in (False, True):
            s = q @ x[:, :, :-1].transpose(0, 2, 1)
            s += bias
            if safe:
                s += np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
                s -= s.max(axis=2, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(s, out=s)
                o = (s @ x).reshape(-1, x.shape[2])
            if safe or _fine(o[:, -1]):
                break
        part = 1 / o[:, -1]
        return s, part, o[:, :-1] * part[:, None]

    def _classes(self, o: np.ndarray, to: np.ndarray, last: np.ndarray, at: np.ndarray | None = None):
        """Unnormalised log-probabilities of classes (places x classes; only those at these indices, if there are any), the
        exponentials of them and their sums."""
        for safe in (False, True):
            z = o @ to
            z += self.t.class_after.take(last.ravel(), axis=0)
            if safe:
                z -= z.max(axis=1, keepdims=True)
            some = z.copy() if at is None else z.take(at)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
                total = z @ np.ones(z.shape[1], z.dtype)
            if safe or _fine(total):
                break
        return some, z, total

    def _products(self):
        """What scores and logits are linear in: embeddings with a column of ones, and a row of zeros for masked places;
        queries times keys; values times outputs; biases by distance."""
        p, h = self.p, self.t.how
        x = np.zeros((h.symbols + 1, h.width + 1), p["e"].dtype)
        x[:-1, :-1], x[:-1, -1] = p["e"], 1
        return x, (p["q"] * np.float32(1 / np.sqrt(h.width))) @ p["k"].T, p["v"] @ p["o"], np.where(self.causal, p["b"][self.distance], p["b"].dtype.type(-1e9))

    def _layers(self, context: np.ndarray, valid: np.ndarray, at: np.ndarray | None = None):
        """What _classes() has after each of the last stride places of all windows, and what the layers hold."""
        h, n, tail = self.t.how, len(context), self.t.how.window - self.t.how.stride
        x, qk, vo, bias = self._products()
        places = np.where(valid, context, h.symbols)
        x = x.take(places.ravel(), axis=0).reshape(n, h.window, -1)
        last = x[:, tail:, :-1].reshape(-1, h.width)
        q = (last @ qk).reshape(n, h.stride, h.width)
        s, part, o = self._attend(q, x, bias, valid)
        return *self._classes(o, vo, context[:, tail:], at), (places, x, last, q, qk, vo, s, part, o)

    def forward(self, context: np.ndarray, valid: np.ndarray):
        """Class log-probabilities after each of the last stride places of context (windows x window); valid: real places.

        Masked are places to the right and those before a text's start."""
        z, _, total, held = self._layers(context, valid)
        return (z - np.log(total)[:, None]).reshape(len(context), self.t.how.stride, -1), held

    def gradient(self, context: np.ndarray, valid: np.ndarray, target: np.ndarray, real: np.ndarray):
        """Mean loss over real targets (classes) and its gradient by parameter."""
        h, p, n, d = self.t.how, self.p, len(context), self.t.how.width
        at, real = np.arange(0, target.size * h.classes, h.classes) + target.ravel(), real.ravel()
        z, dz, total, (places, x, last, q, qk, vo, s, part, o) = self._layers(context, valid, at)
        share = real.astype(dz.dtype) / dz.dtype.type(max(1, int(real.sum())))
        loss = (np.log(total) - z) @ share
        dz *= (share / total)[:, None]
        dz.reshape(-1)[at] -= share
        dvo, scale = (dz.T @ o).T, np.float32(1 / np.sqrt(d))
        g = {"o": p["v"].T @ dvo, "v": dvo @ p["o"].T}
        # Of the means, over the sums of exponentials; in the last column what normalising takes away.
        do = np.empty((len(dz), d + 1), dz.dtype)
        np.multiply(dz @ vo.T, part[:, None], out=do[:, :-1])
        np.negative((do[:, :-1] * o) @ np.ones(d, o.dtype), out=do[:, -1])
        do = do.reshape(n, h.stride, d + 1)
        # An embedding's gradient as a key and as a value in one product.
        both, by = np.empty((n, 2 * h.stride, h.window), dz.dtype), np.empty((n, 2 * h.stride, d), dz.dtype)
        ds = np.matmul(do, x.transpose(0, 2, 1), out=both[:, : h.stride])
        ds *= s
        both[:, h.stride :], by[:, : h.stride], by[:, h.stride :] = s, q, do[:, :, :-1]
        dx = both.transpose(0, 2, 1) @ by
        g["b"] = np.bincount(self.distance.ravel(), ds.sum(axis=0).ravel(), h.window).astype(np.float32)  # 0 where masked
        dq = (ds @ x[:, :, :-1]).reshape(-1, d)
        dqk = last.T @ dq
        g["q"], g["k"] = dqk @ p["k"] * scale, dqk.T @ p["q"] * scale
        dx[:, h.window - h.stride :] += (dq @ qk.T).reshape(n, h.stride, d)
        g["e"] = np.zeros(self.cells.shape, dx.dtype)
        np.add.at(g["e"].reshape(-1), self.cells.take(places.ravel(), axis=0).ravel(), dx.ravel())
        g["e"] = g["e"][:-1]
        return loss, g

    def windows(self, symbols: np.ndarray, offsets: np.ndarray, every: int = 1, shift: np.ndarray | None = None):
        """(context, valid, where, real) of texts side by side: place t of a window stands before id where[:, t].

        Text i's ids are offsets[i]:offsets[i + 1]; the boundary comes before its first. Each id is scored once, as one
        of the last stride places of one window. every, shift: only each so many-th window of a text, from its shift on
        (modulo its windows, so that every text has one)."""
        h = self.t.how
        size = np.diff(offsets)
        n = -(-size // h.stride)
        row = np.repeat(np.arange(len(size)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if shift is not None:
            some = number % every == (shift % np.maximum(np.minimum(n, every), 1))[row]
            row, number = row[some], number[some]
        begin = number * h.stride
        place = begin.astype(np.int32)[:, None] + np.arange(h.stride - h.window, h.stride, dtype=np.int32)[None]  # of the id that follows, in its text
        valid = (place >= 0) & (place < size[row].astype(np.int32)[:, None])
        where = offsets[:-1][row].astype(np.int32)[:, None] + np.where(valid, place, np.int32(0))
        context = np.where(valid & (place > 0), symbols[np.maximum(where - 1, 0)], self.t.symbol[BOUNDARY])
        tail = slice(h.window - h.stride, None)
        return context, valid, where[:, tail], valid[:, tail]

    def target_logs(self, context: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
        """What forward() says of the target classes, by tables of each symbol's query, key and value."""
        h, tail = self.t.how, self.t.how.window - self.t.how.stride
        if self.tables is None:
            x, qk, vo, bias = self._products()
            self.tables = x[:, :-1] @ qk, x, vo, bias
        q, x, vo, bias = self.tables
        last = context[:, tail:]
        _, _, o = self._attend(q.take(last, axis=0), x.take(np.where(valid, context, h.symbols), axis=0), bias, valid)
        z, _, total = self._classes(o, vo, last, np.arange(0, target.size * h.classes, h.classes) + target.ravel())
        return (z - np.log(total)).reshape(last.shape)

    def log10(self, ids: np.ndarray, offsets: np.ndarray, at_once: int = 64) -> np.ndarray:
        """log10 of each text's probability, its end among its ids."""
        t = self.t
        symbols = t.symbol[ids]
        previous = np.concatenate([symbols[:1] * 0, symbols[:-1]])
        previous[offsets[:-1][np.diff(offsets) > 0]] = t.symbol[BOUNDARY]
        each = t.member_after[previous, symbols].astype(np.float64)
        unnamed = symbols == 0
        each[unnamed] += t.rest[ids[unnamed]]
        context, valid, where, real = self.windows(symbols, offsets)
        target, got = t.classof[symbols[where]], np.empty(where.shape, np.float32)
        for at in range(0, len(context), at_once):
            part = slice(at, at + at_once)
            got[part] = self.target_logs(context[part], valid[part], target[part])
        each[where[real]] += got[real]
        sums = np.add.reduceat(np.append(each, 0.0), offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
        return np.where(np.diff(offsets) > 0, sums, 0.0) / np.log(10)

    def train(self, batches, rate: float) -> int:
        """Adam over (context, valid, target, real) batches; the number of windows seen."""
        p = self.flat()
        at = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes.values())])
        self.p = {n: p[a:b].reshape(s) for (n, s), a, b in zip(self.shapes.items(), at[:-1], at[1:], strict=True)}
        m, v = np.zeros_like(p), np.zeros_like(p)
        seen, self.tables = 0, None
        for i, b in enumerate(batches, 1):
            _, g = self.gradient(*b)
            seen += len(b[0])
            g = np.concatenate([g[n].ravel() for n in self.shapes])
            m *= 0.9  # ten times the mean, and v a hundred times
            m += g
            g *= g
            v *= 0.99
            v += g
            step = np.multiply(v, 0.01 / (1 - 0.99**i), out=g)
            np.sqrt(step, out=step)
            step += 1e-8
            np.divide(m, step, out=step)
            step *= 0.1 * rate / (1 - 0.9**i)
            p -= step
        return seen


# ---- over Spark ----------------------------------------------------------------------------------------------------


def _packed(ids: np.ndarray, off: np.ndarray) -> pa.BinaryArray:
    """Lists of ids as bytes, two for an id: they are read again and again, and so move as they are."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((2 * off).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])


def _lists(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", "<u2")[off[0] // 2 : off[-1] // 2], (off - off[0]) // 2


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of (at, n) rows as a vector of a fixed size; the rows are added up before and after a shuffle."""
    got = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(got.column(0).to_numpy(), got.column(1).to_numpy(), size)


def _vector_counts(column: str, rows: DataFrame, count, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in small(batches, 0, 8 * IDS):
            total += count(*_lists(b.column(0)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used].astype(np.float64))], names=["at", "n"])

    return _summed(rows.select(column).mapInArrow(tidy(run), "at bigint, n double"), size)


def train(rows: DataFrame, how: Settings = Settings()) -> Model:  # noqa: B008
    """The model from rows (ids, rid): counts of ids and of neighbours over all of them, then rounds in which every task
    takes gradient steps on windows of all its rows, all windows in all rounds, and what they arrive at is averaged by windows
    seen. What the driver gets is bounded by Settings. No rows: a model of uniform ids."""
    sc, k = rows.sparkSession.sparkContext, how.symbols
    unigrams = _vector_counts("ids", rows, lambda ids, off: np.bincount(ids, minlength=VOCABULARY), VOCABULARY)
    tables = Tables(unigrams, how)
    symbol, edge = sc.broadcast(tables.symbol), int(tables.symbol[BOUNDARY])

    def neighbours(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        s = symbol.value[ids]
        before = np.concatenate([s[:1] * 0, s[:-1]])
        before[off[:-1][np.diff(off) > 0]] = edge
        return np.bincount(before * k + s, minlength=k * k)

    tables.fit(_vector_counts("ids", rows, neighbours, k * k).reshape(k, k))
    model = Model(tables)
    for r in range(how.rounds):
        flat = _round(rows, model, how, r)
        if flat is None:
            break
        model = Model(tables, flat)
    return model


def _round(rows: DataFrame, model: Model, how: Settings, r: int) -> np.ndarray | None:
    sent = rows.sparkSession.sparkContext.broadcast((model.t, model.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, flat = sent.value
        m = Model(t, flat)

        def steps():
            for b in small(batches, 0, 2 * IDS):
                ids, off = _lists(b.column(0))
                # Where a row begins, mixed, and the next place in each round.
                shift = (b.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) + r
                symbols = t.symbol[ids]
                context, valid, where, real = m.windows(symbols, off, how.rounds, shift)
                target = t.classof[symbols[where]]
                mixed = np.random.default_rng(r).permutation(len(context))
                for a in range(0, len(context), how.batch):
                    s = mixed[a : a + how.batch]
                    yield context[s], valid[s], target[s], real[s]

        seen = m.train(steps(), how.rate / (1 + r))
        if seen:
            f = m.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(f) + 1), pa.int64()), pa.array(np.append(f, float(seen)))], names=["at", "n"])

    size = len(model.flat()) + 1
    total = _summed(rows.select("ids", "rid").mapInArrow(tidy(run), "at bigint, n double"), size)
    return (total[:-1] / total[-1]).astype(np.float32) if total[-1] else None


_SEPARATOR = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of texts one after the other (A-Z in lower case), and how many each has. Null: none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    edge, inside = np.zeros(len(raw) + 1, bool), ~_SEPARATOR[raw]
    edge[off - off[0]] = True  # where texts meet
    begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    return words, np.diff(np.searchsorted(begin, off - off[0]))


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """crc32(doc_id as text) mod folds is fold; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


END = b" "  # the end token: no word has a space


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs, the end token (a space) of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 0, 4 * TEXT_BYTES):
            words, _ = words_of(b.column(0))
            c = pc.value_counts(words)
            w, n = c.field(0), c.field(1)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([w, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([b.num_rows], pa.int64())])], names=["word", "n"])

    return docs.select("text").mapInArrow(tidy(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, out_of_training: Column, keep: list[str], how: Settings = Settings(), tokenizer: str | None = None) -> DataFrame:  # noqa: B008
    """keep, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Base: words by their counts in training rows. Counts of the most frequent words go to all tasks (a bounded table);
    a text's other words meet theirs in a join, spread by word. score: the attention model over subword ids, whose last is the end. A null or empty text has
    only its end. Nothing to learn from: every count is zero, ids are uniform. Repeated rows come out each.
    """
    spark = docs.sparkSession
    docs = docs.select(*keep, F.col("text").alias("text"), out_of_training.alias("held_out"))
    counts = Written(word_counts(docs.where("NOT held_out")), "word-counts").df
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(how.head).toArrow()
    under = total + 0.5 * (kinds + 1)
    head = spark.sparkContext.broadcast((top.column(0).combine_chunks(), top.column(1).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestream.llm.tokens import byte_encoder

        e, (head_words, head_n) = byte_encoder(tokenizer), head.value
        logs = np.append(np.log10((head_n + 0.5) / under), 0.0)
        end = pc.index_in(pa.array([END], pa.binary()), head_words)[0].as_py()
        for b in small(batches, len(keep), TEXT_BYTES):
            texts = b.column(len(keep))
            ids, off = e.encode(texts, BOUNDARY)
            words, n = words_of(texts)
            row = np.repeat(np.arange(len(n)), n)
            at = pc.fill_null(pc.index_in(words, head_words), -1).to_numpy(zero_copy_only=False) if len(head_words) else np.full(len(words), -1)
            known = np.bincount(row[at >= 0], minlength=len(n)) + (end is not None)
            base = np.bincount(row, logs[at], len(n)) + (logs[end] if end is not None else np.log10(0.5 / under))
            coded = pc.dictionary_encode(pc.filter(words, pa.array(at < 0)))
            kinds_here = max(1, len(coded.dictionary))
            pairs, times = np.unique(row[at < 0] * kinds_here + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            rare = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * kinds_here), pa.int32()),
                pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % kinds_here)), pa.array(times, pa.int64())], names=["w", "k"]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns[: len(keep)],
                    b.column(len(keep) + 1),
                    pa.array(n + 1),
                    pa.array(known, pa.int64()),
                    pa.array(base),
                    rare,
                    _packed(ids, off),
                ],
                names=[*keep, "held_out", "n_tokens", "known", "base", "rare", "ids"],
            )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.mapInArrow(tidy(run), f"{kept}, held_out boolean, n_tokens bigint, known bigint, base double, rare array<struct<w:binary,k:bigint>>, ids binary")
    rows = Written(rows.withColumn("rid", F.monotonically_increasing_id()), "scored-words").df

    rare = rows.select("rid", F.explode("rare").alias("x")).select("rid", F.col("x.w").alias("word"), "x.k")
    met = rare.join(counts, "word", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(under)))).alias("base_rare"),
    )
    model = train(rows.where("NOT held_out").select("ids", "rid"), how)
    sent = spark.sparkContext.broadcast((model.t, model.flat()))
    columns = ["rid", *keep, "held_out", "n_tokens", "known", "base"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in small(batches, len(columns), 2 * IDS):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(m.log10(*_lists(b.column(len(columns)))))], names=[*columns, "score"])

    scored = rows.select(*columns, "ids").mapInArrow(tidy(apply), f"rid bigint, {kept}, held_out boolean, n_tokens bigint, known bigint, base double, score double")
    out = scored.join(met, "rid", "left")
    return out.select(
        *keep,
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out(), ["doc_id"])
