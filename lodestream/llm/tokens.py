"""Token ids of whole texts by a public tokenizer, word by word with a bounded memory of words."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker remembers; beyond, the half that slices had less often is forgotten.
REMEMBERED = 600_000
#: Pieces in one call of the tokenizer.
_JOINED = 512
#: Bytes of text that are split at once.
_PIECE = 1 << 22
#: Characters of a text that a byte-level encoder takes at once, and where it may be cut.
_PART = 1 << 18
_LONE_SPACE = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: The one lookahead of the byte-level pattern, which leaves a run's last white space to the word after it, and such runs.
_AHEAD = r"\s+(?!\S)|"
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")

#: What a byte is: white space, part of a letter (ASCII, and Latin-1 by its two bytes), a digit, a sign, or anything else.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER, _WHOLE = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[39] = _OTHER  # an apostrophe may belong to the letters after it
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LATIN_LEAD, _NO_LETTER = 0xC3, (0x97, 0xB7)
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|(?!.*<\|)[!-&(-/:-@\[-`{-~]+", re.DOTALL).fullmatch


def pieces_of(raw: np.ndarray, edges: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """What the tokenizer treats one by one in UTF-8 bytes, and where each begins. edges: where texts begin.

    A word (between white space) of letters, digits and signs is its runs of letters and of signs, in lower case, and its
    single digits. A word with anything else, or with what may be a special token, is one piece as it is.
    """
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == _LATIN_LEAD)
    after = raw[lead + 1]
    fine = (after != _NO_LETTER[0]) & (after != _NO_LETTER[1])
    kind[lead[fine]] = kind[lead[fine] + 1] = _LETTER
    large = lead[fine & (after < 0x9F)] + 1
    low[large] += 32
    meet = np.zeros(len(raw) + 1, bool)
    meet[edges] = True
    meet[[0, -1]] = True
    odd = np.concatenate([np.flatnonzero(kind == _OTHER), np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))])
    if len(odd):
        inside = kind != _SPACE
        begin = np.flatnonzero(inside & (meet[:-1] | np.concatenate([[True], ~inside[:-1]])))
        end = np.flatnonzero(inside & (meet[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        for w in np.unique(np.searchsorted(begin, odd, "right") - 1):
            kind[begin[w] : end[w]] = _WHOLE
            low[begin[w] : end[w]] = raw[begin[w] : end[w]]
    meet[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cuts = np.flatnonzero(meet)
    real = kind[cuts[:-1]] != _SPACE
    begin, size = cuts[:-1][real], np.diff(cuts)[real]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[kind != _SPACE])]), begin


class Encoder:
    """ids(texts) of a tokenizers file whose pieces never span white space, letters and signs, as word_bpe_49k.json's don't.

    Texts are split into pieces (see pieces_of), so each distinct piece goes through the tokenizer once; what the
    tokenizer makes of a text is what it makes of its pieces one after the other. Normalisation is by character, but for
    NFC, which composes nothing with white space before it; words with characters that could compose stay whole.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(WORD_BPE)
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0
        self.had = np.zeros(1 << 14, np.int32)  # slices that had a piece

    def _forget(self) -> None:
        """Keeps the half of all pieces that most slices had."""
        keep = np.sort(np.argpartition(-self.had[: self.n], self.n // 2)[: self.n // 2])
        number = np.full(self.n, -1, np.int64)
        number[keep] = np.arange(len(keep))
        size = np.diff(self.starts[: self.n + 1])[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[keep] - (ends - size), size)]
        self.known = {w: int(number[i]) for w, i in self.known.items() if number[i] >= 0}
        self.starts, self.used, self.n = np.concatenate([[0], ends]), int(ends[-1]), len(keep)
        self.had = self.had[keep] // 2

    def _learn(self, pieces: list[bytes]) -> None:
        """Simple pieces are joined, as each ends where an id does that ends a word. Any other goes by itself."""
        simple, other = [], []
        for w in pieces:
            (simple if _SIMPLE(w) else other).append(w)
        for at in range(0, len(simple), _JOINED):
            some = simple[at : at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                self._remember(some, ids, ends)
            else:
                other += some
        for at in range(0, len(other), _JOINED):
            some = other[at : at + _JOINED]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            self._remember(some, np.array([i for x in got for i in x], np.int32), np.cumsum([len(x) for x in got]))

    def _remember(self, pieces: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.n + len(pieces) > len(self.had):
            self.had = np.concatenate([self.had, np.zeros_like(self.had)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(pieces)] = self.used + ends
        self.had[self.n : self.n + len(pieces)] = 0
        self.known.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        self.n += len(pieces)
        self.used += len(ids)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i's ids, with end after them if there is one, are ids[offsets[i]:offsets[i + 1]]. Null: empty.

        Bytes are looked at in blocks of bounded size, cut at white space or between texts; only a word isn't cut."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(texts) else np.zeros(0, np.uint8)
        off = off - off[0]
        sizes, parts, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(raw):
            to = _cut(raw, off, at + _PIECE)
            first, last = np.searchsorted(off, [at, to])
            ids, begin, count = self._encode(raw[at:to], off[first:last] - at)
            sizes += np.bincount(np.searchsorted(off, begin + at, "right") - 1, count, len(texts)).astype(np.int64)
            parts.append(ids)
            at = to
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        if end is not None:
            ids, sizes = np.insert(ids, np.cumsum(sizes), end), sizes + 1
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a block, where its pieces begin and how many ids each has."""
        pieces, begin = pieces_of(raw, edges)
        pieces = pc.dictionary_encode(pieces)
        if self.n > REMEMBERED:
            self._forget()
        distinct = pieces.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.had[code] += 1
        code = code[pieces.indices.to_numpy(zero_copy_only=False)]
        first = self.starts[code]
        count = self.starts[code + 1] - first
        ends = np.cumsum(count)
        where = np.repeat(first - (ends - count), count)
        where += np.arange(len(where))
        return self.flat[where], begin, count


def _cut(raw: np.ndarray, off: np.ndarray, to: int) -> int:
    """The first place from `to` on that is white space or between texts."""
    if to >= len(raw):
        return len(raw)
    last = int(off[np.searchsorted(off, to)])
    for at in range(to, last, 1 << 16):
        found = np.flatnonzero(_KIND[raw[at : min(at + (1 << 16), last)]] == _SPACE)
        if len(found):
            return at + int(found[0])
    return last


def _may_have_runs(texts: pa.Array) -> np.ndarray:
    """Which texts have white space side by side, or what may be white space beyond ASCII (by its first byte)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, bool)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    found = (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
    found[1:] |= space[1:] & space[:-1]
    return np.bincount(np.searchsorted(off - off[0], np.flatnonzero(found), "right") - 1, minlength=len(texts)) > 0


def _parts(text: str) -> Iterator[str]:
    """text, cut where a run of white space begins and before its last one, if a word follows: what the lookahead does."""
    at = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        yield text[at:a]
        at = b - 1 if b < len(text) else a
        yield text[a:at]
    yield text[at:]


class ByteEncoder:
    """ids(texts) of a tiktoken file: byte-level pieces, nothing normalised. No ids stand for special tokens.

    The pattern's lookahead takes half as long again, so it is taken out, and texts with runs of white space are cut as it
    would. encode_ordinary() is used, as others look for special tokens at every byte, and there are none."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(BYTE_BPE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut = _AHEAD in public_tokenizers.PATTERN
        self.of = lambda pattern: tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = public_tokenizers.PATTERN
        self.plain = self.of(self.pattern.replace(_AHEAD, ""))

    @cached_property
    def encoding(self):
        """The tokenizer with its whole pattern, whose ids encode() gives."""
        return self.of(self.pattern)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) as Encoder.encode() has them. Long texts go in parts cut before a lone space, where pieces end
        too, so lists of Python numbers stay short."""
        tail = np.zeros(0, np.int32) if end is None else np.array([end], np.int32)
        out, sizes = [], [0]
        runs = _may_have_runs(texts) if self.cut else np.zeros(len(texts), bool)
        for x, some in zip(texts, runs.tolist(), strict=True):
            n = len(tail)
            for text in _parts(x.as_py() or "") if some else [x.as_py() or ""]:
                at = 0
                while at < len(text):
                    cut = _LONE_SPACE.search(text, at + _PART) if len(text) - at > _PART else None
                    to = cut.start() if cut else len(text)
                    ids = self.plain.encode_ordinary(text[at:to] if at or cut else text)
                    out.append(np.fromiter(ids, np.int32, len(ids)))
                    n += len(ids)
                    at = to
            out.append(tail)
            sizes.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum(np.array(sizes, np.int64))


_ENCODERS: dict[str | None, Encoder | ByteEncoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a tokenizers file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def byte_encoder(path: str | None = None) -> ByteEncoder:
    """This worker's encoder for a tiktoken file."""
    key = f"tiktoken:{path}"
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteEncoder(path)
    return _ENCODERS[key]
