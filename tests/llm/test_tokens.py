"""Token files, packing and the encoders against the tokenizers themselves."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm.odd import none_of, odd_docs

from lodestream.llm import packing, tokenfile, tokens

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_BPE))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = ["", None, " ", "Hello, World!", "don't stop...now", "a\nb\r\nc\td", "é é İstanbul ß", "日本語 テキスト", "x" * 3000, "12345 67", "<|startoftext|> a <|endoftext|>", "!!!a!!! ,.b", "a b c", "\U0001f600 \x00 \x01a", "fi ﬁ İ"] + ["#tag $9 50%", "it's we're I'll", "end. Next"]


def test_encoder(plain):
    e = tokens.Encoder()
    ids, off = e.encode(pa.array(TEXTS), 7)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*plain(t), 7] for t in TEXTS]
    assert e.encode(pa.array([], pa.string()))[1].tolist() == [0]


ODD = ["a", "B", "é", "É", "×", "÷", "'s", "'", "'ll", "12", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "\u3000", "...", "***", "<|endoftext|>", "<|", "|>", "<", "|", "\u0301", "ß", "ẞ", "İ", "Σ", "ΑΣ", "日本", "😀", "\x00", "\x1c", "\x7f", "½", "ª", "µ", "À", "Þ", "ÿ", "ﬁ", "-_", "<|ENDOFTEXT|>", "the", "\ufeff"]


@pytest.mark.parametrize("block", [1 << 22, 7, 64])
def test_encoder_of_odd_texts(plain, monkeypatch, block):
    monkeypatch.setattr(tokens, "_PIECE", block)
    e, rng = tokens.Encoder(), np.random.default_rng(block)
    for _ in range(100):
        texts = ["".join(rng.choice(ODD, rng.integers(0, 30))) for _ in range(rng.integers(0, 9))]
        ids, off = e.encode(pa.array(texts, pa.string()), 7)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*plain(t), 7] for t in texts]


def test_encoder_of_the_tables(plain):
    for sf in ("sf0.001", "sf0.01"):
        texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).combine_chunks()
        ids, off = tokens.Encoder().encode(texts)
        for i, t in enumerate(texts.to_pylist()):
            assert ids[off[i] : off[i + 1]].tolist() == plain(t)


def test_encoder_forgets(plain, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.Encoder()
    for t in ("one two three four five", "six one two", "one seven", "eight's one, two", "nine one ten", "one two nine"):
        assert e.encode(pa.array([t]))[0].tolist() == plain(t)
    assert b"one" in e.known and len(e.known) == e.n < 9


def test_byte_encoder_cuts_where_pieces_end(monkeypatch):
    monkeypatch.setattr(tokens, "_PART", 50)
    e = tokens.ByteEncoder()
    text = "ab cd  efg\n\n hé  x 12 !! don't　ö " * 40
    ids, off = e.encode(pa.array([None, text, ""]), 50256)
    assert ids[off[1] : off[2]].tolist() == [*e.encoding.encode_ordinary(text), 50256]
    assert off.tolist() == [0, 1, len(ids) - 1, len(ids)]


def test_token_files(spark, plain):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = {r.doc_id: r for r in tokenfile.op2_token_files(spark, SF).collect()}
    assert len(rows) == len(docs)
    start = 0
    for i, t in docs:
        ids = [*plain(t), 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_of_odd_rows(spark, plain, tmp_path):
    docs = odd_docs(spark)
    tokenfile.write_tokens(docs, f"{tmp_path}/t")
    got = tokenfile.token_digests(spark, f"{tmp_path}/t").collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((r.doc_id, crc([*plain(r.text), 2])) for r in docs.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    tokenfile.write_tokens(none_of(docs), f"{tmp_path}/e")
    assert tokenfile.token_digests(spark, f"{tmp_path}/e").count() == 0


def test_token_files_are_laid_out(spark, tmp_path):
    tokenfile.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/t")
    f = next(tmp_path.glob("t/*.parquet"))
    row = pq.ParquetFile(f).metadata.row_group(0)
    by = {row.column(i).path_in_schema.split(".")[0]: row.column(i) for i in range(row.num_columns)}
    assert any("DICTIONARY" in e for e in by["ids"].encodings)
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    assert by["doc_id"].has_offset_index and by["doc_id"].has_column_index
    plan = tokenfile.read_tokens(spark, f"{tmp_path}/t").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


# ---- packing


def check_packing(rows, docs, plain):
    pieces = collections.Counter()
    for i, t in docs:
        ids = [*plain(t), 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            pieces[i, n, at, len(part), crc(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    return len(by)


def test_packing(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = packing.op7_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, docs, plain)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_odd_rows(spark, plain):
    docs = odd_docs(spark)
    check_packing(packing.pack(packing.pieces(docs)).collect(), [(r.doc_id, r.text) for r in docs.collect()], plain)
    assert packing.pack(packing.pieces(none_of(docs))).count() == 0


def test_packing_in_levels(spark):
    """More blocks than one: every item has one place, and few sequences more than needed."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1500, 3000)
    items = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(sizes)], "item bigint, length bigint")
    rows = packing.pack(items, how=packing.Evolution(block=256)).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.item for r in rows) == list(range(3000))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.02 * sizes.sum() / 2048 + 1


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 900, 200)]
    a, b = (packing.packed(sizes, rng.permutation(200).tolist(), 2048) for _ in range(2))
    child = packing.crossover(a, b, sizes, rng)
    assert sorted(i for m in child.members for i in m) == list(range(200))
    assert all(sum(sizes[i] for i in m) == f <= 2048 for m, f in zip(child.members, child.fill, strict=True))


@pytest.mark.parametrize(("least", "most", "saved"), [(500, 1200, 0.6), (300, 1100, 0.4), (100, 700, 0.3)])
def test_evolution_beats_best_fit(least, most, saved):
    """Where best fit is above the bound, evolution takes away that share of what it wastes at least."""
    rng, how = np.random.default_rng(5), packing.Evolution()
    sizes = [int(x) for x in rng.integers(least, most, 2048)]
    bound = -(-sum(sizes) // 2048)
    best_fit = len(packing.packed(sizes, sorted(range(2048), key=lambda i: -sizes[i]), 2048).fill)
    first = [packing.evolve(sizes, [], [1, i, 0, 0], how, 2048) for i in range(how.islands)]
    best = packing.evolve(sizes, [e for x in first for e in x], [1, 0, 1, 0], how, 2048)[0]
    fill = np.bincount(best, sizes)
    assert fill.max() <= 2048 and fill.sum() == sum(sizes)
    assert best_fit - len(fill) >= saved * (best_fit - bound)


def test_trade_keeps_every_item():
    sizes = [int(x) for x in np.random.default_rng(4).integers(1, 900, 60)]
    bins = [[3 * i, 3 * i + 1] for i in range(20)]
    bins = [m for m in bins if sum(sizes[i] for i in m) <= 2048]
    free = sorted(set(range(60)) - {i for m in bins for i in m})
    before = sum(sizes[i] for i in free)
    after = packing.trade(bins, free, sizes, 2048)
    assert sorted([*after, *(i for m in bins for i in m)]) == list(range(60))
    assert all(sum(sizes[i] for i in m) <= 2048 for m in bins) and sum(sizes[i] for i in after) < before
