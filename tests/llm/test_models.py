"""The language model and language identification."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from llm.odd import none_of, odd_docs
from pyspark.sql import functions as F

from lodestream.llm import langid, lm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    tokens = {i: [*WORD.findall(lowered(t)), " "] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(count.values())
    under = n + 0.5 * (len(count) + 1)
    return {i: (held[i], len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / under) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("head", [1 << 17, 50])
def test_base_scores(spark, head):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = base_scores([(r.doc_id, r.text) for r in df.collect()])
    got = lm.score(df, lm.held_out(), ["doc_id"], lm.Settings(head=head, rounds=0)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_model_beats_counts_of_ids_on_held_out_texts(spark):
    import pyarrow as pa

    from lodestream.llm.tokens import byte_encoder

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = lm.op4_lm_scoring(spark, SF).collect()
    ids = lambda held: byte_encoder().encode(pa.array([text[r.doc_id] for r in rows if r.held_out == held]), lm.BOUNDARY)[0]
    count = np.bincount(ids(False), minlength=lm.VOCABULARY) + 0.5
    assert sum(r.score for r in rows if r.held_out) > 0.9 * np.log10(count / count.sum())[ids(True)].sum()


def test_attention_beats_the_same_model_without_it(spark):
    """On held-out texts; without rounds of training the attention adds nothing to what the symbol before says."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = lambda **how: lm.score(docs, lm.held_out(), ["doc_id"], lm.Settings(**how)).where("held_out").agg(F.sum("score")).first()[0]
    assert total() > 0.96 * total(rounds=0)


def test_every_row_has_windows_in_training():
    m = _model()
    sizes = np.array([1, 3, 40, 0, 200, 7])
    off = np.concatenate([[0], np.cumsum(sizes)])
    all_ = m.windows(np.arange(off[-1]) % 32, off)[2]
    for shift in range(12):
        where = m.windows(np.arange(off[-1]) % 32, off, 6, np.full(len(sizes), shift))[2]
        rows = np.searchsorted(off, where[:, 0], "right") - 1
        n = -(-sizes // 4)
        assert all((n[i] // 6 if n[i] >= 6 else min(n[i], 1)) <= (rows == i).sum() <= -(-n[i] // 6) for i in range(len(sizes)) if sizes[i])
        assert {tuple(w) for w in where} <= {tuple(w) for w in all_}


def test_every_window_goes_through_gradient_steps(spark):
    """In one row of different ids, each id is in one or two windows: what is learned of it moves if they are trained on."""
    ids = np.append(np.arange(200), lm.BOUNDARY).astype(np.int64)
    how = lm.Settings(symbols=256, classes=8, width=4, window=8, stride=4, batch=1)
    rows = spark.createDataFrame([(bytes(ids.astype("<u2").tobytes()), i) for i in (0, 1)], "ids binary, rid bigint").repartition(1)
    m = lm.train(rows, how)
    moved = np.abs(m.p["e"] - m.t.embedding).max(axis=1) > 0
    assert moved[m.t.symbol[ids[:-1]]].all()


def test_every_window_is_dealt_once():
    m = _model()
    sizes = np.array([1, 3, 40, 0, 201, 7])
    off = np.concatenate([[0], np.cumsum(sizes)])
    for rounds in (1, 2, 3):
        dealt = [m.windows(np.arange(off[-1]) % 32, off, rounds, np.arange(len(sizes)) * 5 + r) for r in range(rounds)]
        times = collections.Counter(i for _, _, where, real in dealt for i in where[real].tolist())
        assert set(times) == set(range(off[-1]))
        assert all(times[i] == 1 for k, n in enumerate(sizes) if n > 4 * (rounds - 1) for i in range(off[k], off[k + 1]))


def _model(how=lm.Settings(symbols=32, classes=8, width=4, window=8, stride=4)):  # noqa: B008
    rng = np.random.default_rng(0)
    t = lm.Tables(np.bincount(rng.integers(0, 60, 4000), minlength=lm.VOCABULARY), how)
    m = lm.Model(t.fit(rng.integers(0, 9, (how.symbols, how.symbols)).astype(float)))
    for n in m.p:
        m.p[n] = m.p[n] + rng.normal(size=m.p[n].shape).astype(np.float32) * 0.3
    return m


def test_windows_score_each_token_once():
    m = _model()
    for sizes in ([1], [4], [5, 0, 9], [17, 3], [0]):
        off = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.arange(off[-1]) % 32
        _, _, where, real = m.windows(symbols, off)
        assert sorted(where[real].tolist()) == list(range(off[-1]))


def test_attention_sees_only_what_is_before():
    """What comes after a place changes nothing at it, and tables give what the layers give."""
    m, rng = _model(), np.random.default_rng(1)
    ids = rng.integers(0, 60, 40).astype(np.int32)
    off = np.array([0, 40])
    part = [m.log10(ids[:n], np.array([0, n]))[0] for n in range(1, 41)]
    changed = ids.copy()
    changed[30:] = rng.integers(0, 60, 10)
    assert np.allclose([m.log10(changed[:n], np.array([0, n]))[0] for n in range(1, 31)], part[:30], atol=1e-4)
    symbols = m.t.symbol[ids]
    context, valid, where, real = m.windows(symbols, off)
    target = m.t.classof[symbols[where]]
    z, _ = m.forward(context, valid)
    assert np.allclose(np.take_along_axis(z, target[:, :, None], 2)[:, :, 0][real], m.target_logs(context, valid, target)[real], atol=1e-3)


def test_probabilities_add_up():
    m = _model()
    total = 0.0
    for a in range(0, lm.VOCABULARY, 4096):
        ids = np.arange(a, min(a + 4096, lm.VOCABULARY), dtype=np.int32)
        total += (10.0 ** m.log10(ids, np.arange(len(ids) + 1))).sum()
    assert total == pytest.approx(1.0, abs=2e-3)


def test_gradient():
    m, rng = _model(), np.random.default_rng(2)
    m.p = {n: v.astype(np.float64) for n, v in m.p.items()}
    ids = rng.integers(0, 60, 30)
    symbols = m.t.symbol[ids]
    context, valid, where, real = m.windows(symbols, np.array([0, 30]))
    target = m.t.classof[symbols[where]]
    _, g = m.gradient(context, valid, target, real)
    for n in m.p:
        at = tuple(rng.integers(0, s) for s in m.p[n].shape) if n != "b" else (1,)
        if n == "e":
            at = (int(context[0, -1]), 1)
        e = 1e-4
        m.p[n][at] += e
        up = m.gradient(context, valid, target, real)[0]
        m.p[n][at] -= 2 * e
        down = m.gradient(context, valid, target, real)[0]
        m.p[n][at] += e
        assert g[n][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_large_scores():
    """Where float32's exp needs it, maxima are taken away: numbers stay finite and are those of wider floats."""
    m = _model()
    m.p["e"] = m.p["e"] * np.float32(40)
    symbols = np.random.default_rng(3).integers(0, 32, 41)
    context, valid, where, real = m.windows(symbols, np.array([0, 3, 41]))
    target = m.t.classof[symbols[where]]
    loss, g = m.gradient(context, valid, target, real)
    logs = m.target_logs(context, valid, target)[real]
    assert np.isfinite(logs).all() and all(np.isfinite(x).all() for x in g.values())
    m.p = {n: v.astype(np.float64) for n, v in m.p.items()}
    z, _ = m.forward(context, valid)
    assert np.allclose(np.take_along_axis(z, target[:, :, None], 2)[:, :, 0][real], logs, atol=2e-2)
    assert loss == pytest.approx(m.gradient(context, valid, target, real)[0], rel=1e-3)


def _whole_pattern():
    import base64

    import public_tokenizers
    import tiktoken

    from lodestream.llm.tokens import BYTE_BPE

    with open(public_tokenizers.path(BYTE_BPE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_ids_are_those_of_the_whole_pattern():
    import pyarrow as pa

    from lodestream.llm.tokens import ByteEncoder

    rng, whole, mine = np.random.default_rng(5), _whole_pattern(), ByteEncoder()
    some = ["a", "Bc", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\u4e2d", "\xe9", "12", "!", "<|"]
    texts = ["".join(rng.choice(some, rng.integers(0, 25))) for _ in range(3000)] + [None, "", " ", "\n\n", "a  ", "  a", "a \n b"]
    ids, off = mine.encode(pa.array(texts), 7)
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*whole.encode_ordinary(x or ""), 7]


def test_byte_ids_take_less_time_than_one_search_for_special_tokens_and_a_lookahead(spark):
    import time

    import pyarrow as pa

    from lodestream.llm.tokens import ByteEncoder

    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    array, whole, mine = pa.array(texts), _whole_pattern(), ByteEncoder()

    def seconds(f):
        t = time.process_time()
        f()
        return time.process_time() - t

    took = [(seconds(lambda: mine.encode(array)), seconds(lambda: [whole.encode_to_numpy(x, disallowed_special=()) for x in texts])) for _ in range(7)]
    assert min(a for a, _ in took) < 0.85 * min(b for _, b in took)


def test_scores_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = lm.score(docs, F.col("doc_id") == 5, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert all(math.isfinite(r.score) for r in got)
    assert lm.score(none_of(docs), F.lit(False), ["doc_id"]).count() == 0
    untrained = lm.score(docs, F.lit(True), ["doc_id"]).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}


# ---- languages


def test_languages_of_held_out_texts(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = langid.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held if lang[r.doc_id]]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_languages(spark):
    docs = odd_docs(spark, [(20 + i, t) for i, t in enumerate(["12 34 !?", "a", "\U0001f600", "éé" * 700_000])])
    rows = langid.predict(docs, langid.train(docs), ["doc_id"]).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count()
    assert {by[i].lang_pred for i in (2, 3, 4, 20, 22)} == {"und"}
    assert by[21].lang_pred == "en"
    nothing = langid.train(none_of(docs))
    assert {r.lang_pred for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(none_of(docs), nothing, ["doc_id"]).count() == 0


def test_chunks_change_nothing(monkeypatch):
    text = "Hello, wörld of  many-words 12 " * 50
    count = lambda: collections.Counter(x for g in langid._grams(text, langid.Settings()) for x in g[0].tolist())
    whole = count()
    for n in (3, 7, 64):
        monkeypatch.setattr(langid, "_CHUNK", n)
        assert count() == whole


def test_bloom_filters_name_all_languages():
    how = langid.Settings(bits=12)
    masks = np.zeros((1, 2, 1 << 12), np.uint64)
    for bit, words in ((1, "der die das und"), (2, "the and of das")):
        for g in langid._grams(words, how):
            for k in range(2):
                masks[0, k][g[k]] |= np.uint64(bit)
    f = langid.Filters(["de", "en"], masks, how)
    assert f.predict("der die")[0] == "de" and f.predict("the of")[0] == "en"
    for g in langid._grams("das", how):
        assert (f.languages_of(g) == 3).all()


def test_seventy_languages(spark):
    """Each has letters of its own; a slot needs two words for them."""
    alphabet = [chr(0x4E00 + i) for i in range(70 * 6)]
    rng = np.random.default_rng(1)
    word = lambda k: "".join(rng.choice(alphabet[6 * k : 6 * k + 6], 4))
    rows = [(n * 70 + k, " ".join(word(k) for _ in range(30)), f"l{k:02}") for k in range(70) for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.train(docs.where("doc_id < 210"))
    assert len(filters.languages) == 70 and filters.masks.shape[0] == 2
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, filters, ["doc_id"]).collect()}
    assert {(got[i], lang) for i, _, lang in rows} == {(lang, lang) for _, _, lang in rows}
