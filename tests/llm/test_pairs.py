"""SimHash groups, decontamination and chats against brute force."""

import collections
import hashlib
import itertools
import json
import random
import re

import pytest
import xxhash
from llm.odd import none_of, odd_docs

from lodestream.llm import chat, decontaminate, graph, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def print_of(text, k=3):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    """{doc_id: (fingerprint, least id)} by comparing all pairs."""
    fps = {i: print_of(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", find(i)) for i in fps}


def test_simhash(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_near_dedup(spark, SF).collect()}
    assert got == groups(docs)


def linked(pairs, nodes):
    root = {n: n for n in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("most", [0, 1, 2])
@pytest.mark.parametrize("long_list", [3, 48])
def test_links(spark, most, long_list):
    """Crowded lists (near a few centres) and lone values: the same components as all pairs give."""
    rng = random.Random(most * 100 + long_list)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(3):
        c = rng.getrandbits(64)
        fps |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)) for _ in range(60)}
        fps |= {c ^ rng.getrandbits(8) << 8 for _ in range(40)}
    fps |= {0, 1, 3, 1 << 63, (1 << 64) - 1}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = [(r.u, r.v) for r in simhash.links(df, most, long_list).collect()]
    true = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most]
    assert linked(got, signed) == linked(true, signed)
    if most:
        assert true


def test_simhash_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[2] == by[3] == by[4] == {2}
    assert by[6] == by[7] == {6}
    assert simhash.near_duplicates(none_of(docs)).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "clique", "two"])
def test_components(spark, shape):
    n = 200
    e = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "clique": list(itertools.combinations(range(20), 2)), "two": [(1, 2), (2, 1), (3, 3), (5, 4), (None, 4)]}[shape]
    rng = random.Random(4)
    names = list(range(n + 1))
    rng.shuffle(names)
    e = [(None if a is None else names[a], names[b]) for a, b in e]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "u bigint, v bigint")).collect()}
    nodes = {x for a, b in e if a is not None and a != b for x in (a, b)}
    assert got == linked([(a, b) for a, b in e if a is not None and a != b], nodes)


# ---- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def hits(docs, items, window=10):
    wins = collections.defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add("null" if name is None else str(name))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in decontaminate.op10_benchmark_decontamination(spark, SF).collect())
    assert got == sorted(hits(docs, items))
    assert any(r[-1] for r in got)


def test_decontamination_by_sql(spark):
    from oracle import differences, duck

    assert differences(decontaminate.op10_benchmark_decontamination(spark, SF), duck(SF), decontaminate.OP10_SQL) == ""


@pytest.mark.parametrize("shard_words", [12, 10_000])
@pytest.mark.parametrize("window", [1, 3, 10])
def test_automaton_finds_all_windows(spark, window, shard_words):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("ab c d'e é".split()) for _ in range(n))
    items = [(f"i{k}", text(rng.randrange(0, 14))) for k in range(12)] + [("i0", "a"), (None, "d e"), ("none", None)]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(d, i, window=window, shard_words=shard_words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(hits(docs, items, window))


def test_shards_are_passes_of_their_own(spark):
    """A benchmark of a dozen blocks, one item longer than a block: the result of one block, with one worker a plan."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(30)) for k in range(45)] + [("long", text(300)), ("short", "w1 w2")]
    docs = [(k, " ".join([text(20), (items[k % 47][1] or "").lower(), text(10)]) if k % 2 else text(60)) for k in range(60)] + [(60, None), (61, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sum(1 for _ in decontaminate._shards(i, "item_id", "text", 150, 10)) >= 12
    found = decontaminate.find_hits(d.withColumn("__spans", F_lit()).withColumn("__items", F_lit()), i, shard_words=150)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = decontaminate.contamination(d, i, shard_words=150).collect()
    assert sorted(tuple(r) for r in got) == sorted(hits(docs, items))
    assert len(found.collect()) == len(docs)


def test_decontamination_of_odd_rows(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([("x", "one"), ("y", "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6"), (None, None), ("z", "")], "item_id string, text string")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {6, 7} & {r.doc_id for r in rows} == set()
    assert docs.count() - len(rows) == 2
    before = [r.text for r in docs.collect() if r.doc_id == 5][0]
    after = [r for r in rows if r.doc_id == 5][0]
    assert len(words(after.text)) < len(words(before)) and after.n_chars == len(after.text)
    assert decontaminate.decontaminate(none_of(docs), items).count() == 0
    assert decontaminate.decontaminate(docs, none_of(items)).count() == docs.count()


def test_cut_spans():
    assert decontaminate.cut_spans("Ah, bé c-d. E!", [(1, 3)]) == "Ah, -d. E!"
    assert decontaminate.cut_spans("a b", [(0, 2)]) == ""


# ---- chats


def chats(spark, rows, schemas=None):
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    return sorted(chat.format_chats(df, schemas).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))


def call(i, name="f", **args):
    return {"id": i, "function": {"name": name, "arguments": args}}


def test_links_order_and_validation(spark):
    schemas = {"f": {"type": "object", "properties": {"x": {"type": ["integer", "object"]}}, "required": ["x"], "additionalProperties": False}}
    said = lambda *c: json.dumps({"content": None, "tool_calls": list(c)})
    answer = lambda i, c="ok": json.dumps({"content": c, "tool_call_id": i})
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", answer("b")), (1, 2, "assistant", said(call("b", x={"$result": "a"}))), (1, 3, "assistant", said(call("a", x=1.0))), (1, 4, "tool", answer("a")),
        (2, 0, "assistant", said(call("a", x="no"))), (2, 1, "tool", answer("a")), (3, 0, "tool", answer("zz")), (4, 0, "assistant", said(call("q", x=1))), (5, 0, "assistant", "{bad"),
        (6, 0, "assistant", said(call("u", "nope"))), (6, 1, "tool", answer("u")), (7, 0, "assistant", said(call("c", x={"$result": "d"}))), (7, 1, "tool", answer("c")), (7, 2, "assistant", said(call("d", x={"$result": "c"}))), (7, 3, "tool", answer("d")),
        (8, 0, "assistant", said(call("w", x={"$result": "nothing"}))), (8, 1, "tool", answer("w")),
    ]
    by = collections.defaultdict(list)
    for r in chats(spark, rows, schemas):
        by[r.conv_id].append(r)
    assert [r.turn for r in by[1]] == [0, 3, 4, 2, 1]
    assert {r.wrong for r in by[1]} == {None}
    assert by[1][1].json == '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":"{\\"x\\":1}","name":"f"},"id":"a","type":"function"}]}'
    assert [by[i][0].wrong for i in (2, 3, 4, 5, 6, 8)] == ["bad arguments", "result without call", "call without result", "bad JSON", "unknown tool", "missing result"]
    assert {r.wrong for r in by[7]} == {"cycle"}
    assert [r.position for i in by for r in by[i]] == [p for i in by for p in range(len(by[i]))]


def test_odd_chats(spark):
    rows = [(None, None, None, None), (1, None, "user", None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "assistant", "[1]"), (1, 1, "tool", '{"tool_call_id": null}'), (1, 2, "assistant", '{"tool_calls": [1]}'), (2, 0, "assistant", '{"a": NaN}'), (2, 1, "user", "{x}")]
    got = chats(spark, rows)
    assert len(got) == len(rows)
    assert {r.position for r in got if r.conv_id == 1} == set(range(6))
    for r in got:
        json.loads(r.json)
    assert [r.wrong for r in got if r.conv_id == 2] == ["bad JSON", None]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("json", F_lit()).withColumn("mid", F_lit())
    assert chat.format_chats(df).count() == len(rows)
    assert chat.format_chats(none_of(df)).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_chats_by_sql(spark):
    from oracle import differences, duck

    assert differences(chat.op9_chat_formatting(spark, SF), duck(SF), chat.OP9_SQL) == ""


def test_canonical_json():
    assert chat.canonical({"b": 1.0, "a": [True, None, "é\n"], "\U0001f600": 2.5, "￿": 10**20}) == '{"a":[true,null,"é\\n"],"b":1,"\U0001f600":2.5,"￿":100000000000000000000}'
    assert not chat.fits(True, {"type": "integer"})
    assert chat.fits(2.0, {"type": "integer"})
    assert not chat.fits({"a": 1, "b": 2}, {"type": "object", "properties": {"a": {}}, "additionalProperties": False})


def test_a_long_chain_of_calls_is_no_cycle(spark):
    """101 calls, each of which asks for the result before, all in one turn: ordered by what they need."""
    said = []
    for i in range(101):
        args = {"x": {"$result": f"c{i - 1}"}} if i else {}
        said.append((1, 0, "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "function": {"name": "f", "arguments": args}}]})))
        said.append((1, 0, "tool", json.dumps({"tool_call_id": f"c{i}", "content": "ok"})))
    got = sorted(chat.format_chats(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"), {"f": {}}).collect(), key=lambda r: r.position)
    assert {r.wrong for r in got} == {None}
    order = [(lambda b: b["tool_calls"][0]["id"] if "tool_calls" in b else b["tool_call_id"])(json.loads(r.json)) for r in got]
    assert order == [f"c{i}" for i in range(101) for _ in range(2)]


def by_rounds(rows, known):
    """(conv, turn, role, n_calls, wrong, json) in order, from (conv, turn, role, body) by the definition."""
    out = []
    for conv in {r[0] for r in rows}:
        said = [r for r in rows if r[0] == conv]
        first, result, times = {}, {}, collections.Counter()
        late = lambda i: (said[i][1] is None, said[i][1] or 0, i)
        for i in sorted(range(len(said)), key=late):
            for c in said[i][3].get("tool_calls", []):
                first.setdefault(c["id"], i)
                times[c["id"]] += 1
            if "tool_call_id" in said[i][3]:
                result.setdefault(said[i][3]["tool_call_id"], i)
        before, wrong = collections.defaultdict(set), collections.defaultdict(list)
        for i, (_, _, _, body) in enumerate(said):
            if "tool_call_id" in body:
                if body["tool_call_id"] in first:
                    before[i].add(first[body["tool_call_id"]])
                else:
                    wrong[i].append("result without call")
            for c in body.get("tool_calls", []):
                for v in c["function"]["arguments"].values():
                    if v["$result"] in result:
                        before[i].add(result[v["$result"]])
                    else:
                        wrong[i].append("missing result")
        for c, i in first.items():
            wrong[i] += ["call without result"] * (c not in result) + ["repeated identifier"] * (times[c] > 1)
        at, level = {}, {}
        while True:
            ready = [i for i in range(len(said)) if i not in at and before[i] <= set(at)]
            if not ready:
                break
            new = {i: (max((x for x in (said[i][1], *(at[b] for b in before[i])) if x is not None), default=None), 1 + max((level[b] for b in before[i]), default=-1)) for i in ready}
            for i, (a, k) in new.items():
                at[i], level[i] = a, k
        for i, (_, turn, role, body) in enumerate(said):
            unknown = "unknown tool" if any(c["function"]["name"] not in known for c in body.get("tool_calls", [])) else None
            fault = min(wrong[i], default=None) if i in at else "cycle"
            calls = [{"id": c["id"], "type": "function", "function": {"name": c["function"]["name"], "arguments": chat.canonical(c["function"]["arguments"])}} for c in body.get("tool_calls", [])]
            text = chat.canonical({"role": role, "content": None, "tool_calls": calls} if calls else {"role": role, "tool_call_id": body["tool_call_id"], "content": None})
            a, k = (at[i], level[i]) if i in at else (turn, 1 << 30)
            out.append(((conv is None, conv or 0, a is None, a or 0, k, turn is None, turn or 0, role, text), (conv, turn, role, len(calls), unknown or fault, text)))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


@pytest.mark.parametrize("most_alone", [chat.MOST_ALONE, 3])
def test_random_conversations(spark, most_alone):
    """Chains, shared and missing results, repeated identifiers, cycles, 1 beside "1", null turns and conversations."""
    import random

    rng, rows = random.Random(11), []
    for conv in (1, 2, 3, 4, None):
        ids = [*range(1, 7), *"123456"]
        for _ in range(20):
            turn = rng.choice([None, *range(12)])
            if rng.random() < 0.5:
                rows.append((conv, turn, "tool", {"tool_call_id": rng.choice(ids)}))
            else:
                calls = [{"id": rng.choice(ids), "function": {"name": rng.choice("ffffg"), "arguments": {f"a{k}": {"$result": rng.choice(ids)} for k in range(rng.choice([0, 0, 1, 2]))}}} for _ in range(rng.choice([1, 1, 2]))]
                rows.append((conv, turn, "assistant", {"tool_calls": calls}))
    # Rows that stand at the same place in all but their order would be told apart by chance: one of each.
    rows = list({json.dumps(r): r for r in rows}.values())
    df = spark.createDataFrame([(c, t, r, json.dumps(b)) for c, t, r, b in rows], "conv_id bigint, turn int, role string, text string").coalesce(1)
    got = sorted(chat.format_chats(df, {"f": {}}, most_alone).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))
    assert [(r.conv_id, r.turn, r.role, r.n_calls, r.wrong, r.json) for r in got] == by_rounds(rows, {"f"})
    assert {r.wrong for r in got} >= {"cycle", "missing result", "repeated identifier", "result without call", "call without result"}


def test_a_chain_of_500_calls(spark):
    nodes, edges = [(i, 0) for i in range(1000)], [(i, i + 1) for i in range(999)]
    assert chat.levels(nodes, edges) == [(i, 0, i) for i in range(1000)]
    assert {k for _, _, k in chat.levels([(1, 0), (2, 0), (3, 0)], [(1, 1), (2, 3)])} == {chat.CYCLE, 0, 1}


def test_schemas():
    ok = [({"const": 1}, 1, 1.5), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 4, 2), ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, 7, 4), ({"pattern": "^a"}, "ab", "b"), ({"maxLength": 2}, "é😀", "abc"), ({"items": {"type": "integer"}, "minItems": 1}, [1], ["x"]), ({"not": {"type": "null"}}, 1, None), ({"enum": [1]}, 1.0, True), ({"exclusiveMinimum": 1, "multipleOf": 2}, 2, 1), ({"additionalProperties": {"type": "string"}}, {"a": "b"}, {"a": 1})]
    for schema, good, bad in ok:
        chat.checked(schema)
        assert chat.fits(good, schema) and not chat.fits(bad, schema), schema
    for schema in ({"$ref": "#/a"}, {"type": "whole"}, {"properties": {"a": {"if": {}}}}):
        with pytest.raises(ValueError):
            chat.checked(schema)
