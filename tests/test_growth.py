"""Registered queries on logs unlike the driver's, and the plans of those that have to grow with their input."""

import datetime

import pytest
from oracle import differences

from lodestream.queries import ORACLE_SQL, QUERIES


def events(spark, folder, rows):
    """An events table of (event_id, user_id, event_type, value, k), and DuckDB's view of it."""
    import duckdb

    start = datetime.datetime(2024, 1, 1)
    full = [(i, start + datetime.timedelta(seconds=i), u, t, float(v), f'{{"k": {k}}}') for i, u, t, v, k in rows]
    spark.createDataFrame(full, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("before", [[], [7], [5, 120], [1, 2, 3, 4, 300]])
def test_why_until_of_short_chains(spark, tmp_path, before):
    """e390 with none, one, two and more causes."""
    con = events(spark, tmp_path, [(i, 1 if i == 390 or i in before else 1000 + i % 9, "click", 1, i % 5) for i in range(400)])
    assert differences(QUERIES["g08_why_until"](spark, str(tmp_path)), con, ORACLE_SQL["g08_why_until"]) == ""


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["p11_edge_filter", "g13_simulate", "j02_graph_match", "g11_decide", "p10_project_edge"])
def test_attributes_of_touches_are_no_concatenations(spark, name):
    """Maps put together by a function were made anew for each lookup, of which a type's key had one a known type."""
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "map_concat" not in plan
    assert plan.count("[edge_type]") <= 6 * plan.count("Relation [")


def test_edge_types(spark):
    from logs import edge, episodes

    from lodestream.operators import graph

    names = [*graph.TYPES, *(t.upper() for t in graph.TYPES), "Touch", "custom:x", "", "É"]
    got = graph.edge_ops(episodes(spark, [edge(f"a{i}", "b", t) for i, t in enumerate(names)] + [{"attrs": {"edge_from": "c", "edge_to": "d"}}])).select("lsn", "etype").orderBy("lsn").collect()
    assert [r.etype for r in got] == [*map(graph.edge_type_key, names), "custom:provenance"]


def test_communities_compute_their_edges_once(spark):
    """The edges of a log are a plan over all of it; it was run by each of the steps that need them."""
    from lodestream.operators import graph

    seen = spark.sparkContext.accumulator(0)

    def look(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    cliques = [(f"n{4 * c + a}", f"n{4 * c + b}", 1.0) for c in range(3) for a in range(4) for b in range(a)] + [("n3", "n4", 0.1), ("loop", "loop", 1.0)]
    e = spark.createDataFrame(cliques, "src string, dst string, belief double").mapInPandas(look, "src string, dst string, belief double")
    got = {r.node: r.community for r in graph.communities(e).collect()}
    assert seen.value == len(cliques)
    groups = [sorted(f"n{4 * c + a}" for a in range(4)) for c in range(3)]
    assert got == {n: g[0] for g in groups for n in g} | {"loop": "loop"}


def moves(edges, names, rounds):
    """Greedy modularity with dictionaries of names, as _modularity does it with arrays."""
    graph = {n: {} for n in names}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            graph[x][y] = graph[x].get(y, 0.0) + w
    members, total = {n: [n] for n in names}, sum(sum(v.values()) for v in graph.values()) or 1.0
    for _ in range(rounds):
        degree = {n: sum(v.values()) for n, v in graph.items()}
        at, volume, moved, gained = {n: n for n in graph}, dict(degree), True, False
        while moved:
            moved = False
            for n in sorted(graph):
                links = {}
                for m, w in graph[n].items():
                    if m != n:
                        links[at[m]] = links.get(at[m], 0.0) + w
                volume[at[n]] -= degree[n]
                best = max(sorted({*links, at[n]}), key=lambda c: (links.get(c, 0.0) - volume[c] * degree[n] / total, c == at[n]))
                volume[best] += degree[n]
                if best != at[n]:
                    at[n], moved, gained = best, True, True
        if not gained:
            break
        members = {c: [x for n in graph if at[n] == c for x in members[n]] for c in set(at.values())}
        merged = {c: {} for c in members}
        for n, v in graph.items():
            for m, w in v.items():
                merged[at[n]][at[m]] = merged[at[n]].get(at[m], 0.0) + w
        graph = merged
    return {x: min(ns) for ns in members.values() for x in ns}


@pytest.mark.parametrize("weights", ["equal", "any", "whole"])
def test_modularity_by_arrays(weights):
    import random

    import numpy as np

    from lodestream.operators import graph

    r = random.Random(7)
    for _ in range(60):
        e = [(a, b, {"equal": 1.0, "any": r.random(), "whole": float(r.randint(0, 3))}[weights]) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(r.randint(2, 90))) if a != b]
        if not e:
            continue
        names = sorted({x for a, b, _ in e for x in (a, b)})
        place = {x: k for k, x in enumerate(names)}
        i, j, w = (np.array(c) for c in zip(*((place[a], place[b], w) for a, b, w in e), strict=True))
        assert {names[k]: names[c] for k, c in enumerate(graph._modularity(i, j, w, 20))} == moves(e, names, 20)


@pytest.mark.parametrize("name, end", [("j02_graph_match", "u3"), ("g13_simulate", "u1")])
def test_ends_narrow_the_evidence_too(spark, name, end):
    """Beliefs are only worked out for the edges that were asked for: the condition is on both sides' scans."""
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    beliefs = plan.split("Join LeftOuter")[1].split("min_by", 1)[1]
    assert f"= {end})" in beliefs


def test_words_move_once_a_word(spark):
    """A row per word and document was shuffled to count documents."""
    plan = QUERIES["r04_tokenize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Aggregate(" in x)


def test_words_of_odd_documents(spark, tmp_path):
    """Keys on several rows, null keys and texts, repeated words, no words."""
    import duckdb

    rows = [(1, "ab ab cd"), (1, "ab ef"), (1, "ab ab"), (2, "cd x Éa éa"), (3, None), (4, "  "), (None, "ab gh"), (None, "ab"), (5, "Ab-AB_ab 10"), (2, "cd"), (6, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(QUERIES["r04_tokenize"](spark, str(tmp_path)), con, ORACLE_SQL["r04_tokenize"]) == ""
