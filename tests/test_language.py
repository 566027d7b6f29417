"""The query language on small logs whose answers are known."""

import math

import pytest
from logs import edge, episodes

from lodestream.plans.gql import GqlError, Session, parse, required_access


def col(df, i=0):
    return [r[i] for r in df.collect()]


@pytest.fixture(scope="module")
def rivers(spark):
    return Session(episodes(spark, [{"agent_id": "bob" if i % 2 else "alice", "attrs": {"topic": "rivers"}, "ms": 5000 + i} for i in range(10)]))


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ('MATCH (n) WHERE n.agent_id = "alice" RETURN n', 5),
        ('MATCH (n) WHERE n.topic = "rivers" RETURN n LIMIT 4', 4),
        ("MATCH (n) AS OF LSN 5 RETURN n", 5),
        ("MATCH (n) AS OF LSN 0 RETURN n", 0),
        ("MATCH (n) AS OF TIMESTAMP 4990 RETURN n", 0),
        ("MATCH (n) AS OF TIMESTAMP 1005000 RETURN n", 10),
        ("MATCH (n) AS OF TIMESTAMP 5003 RETURN n", 4),
        ("MATCH (n:observation) RETURN n", 10),
        ('MATCH (n) WHERE n.kind = "observation" RETURN n', 0),
        ('MATCH (n) WHERE n.nothing != "x" RETURN n', 0),
    ],
)
def test_match(rivers, text, n):
    assert rivers.run(text).count() == n


def test_order_is_numeric(rivers):
    assert col(rivers.run("MATCH (n) RETURN n.lsn ORDER BY n.lsn ASC")) == list(range(10))


def test_and_binds_tighter(spark):
    s = Session(episodes(spark, [{"agent_id": "alice", "attrs": {"cor": "azul"}}, {"agent_id": "bob", "attrs": {"cor": "verde"}}]))
    assert col(s.run('MATCH (n) WHERE n.agent_id = "alice" OR n.cor = "verde" AND n.agent_id = "carol" RETURN n.agent_id')) == ["alice"]


def test_numeric_strings(spark):
    s = Session(episodes(spark, [{"attrs": {"valor": v}} for v in ("5", "50", "150", "3000")]))
    q = "MATCH (n) WHERE n.valor {} RETURN n.valor ORDER BY n.lsn"
    assert col(s.run(q.format("> 10 AND n.valor < 200"))) == ["50", "150"]
    assert col(s.run(q.format(">= 150"))) == ["150", "3000"]
    assert col(s.run("MATCH (n) WHERE n.valor > 1 AS OF LSN 2 RETURN n.valor")) == ["5", "50"]
    assert col(s.run(q.format('= "50"'))) == ["50"]
    assert col(s.run(q.format("> 100 AND n.valor < 10"))) == []


def test_numbers_with_suffixes_are_text(spark):
    s = Session(episodes(spark, [{"attrs": {"v": v}} for v in ("5d", "4", "x")]))
    assert col(s.run("MATCH (n) WHERE n.v > 1 RETURN n.v")) == ["4"]
    assert sorted(col(s.run("MATCH (n) WHERE n.v != 4 RETURN n.v"))) == ["5d", "x"]
    assert col(s.run("MATCH (n) RETURN n.v ORDER BY n.v")) == ["4", "5d", "x"]


def test_valid_at(spark):
    s = Session(episodes(spark, [{"id": "old", "valid_from": 1000, "valid_to": 2000}, {"id": "cur", "valid_from": 1500}, {"id": "timeless"}]))
    at = lambda t, more="": set(col(s.run(f"MATCH (n) VALID AT {t} {more} RETURN n.id")))
    assert at(1200) == {"old", "timeless"}
    assert at(1700) == {"old", "cur", "timeless"}
    assert at(2000) == {"cur", "timeless"}
    assert at(1700, "AS OF LSN 1") == {"old"}


def test_hyperbolic_order(spark):
    s = Session(episodes(spark, [{"id": i, "embedding": ([x], [], []) if x is not None else None} for i, x in (("perto", 0.10), ("meio", 0.50), ("longe", 0.90), ("none", None))]))
    assert col(s.run("MATCH (n) WHERE DIST_HYP([0.12]) < 0.1 RETURN n.id")) == ["perto"]
    assert col(s.run("MATCH (n) RETURN n.id ORDER BY DIST_HYP([0.12]) ASC")) == ["perto", "meio", "longe", "none"]
    assert col(s.run("MATCH (n) RETURN n.id ORDER BY DIST_HYP([0.12]) DESC LIMIT 1")) == ["none"]


def test_edges_live_and_die(spark):
    s = Session(episodes(spark, [edge("Alfa", "Maria", "socio_de"), edge("Alfa", "Beto"), edge("Alfa", "Maria", "socio_de", edge_op="retract")]))
    q = "MATCH (a)-[r]->(b) {} RETURN b.id"
    assert col(s.run(q.format(""))) == ["Beto"]
    assert sorted(col(s.run(q.format("AS OF LSN 2")))) == ["Beto", "Maria"]
    assert col(s.run(q.format("AS OF LSN 1"))) == ["Maria"]


def test_reopened_edge(spark):
    s = Session(episodes(spark, [edge("a", "b"), edge("a", "b", edge_op="retract"), edge("a", "b")]))
    q = "MATCH (a)-[r]->(b) {} RETURN b.id"
    assert [s.run(q.format(x)).count() for x in ("", "AS OF LSN 2", "AS OF LSN 1")] == [1, 0, 1]


def test_hypotheses(spark):
    s = Session(episodes(spark, [edge("X", "Y", "fraud_partner", rule="R1", confidence="0.8", stance="support"), edge("X", "Y", "fraud_partner", rule="R2", confidence="0.6", stance="refute")]))
    assert s.run('HYPOTHESES("X", "Y", "fraud_partner")').count() == 2
    assert s.run('HYPOTHESES("X", "Y", "fraud_partner") AS OF LSN 1').count() == 1
    belief = col(s.run("MATCH (a)-[r]->(b) RETURN r.belief"))[0]
    assert belief == pytest.approx(1 / (1 + math.exp(-(math.log(4) - math.log(1.5)))), abs=1e-5)
    assert col(s.run("MATCH (a)-[r]->(b) AS OF LSN 1 RETURN r.belief"))[0] == pytest.approx(0.8)


def test_community_and_metrics(spark):
    s = Session(episodes(spark, [edge("A1", "A2"), edge("A2", "A3"), edge("A3", "A1"), edge("B1", "B2")]))
    rows = s.run('COMMUNITY("A1")').collect()
    assert {r.community for r in rows} == {"A1"}
    assert [r.node for r in rows] == ["A1", "A2", "A3"]
    assert s.run('METRICS("A1")').first().degree == 2
    assert s.run('COMMUNITY("nobody")').count() == 0


def test_simulate_is_isolated(spark):
    tri = [edge("A1", "A2"), edge("A2", "A3"), edge("A3", "A1"), edge("B1", "B2"), edge("B2", "B3"), edge("B3", "B1")]
    s = Session(episodes(spark, [*tri, edge("A1", "B1")]))
    assert s.run('COMMUNITY("A1")').count() == 6
    assert [r.node for r in s.run('SIMULATE REMOVE EDGE ("A1", "pagou", "B1") THEN COMMUNITY("A1")').collect()] == ["A1", "A2", "A3"]
    three = Session(episodes(spark, [*tri, edge("C1", "C2"), edge("C2", "C3"), edge("C3", "C1")]))
    assert three.run('SIMULATE ADD EDGE ("A1", "x", "B1") THEN SIMULATE ADD EDGE ("B1", "x", "C1") THEN COMMUNITY("A1")').count() == 9
    assert three.run('COMMUNITY("A1")').count() == 3


def test_leiden_splits_at_the_bridge(spark):
    rows = [edge("A1", "A2"), edge("A2", "A3"), edge("A3", "A1"), edge("A1", "A2", "x"), edge("B1", "B2"), edge("B2", "B3"), edge("B3", "B1"), edge("B1", "B2", "x"), edge("A1", "B1")]
    s = Session(episodes(spark, rows))
    assert [r.node for r in s.run('COMMUNITY("A2", LEIDEN)').collect()] == ["A1", "A2", "A3"]


@pytest.fixture(scope="module")
def causes(spark):
    return Session(episodes(spark, [{"id": "e0"}, {"id": "e1", "parents": ["e0"]}, {"id": "e2", "parents": ["e1"]}, {"id": "e3", "parents": ["e2", "e0"]}, {"id": "stranger"}]))


def test_why(causes):
    rows = causes.run('WHY("e3")').collect()
    assert {(r.depth, r.id) for r in rows} == {(0, "e3"), (1, "e2"), (1, "e0"), (2, "e1")}
    assert [r.id for r in rows if r.is_root] == ["e0"]
    assert causes.run('WHY("e3", 1)').count() == 3


@pytest.mark.parametrize(("until", "path"), [("e0", ["e3", "e0"]), ("e1", ["e3", "e2", "e1"]), ("stranger", None)])
def test_why_until(causes, until, path):
    r = causes.run(f'WHY("e3") UNTIL "{until}"').first()
    assert (r.linked, r.path or None) == (path is not None, path)


def test_traverse_and_provenance(causes):
    assert [(r.depth, r.node) for r in causes.run('TRAVERSE("e0", 2)').collect()] == [(1, "e1"), (1, "e3"), (2, "e2")]
    assert sorted(col(causes.run('PROVENANCE("e3")'))) == ["e0", "e2"]


def test_entities(spark):
    s = Session(episodes(spark, [{"attrs": {"entity_key": "CPF:111"}}, {"attrs": {"entity_key": "CPF:222"}}, {"attrs": {"er_op": "merge", "er_a": "CPF:111", "er_b": "CPF:222"}}]))
    assert col(s.run('RESOLVE("CPF:222")')) == ["CPF:111"]
    assert col(s.run('RESOLVE("CPF:222") AS OF LSN 2')) == ["CPF:222"]
    assert col(s.run('CLUSTER("CPF:111")')) == ["CPF:111", "CPF:222"]
    split = Session(episodes(spark, [{"attrs": {"er_op": "merge", "er_a": "a", "er_b": "b"}}, {"attrs": {"er_op": "split", "er_key": "b"}}, {"attrs": {"er_op": "split", "er_key": "zz"}}]))
    assert col(split.run('RESOLVE("b")')) == ["b@1"]
    assert col(split.run('CLUSTER("a")')) == ["a"]


def test_adapt(spark):
    fb = [{"attrs": {"feedback_rule": "flag_anomaly", "score": s, "verdict": v}} for s, v in (("3.0", "confirm"), ("2.5", "confirm"), ("2.0", "confirm"), ("1.6", "reject"), ("1.0", "reject"))]
    s = Session(episodes(spark, fb))
    r = s.run("ADAPT()").first()
    assert (r.samples, r.threshold, r.precision) == (5, 2.0, 1.0)
    r = s.run("ADAPT() AS OF LSN 0").first()
    assert (r.samples, r.threshold) == (0, 1.5)


def test_decide_proposes_once(spark):
    star = [edge("hub", f"n{i}") for i in range(8)] + [edge("p", "q", "fraud_partner", confidence="0.9")]
    s = Session(episodes(spark, star))
    rows = {r.action_id for r in s.run("DECIDE()").collect()}
    assert rows == {"flag_anomaly:hub", "flag_fraud:p->q#fraud_partner"}
    done = Session(episodes(spark, [*star, {"kind": "Action", "attrs": {"action_id": "flag_anomaly:hub"}}]))
    assert {r.action_id for r in done.run("DECIDE()").collect()} == {"flag_fraud:p->q#fraud_partner"}


def test_fuse(spark):
    """The first is the top of no single channel."""
    rows = [{"id": "anchor"}]
    for i, conf, near, text in (("X", "0.7", 0.65, "fraude"), ("W", "1.0", 0.0, "nada"), ("Y", "0.2", 0.5, "nada"), ("Z", "0.2", 0.95, "fraude fraude")):
        rows += [{"id": i, "embedding": ([], [], [near]), "content": text}, edge("anchor", i, confidence=conf, rule=i)]
    s = Session(episodes(spark, rows))
    got = s.run('FUSE("fraude", [0.5], "anchor", 10)').collect()
    assert len(got) == 4
    assert got[0].id == "X"
    assert s.run('FUSE("fraude", [0.5], "anchor", 10) AS OF LSN 0').count() == 0


def test_recall(spark):
    s = Session(episodes(spark, [{"content": "the river runs"}, {"content": "a river of time"}, {"content": "fire and change"}]))
    assert col(s.run('RECALL("river", 5)')) == [1, 0]
    assert col(s.run('RECALL("fire change", 5)'))[0] == 2
    assert s.run('RECALL("river", 0)').count() == 0


def test_create(spark):
    r = Session(episodes(spark, [{}])).run('CREATE (n:action {a: "x", b: 2})').first()
    assert (r.lsn, r.kind, r.attrs) == (1, "Action", {"a": "x", "b": "2"})


@pytest.mark.parametrize("text", ['RESOLVE("x") AS OF LSN 0', 'CLUSTER("x") AS OF LSN 0', 'NEIGHBORS("Alfa") AS OF LSN 0', 'TRAVERSE("Alfa", 3) AS OF LSN 0', 'COMMUNITY("Alfa") AS OF LSN 0', 'METRICS("Alfa") AS OF LSN 0', 'RECALL("river", 3) AS OF LSN 0', 'NEAREST([0.1], 3) AS OF LSN 0', 'WHY("e0") AS OF LSN 0', 'HYPOTHESES("Alfa", "Beto", "pagou") AS OF LSN 0', "DECIDE() AS OF LSN 0"])
def test_before_the_log_is_nothing(spark, text):
    assert Session(episodes(spark, [edge("Alfa", "Beto")])).run(text).count() == 0


def test_guards(spark):
    s = Session(episodes(spark, [{}]))
    with pytest.raises(GqlError):
        s.run("REQUIRE LSN >= 2 MATCH (n) RETURN n")
    assert s.run("REQUIRE LSN >= 1 MATCH (n) RETURN n").count() == 1
    for bad in ("MATCH n RETURN n", "DROP (x)", "MATCH (n) RETURN n LIMIT 1.5", 'WHY("x") UNTIL'):
        with pytest.raises(GqlError):
            parse(bad)
    assert required_access(parse('CREATE (n:x {a: "b"})')) == "write"
    assert required_access(parse("EXPLAIN DECIDE()")) == "read"
    assert "ScanFilter" in s.run("EXPLAIN MATCH (n) RETURN n").first().plan
