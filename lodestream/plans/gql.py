"""The graph query language: text to statements to DataFrames."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import vectors
from lodestream.functions.compare import compare, order_keys
from lodestream.operators import causal, entity, graph, reports, retrieval
from lodestream.sources.episodes import snapshot, valid_at

_TOKEN = re.compile(r"""\s*(?:(?P<str>"[^"]*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z][A-Za-z0-9_]*)|(?P<sym>->|!=|>=|<=|[-()\[\]{},.:=<>*]))""")
_DISTANCES = ("DIST_HYP", "DIST_SPH", "DIST_EUC", "DIST_PRODUCT")


class GqlError(ValueError):
    """A text that isn't a statement."""


@dataclass(frozen=True)
class Operand:
    """kind: prop, ident, number, string or distance. value: its name or literal; arg: a distance's vector."""

    kind: str
    value: object
    arg: tuple = ()


@dataclass(frozen=True)
class Statement:
    name: str
    args: tuple = ()
    as_of: tuple | None = None  # ("lsn" | "timestamp", n)
    valid: float | None = None
    where: tuple = ()  # OR of ANDs of (Operand, op, Operand)
    order: tuple | None = None  # (Operand, descending)
    limit: int | None = None
    returns: tuple = ()
    node: tuple = ()  # (variable, label)
    edge: tuple = ()  # (from, relation, type, to)
    inner: Statement | None = None
    explain: bool = False
    require: int | None = None


@dataclass
class _Parser:
    text: str
    tokens: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        pos, text = 0, self.text.rstrip().rstrip(";").rstrip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise GqlError(f"unexpected {text[pos : pos + 10]!r} at {pos}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def is_(self, *words: str) -> bool:
        return all(self.peek(i)[1].upper() == w.upper() and self.peek(i)[0] != "str" for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise GqlError(f"expected {' '.join(words)}, found {self.peek()[1] or 'the end'}")

    def one(self, kind: str) -> str:
        k, v = self.peek()
        if k != kind:
            raise GqlError(f"expected {kind}, found {v or 'the end'}")
        self.at += 1
        return v[1:-1] if kind == "str" else v

    def whole(self) -> int:
        v = self.one("num")
        if not v.isdigit():
            raise GqlError(f"{v} isn't a whole number")
        return int(v)

    def vector(self) -> tuple:
        self.need("[")
        out = [float(self.one("num"))]
        while self.take(","):
            out.append(float(self.one("num")))
        self.need("]")
        return tuple(out)

    # statements

    def statement(self) -> Statement:
        explain = self.take("EXPLAIN")
        require = None
        if self.take("REQUIRE"):
            self.need("LSN", ">=")
            require = self.whole()
        out = replace(self.body(), explain=explain, require=require)
        if self.peek()[0] != "end":
            raise GqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def body(self) -> Statement:
        word = self.one("word").upper()
        if word == "MATCH":
            return self.match()
        if word == "CREATE":
            return self.create()
        if word == "SIMULATE":
            op = self.one("word").upper()
            if op not in ("ADD", "REMOVE"):
                raise GqlError("SIMULATE ADD or REMOVE")
            self.need("EDGE", "(")
            parts = [self.one("str")]
            for _ in range(2):
                self.need(",")
                parts.append(self.one("str"))
            self.need(")")
            self.need("THEN")
            return Statement("SIMULATE", (op, *parts), inner=self.body())
        shapes = {"RECALL": "sn", "NEAREST": "vn", "PROVENANCE": "s", "NEIGHBORS": "s?s", "TRAVERSE": "sn", "FUSE": "svsn", "RESOLVE": "s", "CLUSTER": "s", "HYPOTHESES": "sss", "WHY": "s?n", "COMMUNITY": "s?w", "METRICS": "s", "DECIDE": "", "ADAPT": ""}
        if word not in shapes:
            raise GqlError(f"no statement {word}")
        self.need("(")
        args, optional = [], False
        for i, c in enumerate(x for x in shapes[word]):
            if c == "?":
                optional = True
                continue
            if args or i:
                if not self.take(","):
                    if optional:
                        break
                    raise GqlError("expected ,")
            args.append(self.one("str") if c == "s" else self.whole() if c == "n" else self.vector() if c == "v" else self.one("word").upper())
        self.need(")")
        until = (self.one("str"),) if word == "WHY" and self.take("UNTIL") else ()
        as_of = None if word == "PROVENANCE" else self.as_of()
        return Statement(word, tuple(args), as_of=as_of, returns=until)

    def as_of(self) -> tuple | None:
        if not self.take("AS", "OF"):
            return None
        kind = self.one("word").lower()
        if kind not in ("lsn", "timestamp"):
            raise GqlError("AS OF LSN or TIMESTAMP")
        return kind, self.whole()

    def match(self) -> Statement:
        self.need("(")
        var = self.one("word")
        label = self.one("word") if self.take(":") else None
        self.need(")")
        node, edge = (var, label), ()
        if self.take("-", "["):
            rel = self.one("word")
            kind = self.one("word") if self.take(":") else None
            self.need("]")
            self.need("->")
            self.need("(")
            to = self.one("word")
            if self.take(":"):
                self.one("word")
                warnings.warn("labels of nodes in an edge pattern are ignored", stacklevel=2)
            self.need(")")
            edge = (var, rel, kind, to)
        where = self.conditions() if self.take("WHERE") else ()
        valid = None
        if self.take("VALID", "AT"):
            valid = float(self.one("num"))
        as_of = self.as_of()
        self.need("RETURN")
        returns = [self.projection()]
        while self.take(","):
            returns.append(self.projection())
        order = None
        if self.take("ORDER", "BY"):
            what = self.operand()
            order = (what, bool(self.take("DESC")) or (bool(self.take("ASC")) and False))
        limit = self.whole() if self.take("LIMIT") else None
        return Statement("MATCH", as_of=as_of, valid=valid, where=where, order=order, limit=limit, returns=tuple(returns), node=node, edge=edge)

    def projection(self) -> str:
        if self.take("*"):
            return "*"
        v = self.one("word")
        return f"{v}.{self.one('word')}" if self.take(".") else v

    def conditions(self) -> tuple:
        groups, now = [], [self.condition()]
        while True:
            if self.take("AND"):
                now.append(self.condition())
            elif self.take("OR"):
                groups.append(tuple(now))
                now = [self.condition()]
            else:
                return (*groups, tuple(now))

    def condition(self) -> tuple:
        left = self.operand()
        op = self.one("sym")
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise GqlError(f"no comparison {op}")
        return left, op, self.operand()

    def operand(self) -> Operand:
        kind, v = self.peek()
        if kind == "str":
            return Operand("string", self.one("str"))
        if kind == "num":
            return Operand("number", float(self.one("num")))
        word = self.one("word")
        if word.upper() in _DISTANCES:
            self.need("(")
            if self.peek()[0] == "word":
                self.projection()
                self.need(",")
            vec = self.vector()
            self.need(")")
            return Operand("distance", word.upper(), vec)
        if self.take("."):
            return Operand("prop", (word, self.one("word")))
        return Operand("ident", word)

    def create(self) -> Statement:
        self.need("(")
        self.one("word")
        self.need(":")
        label, props = self.one("word"), []
        if self.take("{"):
            while not self.take("}"):
                if props:
                    self.need(",")
                key = self.one("word")
                self.need(":")
                if self.peek()[0] == "str":
                    props.append((key, self.one("str")))
                else:
                    n = float(self.one("num"))
                    props.append((key, str(int(n)) if n == int(n) else repr(n)))
        self.need(")")
        return Statement("CREATE", (label, tuple(props)))


def parse(text: str) -> Statement:
    return _Parser(text).statement()


def required_access(s: Statement) -> str:
    s = s.inner if s.name == "SIMULATE" else s
    return "write" if s.name in ("CREATE", "DECIDE") and not s.explain else "read"


_ENVELOPE = {"lsn": True, "ts_hlc": True, "id": False, "agent_id": False, "session_id": False, "kind": False, "tipo": False, "content": False}


def _field(name: str) -> tuple[Column, bool]:
    """A node's property and whether it is a number: envelope fields, then attributes (native validity isn't one)."""
    if name in _ENVELOPE:
        return F.col("kind" if name == "tipo" else name), _ENVELOPE[name]
    return F.col("attrs")[name], False


def _distance(o: Operand) -> Column:
    q, e = vectors.vector(o.arg), F.col("embedding")
    if o.value == "DIST_PRODUCT":
        return vectors.product(e, q)
    part, f = {"DIST_HYP": ("hyp", vectors.hyperbolic), "DIST_SPH": ("sph", vectors.spherical), "DIST_EUC": ("euc", vectors.euclidean)}[o.value]
    return F.when(F.size(e[part]) == len(o.arg), f(e[part], q))


def _value(o: Operand, context) -> tuple[Column, bool]:
    if o.kind == "number":
        return F.lit(o.value), True
    if o.kind == "string":
        return F.lit(o.value), False
    return context(o)


def _node(o: Operand) -> tuple[Column, bool]:
    if o.kind == "distance":
        return _distance(o), True
    return _field(o.value[1] if o.kind == "prop" else o.value)


def condition(where: tuple, context) -> Column:
    out = F.lit(False)
    for group in where:
        every = F.lit(True)
        for left, op, right in group:
            (a, an), (b, bn) = _value(left, context), _value(right, context)
            every = every & compare(a, op, b, an, bn)
        out = out | every
    return out


class Session:
    """Statements over one log. episodes: the log; edges of SIMULATE are laid over what is derived from it."""

    def __init__(self, episodes: DataFrame):
        self.episodes, self.changes = episodes, []

    def run(self, text: str) -> DataFrame:
        """The rows of a statement. EXPLAIN gives one row with the plan, CREATE the new row (append it yourself)."""
        s = parse(text)
        if s.explain:
            return self.episodes.sparkSession.createDataFrame([(explain(s),)], "plan string")
        if s.require is not None:
            head = self.episodes.agg(F.coalesce(F.max("lsn") + 1, F.lit(0))).first()[0]
            if head < s.require:
                raise GqlError(f"the log's head {head} is below {s.require}")
        return self.execute(s)

    def visible(self, s: Statement) -> DataFrame:
        kind, n = s.as_of or (None, None)
        return snapshot(self.episodes, n if kind == "lsn" else None, n if kind == "timestamp" else None)

    def edges(self, s: Statement) -> tuple[DataFrame, DataFrame]:
        """Open edges (with belief) and versions of the snapshot."""
        ops = graph.edge_ops(self.visible(s))
        intervals, versions = graph.edge_intervals(ops), graph.edge_versions(ops)
        for op, a, t, b in self.changes:
            intervals = graph.overlay(intervals, (a, t, b), None) if op == "ADD" else graph.overlay(intervals, None, (a, t, b))
        return intervals, versions

    def execute(self, s: Statement) -> DataFrame:
        e = self.visible(s)
        if s.name == "MATCH":
            return self.match_edge(s) if s.edge else self.match_node(s, e)
        a = s.args
        if s.name == "CREATE":
            return self.create(s)
        if s.name == "SIMULATE":
            inner = Session(self.episodes)
            inner.changes = [*self.changes, a]
            return inner.execute(s.inner)
        if s.name == "RECALL":
            return retrieval.recall(e, a[0], a[1], corpus=self.episodes).withColumnRenamed("key", "lsn")
        if s.name == "NEAREST":
            flat = F.concat(*(F.coalesce(F.col("embedding")[p], F.array().cast("array<float>")) for p in ("hyp", "sph", "euc")))
            return retrieval.nearest(e.where("embedding IS NOT NULL"), flat, a[0], a[1]).select("lsn", "id", "dist")
        if s.name == "PROVENANCE":
            return causal.provenance(self.episodes, a[0])
        if s.name == "WHY":
            if s.returns:
                path = causal.why_until(e, a[0], s.returns[0], *a[1:])
                return e.sparkSession.createDataFrame([(path is not None, path or [])], "linked boolean, path array<string>")
            return causal.why(e, *a).orderBy("depth", "id")
        if s.name in ("RESOLVE", "CLUSTER"):
            return getattr(entity, s.name.lower())(entity.entity_intervals(e), a[0])
        if s.name == "ADAPT":
            return reports.adapt(e)
        intervals, versions = self.edges(s)
        open_ = graph.match_edges(intervals, versions)
        if s.name == "NEIGHBORS":
            return graph.neighbors(intervals, versions, *a).orderBy("node", "etype")
        if s.name == "TRAVERSE":
            return graph.bfs(open_, a[0], a[1]).orderBy("depth", "node")
        if s.name == "HYPOTHESES":
            return graph.hypotheses(versions, f"{a[0]}->{a[1]}#{graph.edge_type_key(a[2])}")
        if s.name == "METRICS":
            return graph.metrics(open_).where(F.col("node") == a[0])
        if s.name == "COMMUNITY":
            if a[1:] not in ((), ("LEIDEN",)):
                raise GqlError("COMMUNITY(n) or COMMUNITY(n, LEIDEN)")
            found = graph.communities(open_) if a[1:] else graph.components(open_)
            mine = found.where(F.col("node") == a[0]).select("community")
            return found.join(mine, "community", "left_semi").select("community", "node").orderBy("node")
        if s.name == "DECIDE":
            done = e.where("kind = 'Action'").select(F.col("attrs")["action_id"].alias("action_id")).where("action_id IS NOT NULL")
            return reports.decide(graph.metrics(open_), open_, done)
        if s.name == "FUSE":
            fetch = max(4 * a[3], 8)
            head = self.episodes.agg(F.coalesce(F.max("lsn") + 1, F.lit(0))).first()[0]
            near = retrieval.nearest(e.where("embedding IS NOT NULL"), F.concat(*(F.coalesce(F.col("embedding")[p], F.array().cast("array<float>")) for p in ("hyp", "sph", "euc"))), a[1], fetch)
            text = retrieval.recall(e, a[0], fetch, corpus=self.episodes).withColumnRenamed("key", "lsn").join(e.select("lsn", "id"), "lsn")
            around = graph.neighbors(intervals, versions, a[2]).select(F.col("node").alias("id"), F.col("belief").alias("value")).join(e.select("id", "lsn"), "id").groupBy("id", "lsn").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "id").limit(fetch)
            return retrieval.fuse(around, near.select("id", "lsn", (1 / (1 + F.col("dist"))).alias("value")), text.select("id", "lsn", F.col("score").alias("value")), a[3], head)
        raise GqlError(f"no statement {s.name}")

    def match_node(self, s: Statement, e: DataFrame) -> DataFrame:
        var, label = s.node
        if label:
            e = e.where(F.lower("kind") == label.lower())
        if s.valid is not None:
            e = valid_at(e, s.valid)
        if s.where:
            e = e.where(condition(s.where, _node))
        if s.order:
            o, desc = s.order
            if o.kind == "distance":
                d = F.coalesce(_distance(o), F.lit(float("inf")))
                keys = [d.desc() if desc else d.asc()]
            else:
                keys = order_keys(*_node(o), desc)
            e = e.orderBy(*keys, F.col("lsn").asc())
        elif s.limit is not None:
            e = e.orderBy("lsn")
        if s.limit is not None:
            e = e.limit(s.limit)
        if not s.returns or any(r in ("*", var) for r in s.returns):
            return e.select("lsn", "id", "agent_id", "session_id", "kind", "content", "attrs", "ts_hlc", "parents")
        return e.select(*(_field(r.split(".")[1])[0].alias(r) if r.startswith(f"{var}.") else F.lit(None).cast("string").alias(r) for r in dict.fromkeys(s.returns)))

    def match_edge(self, s: Statement) -> DataFrame:
        src, rel, kind, dst = s.edge
        intervals, versions = self.edges(s)
        e = graph.match_edges(intervals, versions, None, kind)
        if s.valid is not None:
            last = graph.edge_ops(self.visible(s)).where("op = 'a'").groupBy("edge_id").agg(F.max_by(F.struct("world_from", "world_to"), "lsn").alias("w"))
            e = e.join(last, "edge_id", "left").where((F.col("w.world_from").isNull() | (F.col("w.world_from") <= s.valid)) & (F.col("w.world_to").isNull() | (F.col("w.world_to") > s.valid)))
        known = {f"{src}.id": ("src", False), f"{dst}.id": ("dst", False), src: ("src", False), dst: ("dst", False), rel: ("edge_id", False), f"{rel}.type": ("etype", False), f"{rel}.belief": ("belief", True), f"{rel}.id": ("edge_id", False)}

        def context(o: Operand) -> tuple[Column, bool]:
            name = ".".join(o.value) if o.kind == "prop" else str(o.value)
            c, n = known.get(name, (None, False))
            return (F.col(c), n) if c and o.kind != "distance" else (F.lit(None).cast("string"), False)

        if s.where:
            e = e.where(condition(s.where, context))
        if s.limit is not None:
            e = e.orderBy("edge_id").limit(s.limit)
        names = list(known) if "*" in s.returns or not s.returns else [r for r in dict.fromkeys(s.returns)]
        if "*" in s.returns or not s.returns:
            names = [f"{src}.id", f"{rel}.type", f"{rel}.belief", f"{rel}.id", f"{dst}.id"]
        return e.select(*(F.col(known[r][0]).alias(r) if r in known else F.lit(None).cast("string").alias(r) for r in names))

    def create(self, s: Statement) -> DataFrame:
        label, props = s.args
        kind = {"action": "Action", "message": "Message", "observation": "Observation"}.get(label.lower(), label)
        pairs = [x for k, v in props for x in (F.lit(k), F.lit(v))]
        head = self.episodes.agg(F.coalesce(F.max("lsn") + 1, F.lit(0)).alias("lsn"))
        return head.select("lsn", F.lit("query").alias("agent_id"), F.lit("gql").alias("session_id"), F.lit(kind).alias("kind"), F.create_map(*pairs).cast("map<string,string>").alias("attrs"))


def explain(s: Statement) -> str:
    """The plan of a statement, a step a line."""
    out = [f"{'GraphMatch' if s.edge else 'ScanFilter' if s.name == 'MATCH' else s.name.title()}{list(s.args) if s.args else ''}"]
    if s.as_of:
        out.append(f"as of {s.as_of[0]} {s.as_of[1]}")
    if s.node and s.node[1] and not s.edge:
        out.append(f"label {s.node[1]}")
    if s.valid is not None:
        out.append(f"valid at {s.valid:g}")
    if s.where:
        out.append("where " + " or ".join(" and ".join(f"{a.value} {op} {b.value}" for a, op, b in g) for g in s.where))
    if s.order:
        out.append(f"order by {s.order[0].value}{' desc' * s.order[1]}")
    if s.limit is not None:
        out.append(f"limit {s.limit}")
    if s.inner:
        out.append("then " + explain(s.inner).replace("\n", "\n  "))
    return "\n  ".join(out)
