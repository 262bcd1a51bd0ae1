"""A pattern-match language over the graph: text to tokens, to a pattern, to a DataFrame.

    MATCH (n:Kind {prop: 'value'}) WHERE n.prop op value AND ... RETURN n.prop [AS x], ... LIMIT k
    MATCH (a:Kind)-[r:TYPE]->(b:Kind) WHERE ... RETURN ... LIMIT k        also <-[r]-

Operators are =, <>, <, <=, >, >=, CONTAINS, STARTS WITH, ENDS WITH, IN [..], IS [NOT] NULL, joined by AND, OR, NOT and
parentheses. Names may be camelCase. An edge pattern always gives from_name, to_name, type and confidence.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100
DEFAULT_COLUMNS = ("uid", "name", "kind", "file_path")
NODE = ("uid", "name", "kind", "file_path", "start_line", "end_line", "exported", "package_path", "cluster_id")
EDGE = ("type", "confidence")

_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark><>|<=|>=|<-|->|[-()\[\]{}:,.=<>*]))""")


class PatternError(ValueError):
    """The text is no pattern of this language."""


@dataclass
class NodePattern:
    name: str = ""
    kind: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Query:
    nodes: list[NodePattern]
    edge: NodePattern | None
    reverse: bool
    where: object
    returns: list[tuple[str, str, str]]  # variable, property, name
    limit: int


def _property(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip().rstrip(";").rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise PatternError(f"unexpected text at {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return kind in ("name", "mark") and value.upper() in words

    def take(self, *words: str) -> bool:
        found = self.peek(*words)
        self.at += found
        return found

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise PatternError(f"expected {' or '.join(words)}")

    def next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise PatternError(f"expected a {kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self) -> object:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "string":
            return re.sub(r"\\(.)", r"\1", text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1])
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "name" and text.upper() in ("TRUE", "FALSE"):
            return text.upper() == "TRUE"
        raise PatternError("expected a value")

    def inside(self, end: str) -> NodePattern:
        p = NodePattern()
        if self.tokens[self.at : self.at + 1] and self.tokens[self.at][0] == "name":
            p.name = self.next("name")
        if self.take(":"):
            p.kind = self.next("name")
        if self.take("{"):
            while not self.take("}"):
                key = self.next("name")
                self.need(":")
                p.props[_property(key)] = self.value()
                if not self.peek("}"):
                    self.need(",")
        self.need(end)
        return p

    def any_of(self) -> object:
        terms = [self.all_of()]
        while self.take("OR"):
            terms.append(self.all_of())
        return terms[0] if len(terms) == 1 else ("or", *terms)

    def all_of(self) -> object:
        terms = [self.term()]
        while self.take("AND"):
            terms.append(self.term())
        return terms[0] if len(terms) == 1 else ("and", *terms)

    def term(self) -> object:
        if self.take("NOT"):
            return ("not", self.term())
        if self.take("("):
            inner = self.any_of()
            self.need(")")
            return inner
        var = self.next("name")
        self.need(".")
        prop = _property(self.next("name"))
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ("is not null" if negated else "is null", var, prop, None)
        if self.take("STARTS", "ENDS"):
            op = self.tokens[self.at - 1][1].lower()
            self.need("WITH")
            return (op, var, prop, self.value())
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.value())
                if not self.peek("]"):
                    self.need(",")
            return ("in", var, prop, values)
        self.need("=", "<>", "<", "<=", ">", ">=", "CONTAINS")
        return (self.tokens[self.at - 1][1].lower(), var, prop, self.value())

    def query(self) -> Query:
        if not self.take("MATCH"):
            raise PatternError("only MATCH is understood; use SQL for other queries")
        self.need("(")
        nodes, edge, reverse = [self.inside(")")], None, False
        if self.peek("-", "<-"):
            reverse = self.take("<-")
            if not reverse:
                self.need("-")
            self.need("[")
            edge = self.inside("]")
            self.need("-" if reverse else "->")
            self.need("(")
            nodes.append(self.inside(")"))
        where = self.any_of() if self.take("WHERE") else None
        returns = []
        if self.take("RETURN"):
            while True:
                var, prop = self.next("name"), ""
                if self.take("."):
                    prop = _property(self.next("name"))
                name = self.next("name") if self.take("AS") else prop
                returns.append((var, prop, name))
                if not self.take(","):
                    break
        limit = int(self.next("number")) if self.take("LIMIT") else DEFAULT_LIMIT
        if self.at != len(self.tokens):
            raise PatternError(f"unexpected {self.tokens[self.at][1]!r}")
        return Query(nodes, edge, reverse, where, returns, limit)


def parse(text: str) -> Query:
    return _Parser(text).query()


def _condition(where: object, column) -> Column:
    op = where[0]
    if op in ("and", "or"):
        parts = [_condition(x, column) for x in where[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if op == "and" else out | p
        return out
    if op == "not":
        return ~_condition(where[1], column)
    c, v = column(where[1], where[2]), where[3]
    return {
        "=": lambda: c == v, "<>": lambda: c != v, "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v,
        "contains": lambda: c.contains(v), "starts": lambda: c.startswith(v), "ends": lambda: c.endswith(v), "in": lambda: c.isin(v),
        "is null": lambda: c.isNull(), "is not null": lambda: c.isNotNull(),
    }[op]()


def run(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows that a pattern matches. Limits cut by uid or names, so that they are the same in each run."""
    q = parse(text)
    if q.edge is None:
        own = q.nodes[0]

        def column(var: str, prop: str) -> Column:
            if var != own.name or prop not in NODE:
                raise PatternError(f"unknown {var}.{prop}")
            return F.col(prop)

        found = nodes.filter(F.col("kind") == own.kind) if own.kind else nodes
        for key, value in own.props.items():
            found = found.filter(column(own.name, key) == value)
        if q.where:
            found = found.filter(_condition(q.where, column))
        wanted = [column(v, p).alias(n) for v, p, n in q.returns if p] or [F.col(c) for c in DEFAULT_COLUMNS]
        return found.orderBy("uid").limit(q.limit).select(*wanted)
    left, right = q.nodes[::-1] if q.reverse else q.nodes
    a = nodes.select(*(F.col(c).alias(f"a_{c}") for c in NODE))
    b = nodes.select(*(F.col(c).alias(f"b_{c}") for c in NODE))
    joined = edges.join(a, F.col("from_uid") == F.col("a_uid")).join(b, F.col("to_uid") == F.col("b_uid"))

    def of(var: str, prop: str) -> Column:
        if q.edge.name and var == q.edge.name and prop in EDGE:
            return F.col(prop)
        for side, p in (("a", left), ("b", right)):
            if p.name and var == p.name and prop in NODE:
                return F.col(f"{side}_{prop}")
        raise PatternError(f"unknown {var}.{prop}")

    if q.edge.kind:
        joined = joined.filter(F.col("type") == q.edge.kind)
    for key, value in q.edge.props.items():
        joined = joined.filter(of(q.edge.name, key) == value)
    for side, p in (("a", left), ("b", right)):
        if p.kind:
            joined = joined.filter(F.col(f"{side}_kind") == p.kind)
        for key, value in p.props.items():
            joined = joined.filter(F.col(f"{side}_{key}") == value)
    if q.where:
        joined = joined.filter(_condition(q.where, of))
    out = joined.orderBy("a_uid", "b_uid", "type").limit(q.limit)
    return out.select(F.col("a_name").alias("from_name"), F.col("b_name").alias("to_name"), "type", "confidence")
