"""SQL over a graph's tables, for reading only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"'(?:[^']|'')*'")
#: Words of another dialect and what they are here.
DIALECT = ((r"\bdatetime\('now'\)", "current_timestamp()"), (r"(\w+(?:\.\w+)?) GLOB '([^']*)'", None))
#: Fixed value: what group_concat puts between values without a separator of its own.
SEPARATOR = ","


class NotReading(ValueError):
    """The statement is not a single SELECT."""


def checked(sql: str) -> str:
    """sql, if it is one SELECT, WITH or VALUES statement."""
    text = _COMMENT.sub(" ", sql).strip().rstrip(";").strip()
    bare = _STRING.sub("''", text)
    if ";" in bare or not re.match(r"(?is)\s*\(*\s*(select|with|values)\b", bare):
        raise NotReading("only a single SELECT statement is allowed")
    if re.search(r"(?is)\b(insert|update|delete|merge|drop|alter|create|truncate)\s+(into|from|table|view|database|overwrite)\b", bare):
        raise NotReading("the statement changes data")
    return text


def _glob(pattern: str) -> str:
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c in "[]-" else re.escape(c)) for c in pattern) + "$"


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments between the parenthesis at a place and its partner, and the place after that."""
    out, depth, begin, k = [], 0, at + 1, at
    while k < len(text):
        quoted = _STRING.match(text, k) if text[k] == "'" else None
        if quoted:
            k = quoted.end()
            continue
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0 or (depth == 1 and text[k] == ","):
            out.append(text[begin:k].strip())
            begin = k + 1
            if depth == 0:
                return out, k + 1
        k += 1
    raise NotReading("a parenthesis is open")


def _joined(text: str) -> str:
    """group_concat(x) and group_concat(x, s), also DISTINCT, in the order of the values; null where all are."""
    out, at = "", 0
    for m in re.finditer(r"\bgroup_concat\s*\(", text, re.I):
        if m.start() < at or "'" in text[at : m.start()] and len(re.findall("'", text[: m.start()])) % 2:
            continue
        args, end = _arguments(text, m.end() - 1)
        one = re.match(r"(?is)(distinct\s+)?(.*)", args[0])
        value = f"CAST({one[2]} AS STRING)"
        every = "collect_set" if one[1] else "collect_list"
        out += text[at : m.start()] + f"CASE WHEN count({value}) > 0 THEN array_join(array_sort({every}({value})), {args[1] if len(args) > 1 else repr(SEPARATOR)}) END"
        at = end
    return out + text[at:]


def translated(sql: str) -> str:
    """Words of the other dialect replaced; LIKE there ignores case, and numbers with a point are doubles."""
    out = re.sub(DIALECT[0][0], DIALECT[0][1], sql, flags=re.I)
    out = re.sub(DIALECT[1][0], lambda m: f"{m[1]} RLIKE r'{_glob(m[2])}'", _joined(out), flags=re.I)
    parts = re.split(r"('(?:[^']|'')*')", out)
    plain = lambda p: re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", re.sub(r"\bLIKE\b", "ILIKE", p, flags=re.I))
    return "".join(p if k % 2 else plain(p) for k, p in enumerate(parts))


def _relations(spark: SparkSession, text: str) -> set[str]:
    """What the statement reads, but for its own WITH names: tables and views by name, files as a name in two parts."""
    jvm = spark.sparkContext._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    with_plan = spark._jsparkSession.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.expressions.PlanExpression")
    names: set[str] = set()
    own: set[str] = set()

    def walk(p) -> None:
        kind = p.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            names.add(".".join(jvm.scala.jdk.javaapi.CollectionConverters.asJava(p.multipartIdentifier())))
        if kind == "UnresolvedTableValuedFunction":
            names.add("a table function")
        if kind == "UnresolvedWith":
            for pair in jvm.scala.jdk.javaapi.CollectionConverters.asJava(p.cteRelations()):
                own.add(pair._1().lower())
                walk(pair._2())
        for inner in jvm.scala.jdk.javaapi.CollectionConverters.asJava(p.children()):
            walk(inner)
        for e in jvm.scala.jdk.javaapi.CollectionConverters.asJava(p.expressions()):
            inside(e)

    def inside(e) -> None:
        if with_plan.isInstance(e):
            walk(e.plan())
        for x in jvm.scala.jdk.javaapi.CollectionConverters.asJava(e.children()):
            inside(x)

    walk(plan)
    return {n for n in names if n.lower() not in own}


def _whole_division(df_sql: str, kinds: dict[str, str]) -> str:
    """a / b between whole numbers is whole there: both operands are literals or columns that are integers in all tables."""

    def one(m: re.Match) -> str:
        whole = all(re.fullmatch(r"\d+", x) or kinds.get(x.split(".")[-1].lower()) in ("int", "bigint", "smallint", "tinyint") or re.fullmatch(r"(?i)(count|length)\([^()]*\)", x) for x in (m[1], m[2]))
        return f"{m[1]} div {m[2]}" if whole else m[0]

    operand = r"((?:\b(?:count|length)\([^()]*\))|[\w.]+)"
    parts = re.split(r"('(?:[^']|'')*')", df_sql)
    return "".join(p if k % 2 else re.sub(rf"(?i){operand}\s*/\s*{operand}(?![\w.(])", one, p) for k, p in enumerate(parts))


def run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The statement's rows over tables, by their names, and nothing else: no other table, view, file or table function.

    The session's views of these names are as before afterwards.
    """
    kinds: dict[str, str] = {}
    for df in tables.values():
        for c, kind in df.dtypes:
            kinds[c.lower()] = kind if kinds.get(c.lower(), kind) == kind else ""
    text = _whole_division(translated(checked(sql)), kinds)
    foreign = {n for n in _relations(spark, text) if n.lower() not in {t.lower() for t in tables}}
    if foreign:
        raise NotReading(f"not a table of the graph: {', '.join(sorted(foreign))}")
    before = {name: spark.table(name) if spark.catalog._jcatalog.tableExists(name) else None for name in tables}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name, df in before.items():
            spark.catalog.dropTempView(name)
            if df is not None:
                df.createOrReplaceTempView(name)
