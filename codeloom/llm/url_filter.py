"""URL filters: rules, and for urls without one a path-template tree; DataFrame and SQL operations only.

Paths become shapes: digits are a number sign. Per host, shapes form a tree by segments, as deep as the longest path. From the
root down, each node does two things with its children:

1. If it has more than MANY, those with less than a SHARE-th of its urls become one wildcard; so MANY + SHARE children are left
   at most.
2. Of two children the smaller joins the larger if they are statistically similar: the distributions of what follows in the path
   overlap by LIKE at least, and the shares of blocked urls among the labelled ones differ by two standard errors at most. It
   joins the largest child that it is similar to and that itself joins none.

Leaves are templates. Labels are the verdicts of the rules. A template is rejected if the share of blocked urls among its
labelled ones, where SMOOTH more count a half, is at least PURITY: templates without labels stay.

The tree is built from counts of distinct shapes a host, so hot hosts cost a partial sum, and joins leave the rows of hot keys
where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_join, written

#: (verdict, host and path): a rule fits its host and all subdomains where the path starts with its path; the longest wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MANY, SHARE, LIKE, SMOOTH, PURITY = 16, 20, 0.5, 10.0, 0.85

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule(rules: tuple):
    """struct<verdict, rule> of the longest rule that fits host and path (ties by the rule's text); null without one."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))).otherwise(out)
    return out


def _judged(pages: DataFrame, rules: tuple) -> DataFrame:
    """page_id, host, path, rule, label (the rule's verdict) and shape of every page."""
    at = F.instr(pages["url"], "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    cut = pages.select("page_id", "url").select("page_id", rest.alias("rest"))
    split = cut.select("page_id", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    named = split.withColumn("rule", _rule(rules))
    return named.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("label"), F.regexp_replace("path", "[0-9]+", "#").alias("shape"))


def _similar(leaf: DataFrame, node: DataFrame) -> DataFrame:
    """host, t, g, into: children that join another. leaf: host, t, g, rest, n, all (of the child); node: its n, known and bad."""
    side = lambda df, p, names, *same: df.select("host", "t", *same, *(F.col(c).alias(p + c) for c in names))
    a, b = (side(leaf, p, ("g", "n", "all"), "rest") for p in "ab")
    common = a.join(b, ["host", "t", "rest"]).filter("ag <> bg").groupBy("host", "t", "ag", "bg")
    common = common.agg(F.sum(F.least(F.col("an") / F.col("aall"), F.col("bn") / F.col("ball"))).alias("common")).filter(F.col("common") >= LIKE - 1e-9)
    pairs = common.join(side(node, "a", ("g", "n", "known", "bad")), ["host", "t", "ag"]).join(side(node, "b", ("g", "n", "known", "bad")), ["host", "t", "bg"])
    pairs = pairs.filter("an > bn OR (an = bn AND ag < bg)")
    known, bad = (F.col(f"a{c}").cast("double") + F.col(f"b{c}") for c in ("known", "bad"))
    apart = F.col("abad").cast("double") * F.col("bknown") - F.col("bbad").cast("double") * F.col("aknown")
    pairs = pairs.filter(apart * apart * known <= 4 * bad * (known - bad) * F.col("aknown") * F.col("bknown"))
    follows = pairs.select("host", "t", F.col("bg").alias("ag")).distinct()
    first = F.min(F.struct((-F.col("an")).alias("n"), "ag"))["ag"].alias("into")
    return pairs.join(follows, ["host", "t", "ag"], "left_anti").groupBy("host", "t", F.col("bg").alias("g")).agg(first)


def _level(state: DataFrame, d: int) -> DataFrame:
    """state with the templates t of all shapes that have a segment d longer by it."""
    rest = F.array_join(F.transform(F.slice("segments", d + 2, 1 << 30), lambda x: F.concat(F.lit("/"), x)), "")
    live = state.filter(F.size("segments") > d).withColumns({"s": F.get("segments", F.lit(d)), "rest": rest})
    over = state.filter(F.size("segments") <= d)
    child = written(live.groupBy("host", "t", "s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")), "url-children")
    parent = written(child.groupBy("host", "t").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all")).filter("children > 1"), "url-parents")
    if not parent.isEmpty():
        total = live.count()
        few = keyed_join(child, parent, ["host", "t"], child.count(), "children")
        wild = (F.col("children") > MANY) & (F.col("n") * SHARE < F.col("all"))
        few = written(few.select("host", "t", "s", "rows", F.when(wild, F.lit("*")).otherwise(F.col("s")).alias("g")), "url-children")
        named = written(keyed_join(live, few, ["host", "t", "s"], total, "rows").select(*live.columns, "g"), "url-level")
        node = written(named.groupBy("host", "t", "g").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("rows")), "url-nodes")
        leaf = written(named.groupBy("host", "t", "g", "rest").agg(F.sum("n").alias("n")), "url-leaves")
        leaf = keyed_join(leaf, node.select("host", "t", "g", F.col("n").alias("all"), "rows"), ["host", "t", "g"], total, "rows")
        into = _similar(written(leaf.drop("rows"), "url-leaves"), node)
        goes = written(node.select("host", "t", "g", "rows").join(into, ["host", "t", "g"], "left"), "url-joins")
        named = keyed_join(named, goes, ["host", "t", "g"], total, "rows").withColumn("m", F.coalesce("into", "g"))
        alone = live.join(few.select("host", "t").distinct(), ["host", "t"], "left_anti").withColumn("m", F.col("s"))
        live = named.select(*live.columns, "m").unionByName(alone.select(*live.columns, "m"))
    else:
        live = live.withColumn("m", F.col("s"))
    return written(live.withColumn("t", F.concat("t", F.lit("/"), "m")).select(state.columns).unionByName(over), "url-level")


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, known, bad) with t, the template of each."""
    state = written(shapes.withColumns({"segments": F.split("shape", "/"), "t": F.lit("")}), "url-shapes")
    deepest = state.agg(F.max(F.size("segments"))).first()[0] or 0
    for d in range(deepest):
        state = _level(state, d)
    return state.drop("segments")


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path, no rule, and its template's verdict. Repeated rows are judged
    alike, each; they count as often. Children that tie go by their text. Urls of any length are read whole; each further
    segment of the longest path is a further step over the distinct shapes. An empty table gives no rows. Other columns don't
    matter.
    """
    judged = _judged(pages, rules)
    shapes = judged.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.count_if(F.col("label") == "block").alias("bad"))
    state = templates(shapes)
    blocked = F.sum("bad") + SMOOTH / 2 >= PURITY * (F.sum("known") + SMOOTH)
    template = written(state.groupBy("host", "t").agg(F.when(blocked, "block").otherwise("allow").alias("verdict"), F.count(F.lit(1)).alias("rows")), "url-templates")
    of_shape = written(keyed_join(state, template, ["host", "t"], state.count(), "rows").select("host", "shape", "n", "verdict"), "url-verdicts")
    total = of_shape.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = keyed_join(judged, of_shape, ["host", "shape"], total)
    return found.select("page_id", "host", "path", "rule", F.coalesce("label", "verdict").alias("verdict"))
