"""Name resolution: call sites to definitions in the same file, else the same package, else anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Confidence of a sole candidate in each scope, and of one among several.
FILE, PACKAGE, GLOBAL, AMBIGUOUS = 0.95, 0.95, 0.75, 0.60
#: What extraction puts before a base type's name.
HERITAGE = {"EXTENDS:": "EXTENDS", "IMPLEMENTS:": "IMPLEMENTS"}


def package() -> F.Column:
    return F.coalesce(F.nullif(F.col("package_path"), F.lit("")), T.dirname("file_path"))


def scopes(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file, name), (package, name) and (name) with the first candidate by file, line and uid, and how many there are."""
    first = F.min(F.struct("file_path", "start_line", "uid"))["uid"]
    some = nodes.select("uid", "name", "file_path", "start_line", package().alias("package"))
    return tuple(some.groupBy(*keys).agg(first.alias(f"{p}_uid"), F.count(F.lit(1)).alias(f"{p}_n")) for p, keys in (("f", ("file_path", "name")), ("p", ("package", "name")), ("g", ("name",))))


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_uid, to_uid, type, confidence of refs (from_uid, callee_name).

    A dotted name counts by what follows its first dot. Prefixed names are base types. What has no candidate, or is the
    caller itself, goes. Several references between two symbols give one edge of a type, with the highest confidence.

    All joins sort and merge. Symbols often come from Python functions or packed files, for which Spark expects far less than
    there is, and a broadcast that is planned on such a size isn't taken back when the real one is known: the driver would hold it.
    """
    caller = nodes.select(F.col("uid").alias("from_uid"), "file_path", package().alias("package"))
    kind = F.lit("CALLS")
    for prefix, name in HERITAGE.items():
        kind = F.when(F.col("callee_name").startswith(prefix), F.lit(name)).otherwise(kind)
    bare = F.regexp_replace("callee_name", "^(" + "|".join(HERITAGE) + ")", "")
    asked = refs.select("from_uid", kind.alias("type"), T.unqualified(bare).alias("name")).distinct().join(caller.hint("merge"), "from_uid")
    f, p, g = (scope.hint("merge") for scope in scopes(nodes))
    found = asked.join(f, ["file_path", "name"], "left").join(p, ["package", "name"], "left").join(g, "name", "left")
    sure = lambda n, c: F.when(F.col(n) == 1, F.lit(c)).otherwise(F.lit(AMBIGUOUS))
    confidence = F.when(F.col("f_uid").isNotNull(), sure("f_n", FILE)).when(F.col("p_uid").isNotNull(), sure("p_n", PACKAGE)).otherwise(sure("g_n", GLOBAL))
    edges = found.select("from_uid", F.coalesce("f_uid", "p_uid", "g_uid").alias("to_uid"), "type", confidence.alias("confidence"))
    return edges.filter("to_uid IS NOT NULL AND to_uid <> from_uid").groupBy("from_uid", "to_uid", "type").agg(F.max("confidence").alias("confidence"))


def member_edges(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """MEMBER_OF edges from owners (uid, owner_uid) between known nodes."""
    known = nodes.select("uid")
    pairs = owners.select(F.col("uid").alias("from_uid"), F.col("owner_uid").alias("to_uid")).distinct()
    pairs = pairs.join(known.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(known.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi")
    return pairs.select("from_uid", "to_uid", F.lit("MEMBER_OF").alias("type"), F.lit(1.0).alias("confidence"))


def imports(refs: DataFrame) -> DataFrame:
    """file_path, import_path, target, confidence: relative imports as cleaned paths (.95), others as they are (.85)."""
    relative = F.col("import_path").startswith(".")
    joined = F.concat_ws("/", T.dirname("file_path"), "import_path")
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when((x == "..") & (F.size(s) > 0), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(x == "..", s).otherwise(F.concat(s, F.array(x))))
    clean = F.concat(F.when(joined.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    return refs.select("file_path", "import_path", F.when(relative, clean).otherwise(F.col("import_path")).alias("target"), F.when(relative, F.lit(0.95)).otherwise(F.lit(0.85)).alias("confidence"))
