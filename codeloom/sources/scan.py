"""Repository scans: which files of a tree are read, and their lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.runtime import small_text

#: Directories and suffixes that are never read, and the languages of extensions.
SKIPPED_DIRECTORIES = (".git", ".codeloom", "node_modules", "vendor", "dist", ".idea", ".vscode")
SKIPPED_SUFFIXES = (".min.js", ".lock", ".pb.go")
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".py": "python", ".java": "java",
    ".rs": "rust", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
}


def language(path: Column | str) -> Column:
    """Null for extensions without one."""
    pairs = [x for e, lang in LANGUAGES.items() for x in (F.lit(e), F.lit(lang))]
    return F.create_map(*pairs)[F.lower(T.extension(path))]


def supported(path: Column | str) -> Column:
    return language(path).isNotNull()


def wanted(path: Column | str) -> Column:
    """Is a path outside skipped directories and without a skipped suffix?"""
    p = F.col(path) if isinstance(path, str) else path
    inside = F.arrays_overlap(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1), F.array(*map(F.lit, SKIPPED_DIRECTORIES)))
    out = ~inside
    for s in SKIPPED_SUFFIXES:
        out = out & ~p.endswith(s)
    return out


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression over relative paths, does it exclude?); None for blanks and comments."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    excludes = not line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    folder, line = line.endswith("/"), line.rstrip("/")
    rooted, line = "/" in line, line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("**", at):
            out, at = out + ".*", at + 2
        elif line[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif line[at] == "?":
            out, at = out + "[^/]", at + 1
        elif line[at] == "[" and "]" in line[at:]:
            end = line.index("]", at)
            out, at = out + "[" + line[at + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, at = out + re.escape(line[at]), at + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if folder else "(?:$|/)"), excludes


def ignored(path: Column | str, lines: list[str]) -> Column:
    """Does an ignore file's text exclude a relative path? The last line that fits counts."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for regex, excludes in filter(None, map(ignore_pattern, lines)):
        out = F.when(p.rlike(regex), F.lit(excludes)).otherwise(out)
    return out


#: Fixed value: the name of an ignore file.
IGNORE_FILE = ".gitignore"


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """Lines of the root's ignore file; none without one."""
    return (small_text(spark, f"{root.rstrip('/')}/{IGNORE_FILE}") or "").splitlines()


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, known_only: bool = True) -> DataFrame:
    """path (relative), ext, size, mtime, content of the files below root. ignore: lines in place of the root's ignore file."""
    base = root.rstrip("/")
    ignore = ignore_lines(spark, root) if ignore is None else ignore
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^\w+:/*", "/", base)) + "/", "")
    out = files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    out = out.filter(wanted("path") & ~ignored("path", ignore)).withColumn("ext", T.extension("path"))
    return (out.filter(supported("path")) if known_only else out).select("path", "ext", "size", "mtime", "content")


def snapshot(files: DataFrame) -> DataFrame:
    """path, hash of a scan."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def texts(files: DataFrame) -> DataFrame:
    """path, text of a scan; bytes that are no UTF-8 become replacement marks."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))
