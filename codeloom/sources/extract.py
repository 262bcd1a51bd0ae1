"""Symbols, imports and calls from source text, by masking strings and comments, matching declarations and pairing brackets.

Python goes through its own parser. The functions are plain Python over one file; extract() runs them over a table of files.
"""

from __future__ import annotations

import ast
import hashlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import LANGUAGES

KINDS = "rec string, uid string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, package_path string, other string, flag boolean"


@dataclass
class Found:
    path: str
    nodes: list = field(default_factory=list)  # uid, name, kind, start, end, exported, package
    imports: list = field(default_factory=list)  # path, alias, is_type
    calls: list = field(default_factory=list)  # from_uid, callee, line
    owners: list = field(default_factory=list)  # uid, owner uid

    def add(self, name: str, kind: str, start: int, end: int, exported: bool, qualified: str = "", package: str = "") -> str:
        uid = hashlib.sha256(f"{self.path}:{qualified or name}:{kind}".encode()).hexdigest()[:16]
        self.nodes.append((uid, name, kind, start, end, exported, package))
        return uid


class Source:
    """A text with its strings and comments blanked out (same length), and its bracket pairs."""

    def __init__(self, text: str, language: str) -> None:
        self.text = text
        line = r"//[^\n]*" if language != "python" else r"#[^\n]*"
        strings = {"go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', "rust": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\''}
        string = strings.get(language, r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
        self.masked = re.sub(rf"{line}|/\*.*?\*/|{string}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.pair: dict[int, int] = {}
        open_: list[int] = []
        for m in re.finditer(r"[{}()]", self.masked):
            if m[0] in "{(":
                open_.append(m.start())
            elif open_:
                self.pair[open_.pop()] = m.start()

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self.breaks, at) + 1

    def body(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The first pair of braces from at on, before a stop at the same level."""
        while at < len(self.masked):
            c = self.masked[at]
            if c == "{":
                return at, self.pair.get(at, len(self.masked) - 1)
            if c == "(":
                at = self.pair.get(at, at)
            elif c in stop:
                return None
            at += 1
        return None


#: Words before a parenthesis that are no callee.
_NOT_CALLED = frozenset("if for while switch catch function return typeof await new super import match loop sizeof else do in of defer go func fn".split())
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*\s*\.\s*)*[A-Za-z_$][\w$]*)\s*\(")


def _calls(s: Source, found: Found, uid: str, a: int, b: int, dotted: bool) -> None:
    for m in _CALL.finditer(s.masked, a, b):
        name = re.sub(r"\s", "", m[1])
        before = s.masked[max(0, m.start() - 12) : m.start()].rstrip()
        if name in _NOT_CALLED or re.search(r"\b(?:new|function|func|fn)$", before) or ("." in name and not dotted):
            continue
        opened = m.end() - 1
        after = s.masked[s.pair.get(opened, opened) + 1 :].lstrip()[:1]
        if after == "{" and "." not in name:
            continue  # a method's or function's head
        found.calls.append((uid, name, s.line(m.start())))


def _typescript(s: Source, found: Found) -> None:
    for m in re.finditer(r"\b(import|export)\s+(type\s+)?([^;()]*?\bfrom\s*)?(['\"])([^'\"\n]+)\4", s.text):
        if s.masked[m.start()] != " ":
            found.imports.append((m[5], "", bool(m[2])))
    exported = r"(?P<x>\bexport\s+(?:default\s+)?)?"
    for m in re.finditer(exported + r"(?:\basync\s+)?\bfunction\s*\*?\s*(?P<n>[\w$]+)\s*[<(]", s.masked):
        opened = s.masked.find("(", m.end() - 1)
        span = s.body(opened) if opened >= 0 else None
        if span:
            uid = found.add(m["n"], "Function", s.line(m.start() if m["x"] is None else m.start("n")), s.line(span[1]), m["x"] is not None)
            _calls(s, found, uid, *span, dotted=True)
    for m in re.finditer(exported + r"\b(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=;]+)?=\s*(?P<v>(?:async\s+)?(?:function\b|class\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>))", s.masked):
        span = s.body(m.end())
        last = span[1] if span else s.masked.find("\n", m.end())
        uid = found.add(m["n"], "Class" if m["v"].startswith("class") else "Function", s.line(m.start("n")), s.line(last if last >= 0 else len(s.text)), m["x"] is not None)
        _calls(s, found, uid, m.end(), last if last >= 0 else len(s.text), dotted=True)
    for m in re.finditer(exported + r"\binterface\s+(?P<n>[\w$]+)", s.masked):
        span = s.body(m.end())
        if span:
            found.add(m["n"], "Interface", s.line(m.start("n")), s.line(span[1]), m["x"] is not None)
    for m in re.finditer(exported + r"(?:\babstract\s+)?\bclass\s+(?P<n>[\w$]+)(?P<h>[^{]*)", s.masked):
        span = s.body(m.end())
        if not span:
            continue
        owner = found.add(m["n"], "Class", s.line(m.start("n")), s.line(span[1]), m["x"] is not None)
        for h in re.finditer(r"\b(extends|implements)\s+([\w$.,\s]+?)(?=\bimplements\b|$)", m["h"].strip()):
            for base in filter(None, map(str.strip, h[2].split(","))):
                found.calls.append((owner, f"{h[1].upper()}:{base}", s.line(m.start("n"))))
        at = span[0] + 1
        while at < span[1]:
            g = re.compile(r"(?:(?:public|private|protected|static|readonly|async|override|get|set|abstract)\s+)*\*?(?P<n>[\w$#]+)\s*(?:<[^>(]*>)?\s*\(").match(s.masked, at)
            if g and g["n"] not in _NOT_CALLED:
                inner = s.body(s.pair.get(g.end() - 1, g.end()) + 1, stop=";")
                if inner and inner[1] <= span[1]:
                    uid = found.add(g["n"], "Method", s.line(at), s.line(inner[1]), True, f"{m['n']}.{g['n']}")
                    found.owners.append((uid, owner))
                    _calls(s, found, uid, *inner, dotted=True)
                    at = inner[1] + 1
                    continue
            c = s.masked[at]
            at = s.pair.get(at, at) + 1 if c in "{(" else (g.end() - 1 if g else at + 1)


def _go(s: Source, found: Found) -> None:
    package = posixpath.dirname(found.path) or "."
    for block in re.finditer(r"^import\s*(\([^)]*\)|[^\n]*)", s.text, re.M):
        for m in re.finditer(r'([\w.]+)?[ \t]*"([^"]+)"', block[1]):
            found.imports.append((m[2], m[1] or "", False))
    for m in re.finditer(r"^func\s*(?:\((?P<r>[^)]*)\)\s*)?(?P<n>\w+)\s*(?:\[[^\]]*\])?\(", s.masked, re.M):
        span = s.body(m.end() - 1, stop="\n")
        last = span[1] if span else s.pair.get(m.end() - 1, m.end())
        receiver = re.sub(r"\[.*", "", (m["r"] or "").split()[-1]).lstrip("*") if m["r"] and m["r"].split() else ""
        up = m["n"][0].isascii() and m["n"][0].isupper()
        uid = found.add(m["n"], "Method" if m["r"] is not None else "Function", s.line(m.start()), s.line(last), up, f"{receiver}.{m['n']}" if receiver else "", package)
        if span:
            _calls(s, found, uid, *span, dotted=False)
    for m in re.finditer(r"^(?:type\s+|[ \t]+)(?P<n>\w+)(?:\[[^\]]*\])?\s+(?P<t>struct\b|interface\b)|^type\s+(?P<o>\w+)\s+=?\s*(?P<u>[\w.*\[\]]+)", s.masked, re.M):
        name, kind = (m["n"], {"struct": "Class", "interface": "Interface"}[m["t"]]) if m["n"] else (m["o"], "Type")
        span = s.body(m.end(), stop="\n") if m["n"] else None
        found.add(name, kind, s.line(m.start()), s.line(span[1] if span else m.end()), name[0].isascii() and name[0].isupper(), "", package)


def _python(s: Source, found: Found) -> None:
    try:
        tree = ast.parse(s.text)
    except (SyntaxError, ValueError):
        return

    def visit(body: list) -> None:
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                uid = found.add(n.name, "Function", n.lineno, n.end_lineno or n.lineno, not n.name.startswith("_"))
                for c in ast.walk(n):
                    if isinstance(c, ast.Call):
                        found.calls.append((uid, ast.unparse(c.func), c.lineno))
            elif isinstance(n, ast.ClassDef):
                found.add(n.name, "Class", n.lineno, n.end_lineno or n.lineno, not n.name.startswith("_"))
                visit(n.body)
            elif isinstance(n, ast.ImportFrom):
                found.imports.append(("." * n.level + (n.module or ""), "", False))
            elif isinstance(n, ast.If | ast.Try | ast.With):
                visit(n.body)

    visit(tree.body)


def _java(s: Source, found: Found) -> None:
    for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", s.masked, re.M):
        found.imports.append((m[1], "", False))
    for m in re.finditer(r"\b(class|enum|interface)\s+(\w+)", s.masked):
        span = s.body(m.end())
        if span:
            found.add(m[2], "Interface" if m[1] == "interface" else "Class", s.line(m.start()), s.line(span[1]), True)
    for m in re.finditer(r"(?:^|[;{}])\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?[\w.<>\[\],?]+\s+(?P<n>\w+)\s*\(", s.masked):
        close = s.pair.get(m.end() - 1)
        head = s.masked[m.start() : m.start("n")]
        if close is None or m["n"] in _NOT_CALLED or re.search(r"\b(?:new|return|throw|else)\b", head):
            continue
        span = s.body(close + 1)
        if span or re.match(r"\s*(?:throws[\w\s,.]+)?;", s.masked[close + 1 : close + 200]):
            found.add(m["n"], "Method", s.line(m.start("n")), s.line(span[1] if span else close), True)


def _rust(s: Source, found: Found) -> None:
    for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", s.masked, re.M):
        found.imports.append((re.sub(r"\s+", "", m[1]), "", False))
    for m in re.finditer(r"(?P<x>\bpub\s+)?(?:pub\([^)]*\)\s+)?(?:(?:async|const|unsafe)\s+)*\bfn\s+(?P<n>\w+)\s*(?:<[^({]*>)?\s*\(", s.masked):
        span = s.body(m.end() - 1)
        uid = found.add(m["n"], "Function", s.line(m.start("n")), s.line(span[1] if span else m.end()), m["x"] is not None)
        if span:
            _calls(s, found, uid, *span, dotted=False)
    for m in re.finditer(r"\b(struct|enum|trait)\s+(\w+)", s.masked):
        span = s.body(m.end())
        found.add(m[2], "Interface" if m[1] == "trait" else "Class", s.line(m.start()), s.line(span[1] if span else m.end()), False)


def _cpp(s: Source, found: Found) -> None:
    for m in re.finditer(r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', s.text, re.M):
        found.imports.append((m[1], "", False))
    for m in re.finditer(r"\b(?:class|struct)\s+(\w+)[^;{()]*(?=\{)", s.masked):
        span = s.body(m.end())
        found.add(m[1], "Class", s.line(m.start()), s.line(span[1]), False)
    for m in re.finditer(r"(?:^|[;{}:])\s*(?:[\w:<>,*&~]+[\s*&]+)+(?:\w+::)*(?P<n>~?\w+)\s*\(", s.masked, re.M):
        close = s.pair.get(m.end() - 1)
        if close is None or m["n"] in _NOT_CALLED or re.search(r"\b(?:return|new|else|throw)\b", s.masked[m.start() : m.start("n")]):
            continue
        span = s.body(close + 1)
        if span and re.fullmatch(r"\s*(?:const|noexcept|override|final|\s|:[^{]*|->[^{]*)*", s.masked[close + 1 : span[0]]):
            uid = found.add(m["n"], "Function", s.line(m.start("n")), s.line(span[1]), False)
            _calls(s, found, uid, *span, dotted=False)


_BY_LANGUAGE = {"typescript": _typescript, "tsx": _typescript, "javascript": _typescript, "go": _go, "python": _python, "java": _java, "rust": _rust, "cpp": _cpp}


class UnknownLanguage(ValueError):
    """No extractor for a file's extension."""


def extract_file(path: str, text: str) -> Found:
    language = LANGUAGES.get(posixpath.splitext(path)[1].lower())
    if not language:
        raise UnknownLanguage(path)
    found = Found(path)
    _BY_LANGUAGE[language](Source(text, language), found)
    return found


def records(files: DataFrame) -> DataFrame:
    """One table of nodes, imports, calls and owners of files (path, text).

    Files of unknown languages give nothing. A file that breaks its extractor gives a row of its own (rec = 'failed') with the
    error, and doesn't touch the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in KINDS.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    f = extract_file(path, text or "")
                except UnknownLanguage:
                    continue
                except Exception as e:  # noqa: BLE001  whatever a broken file raises
                    rows.append(("failed", None, type(e).__name__, None, path, None, None, None, None, str(e)[:500], None))
                    continue
                rows += [("node", u, n, k, path, a, b, x, p, None, None) for u, n, k, a, b, x, p in f.nodes]
                rows += [("import", None, alias, None, path, None, None, None, None, target, flag) for target, alias, flag in f.imports]
                rows += [("call", u, None, None, path, line, None, None, None, callee, None) for u, callee, line in f.calls]
                rows += [("owner", u, None, None, path, None, None, None, None, owner, None) for u, owner in f.owners]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"start_line": "Int32", "end_line": "Int32", "exported": "boolean", "flag": "boolean"})

    return files.select("path", "text").mapInPandas(run, KINDS)


def nodes_of(found: DataFrame) -> DataFrame:
    return found.filter("rec = 'node'").select("uid", "name", "kind", "file_path", "start_line", "end_line", "exported", F.coalesce("package_path", F.lit("")).alias("package_path"), F.lit("").alias("cluster_id"))


def calls_of(found: DataFrame) -> DataFrame:
    return found.filter("rec = 'call'").select(F.col("uid").alias("from_uid"), F.col("other").alias("callee_name"), F.col("start_line").alias("line"))


def references_of(found: DataFrame) -> DataFrame:
    """file_path, from_uid, callee_name, line: call sites with their files, to be kept."""
    return found.filter("rec = 'call'").select("file_path", F.col("uid").alias("from_uid"), F.col("other").alias("callee_name"), F.col("start_line").alias("line"))


def imports_of(found: DataFrame) -> DataFrame:
    return found.filter("rec = 'import'").select("file_path", F.col("other").alias("import_path"), F.col("name").alias("alias"), F.col("flag").alias("is_type"))


def failures_of(found: DataFrame) -> DataFrame:
    """file_path, error, message of the files that broke their extractor."""
    return found.filter("rec = 'failed'").select("file_path", F.col("name").alias("error"), F.col("other").alias("message"))


def owners_of(found: DataFrame) -> DataFrame:
    return found.filter("rec = 'owner'").select("file_path", "uid", F.col("other").alias("owner_uid"))
