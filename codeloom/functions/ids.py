"""Identities: truncated SHA-256 of the parts that make a symbol, an edge or a process what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def node_uid(file_path: Column | str, name: Column | str, kind: Column | str) -> Column:
    """name is qualified by its owner for methods of most languages."""
    return _short(F.concat_ws(":", _c(file_path), _c(name), _c(kind)))


def edge_id(from_uid: Column | str, to_uid: Column | str, kind: Column | str) -> Column:
    return _short(F.concat_ws("|", _c(from_uid), _c(to_uid), _c(kind)))


def process_id(entry_uid: Column | str) -> Column:
    return F.concat(F.lit("proc_"), _short(F.concat(F.lit("process:"), _c(entry_uid))))


def text_hash(text: Column | str) -> Column:
    return F.sha2(_c(text).cast("binary"), 256)


def short_commit(commit: Column | str) -> Column:
    return F.left(_c(commit), F.lit(8))
