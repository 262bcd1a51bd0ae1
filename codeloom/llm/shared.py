"""Places that driver and executors share, and small helpers for every operator of the subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach

#: ASCII white space, as a regular expression of both Java and Python.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key that may hold more than this share of a table's rows, and more than so many of them, is hot.
HOT_KEYS, HOT_ROWS = 20_000, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one (tests) gets one of our own.

    On a cluster a folder of the driver's machine is no shared one, so there the setting must be given.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="codeloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: the lineage ends there, and lost executors cost no recomputation.

    The stage that makes df keeps its tasks; after a shuffle, Spark sizes them by their bytes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_join(many: DataFrame, few: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """many inner-joined with few, which has one row for each key and in column n how many rows many has of it, at least about.

    Keys with over total / HOT_KEYS rows are hot. There are HOT_KEYS of them at most, so their rows of few are broadcast, a
    bounded number, and many's rows of such a key stay where they are. All others are shuffled, of which no key has more.
    few and many are read twice, so they should be written tables.
    """
    hot = few.filter(F.col(n) > max(HOT_ROWS, total // HOT_KEYS))
    rare = few.filter(F.col(n) <= max(HOT_ROWS, total // HOT_KEYS))
    there = F.broadcast(hot)
    cold = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return many.join(there, keys).unionByName(cold.join(rare, keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def docs_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run for runs of whole groups of rows with equal keys, which come sorted; a run holds a batch's rows, about.

    Groups must be of bounded size. Many small groups cost one call.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            cut = batch.num_rows
            while cut and all(batch.column(k)[cut - 1] == v for k, v in zip(keys, last, strict=True)):
                cut -= 1
            if not cut and held and all(held[-1].column(k)[held[-1].num_rows - 1] == v for k, v in zip(keys, last, strict=True)):
                held.append(batch)  # the group goes on
                continue
            whole = [*held, batch.slice(0, cut)]
            if sum(b.num_rows for b in whole):
                yield from run(pa.concat_batches(whole))
            held = [batch.slice(cut)]
        if held:
            yield from run(pa.concat_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where groups begin in a batch sorted by keys of integers, and its length."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def n_words(text: str = "text"):
    """Number of words between ASCII white space in a text column, natively; 0 for null."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D]", " ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, with lines under them until df has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
