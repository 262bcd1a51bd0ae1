"""Change feeds as streams: patches, embeddings and activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolve, search, store
from ..sources import extract
from ..sources.registry import TABLES


class GraphState:
    """Nodes, edges, references and owners as versions of Parquet folders; a stream's batch makes the next version.

    References stay as they are written in the files and are resolved anew each time, so edges are those of a full build. A batch is known by its number, so one that is run again after a failure writes the same version anew.
    """

    def __init__(self, spark: SparkSession, folder: str, nodes: str, edges: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {"nodes": nodes, "edges": edges, "references": TABLES["references"], "owners": TABLES["owners"]}

    def _path(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version}/{table}"

    def versions(self) -> list[int]:
        """Complete versions: a marker is written last."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/edges/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, table: str, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(self._path(known[-1], table))

    def _write(self, df: DataFrame, version: int, table: str) -> DataFrame:
        path = self._path(version, table)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schemas[table]).parquet(path)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """changes: path, status, text. Deleted and modified files go, added and modified ones are read anew."""
        version = batch + 1
        changed = changes.select(F.col("path").alias("file_path")).distinct()
        found = extract.records(changes.filter("status <> 'deleted'").select("path", "text")).persist()
        kept = lambda table, new: self.read(table, version).join(changed, "file_path", "left_anti").select(*new.columns).unionByName(new)
        fresh = store.upsert_nodes(self.read("nodes", version).limit(0), extract.nodes_of(found))
        nodes = self._write(kept("nodes", fresh), version, "nodes")
        references = self._write(kept("references", extract.references_of(found)), version, "references")
        owners = self._write(kept("owners", extract.owners_of(found)), version, "owners")
        edges = resolve.resolve(references, nodes).unionByName(resolve.member_edges(nodes, owners))
        columns = [c.split()[0] for c in self.schemas["edges"].split(", ")]
        self._write(store.named_edges(edges).select(*columns), version, "edges")  # the last, which makes the version complete
        found.unpersist()


def _trigger(every: str | None) -> dict:
    """All that is there, then an end; or a micro-batch every so often, for ever."""
    return {"processingTime": every} if every else {"availableNow": True}


def patches(changes: DataFrame, state: GraphState, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies a stream of changes by micro-batches: all available ones, then it ends, or every so often without end."""
    return changes.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def embeddings(nodes: DataFrame, cache: Callable[[], DataFrame], sink: str, checkpoint: str, provider=search.hashed, every: str | None = None) -> StreamingQuery:
    """Embeds a stream of nodes, a micro-batch at a time; texts in the cache cost no call. A source's options bound a batch's size.

    Rows whose call failed come with an error and no embedding.
    """

    def run(batch: DataFrame, number: int) -> None:
        hits, misses = search.split_by_cache(batch, cache())
        known = hits.select("uid", "text_hash", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("error"))
        known.unionByName(search.embed(misses, provider)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return nodes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts of events a window and type; a stream drops what comes later than late."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def last_states(updates: DataFrame) -> DataFrame:
    """Extension: uid, seen, kept (is the last update no deletion?) of a stream of (uid, at, deleted), last writer wins."""
    import pandas as pd

    def run(key, frames, state):
        at, gone = state.get if state.exists else (-1, True)
        seen = 0
        for frame in frames:
            seen += len(frame)
            row = frame.sort_values(["at", "deleted"]).iloc[-1]
            if int(row["at"]) >= at:
                at, gone = int(row["at"]), bool(row["deleted"])
        state.update((at, gone))
        yield pd.DataFrame({"uid": [key[0]], "at": [at], "kept": [not gone]})

    return updates.groupBy("uid").applyInPandasWithState(run, "uid string, at long, kept boolean", "at long, gone boolean", "update", "NoTimeout")
