"""The registry of indexed repositories, and their tables as Parquet folders."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import small_text

SCHEMA = "name string, path string, indexed_at string"
TABLES = {
    "nodes": "uid string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, package_path string, cluster_id string",
    "edges": "id string, from_uid string, to_uid string, type string, confidence double",
    "clusters": "community string, label string, cohesion double, members array<string>",
    "process_steps": "process_id string, name string, entry_uid string, symbol_uid string, depth int, step_index bigint, process_type string",
    "postings": "term string, uid string, tfidf double",
    "embeddings": "uid string, text_hash string, embedding array<float>",
    "index_meta": "key string, value string",
    "files": "path string, text string, hash string",
    "references": "file_path string, from_uid string, callee_name string, line int",
    "owners": "file_path string, uid string, owner_uid string",
    "failures": "file_path string, error string, message string",
}


class Registry:
    """Names, roots and times of repositories, in a JSON file below a folder that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def all(self) -> list[dict]:
        return json.loads(small_text(self.spark, f"{self.folder}/registry.json") or "[]")

    def _save(self, rows: list[dict]) -> None:
        fs, path = self._fs(f"{self.folder}/registry.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(sorted(rows, key=lambda r: r["name"]), indent=1).encode()))
        out.close()

    def register(self, name: str, path: str) -> None:
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        self._save([*(r for r in self.all() if r["name"] != name), {"name": name, "path": path, "indexed_at": now}])

    def unregister(self, name: str) -> bool:
        """Takes a repository off the list and deletes its tables."""
        left = [r for r in self.all() if r["name"] != name]
        if len(left) == len(self.all()):
            return False
        self._save(left)
        fs, path = self._fs(f"{self.folder}/{name}")
        fs.delete(path, True)
        return True

    def get(self, name: str) -> dict | None:
        return next((r for r in self.all() if r["name"] == name), None)

    def find(self, path: str) -> dict | None:
        """The repository whose root holds a path; of several the innermost."""
        inside = [r for r in self.all() if path == r["path"] or path.startswith(r["path"].rstrip("/") + "/")]
        return max(inside, key=lambda r: len(r["path"]), default=None)

    def resolve(self, name: str = "") -> str:
        """The name itself, else that of the only repository, else nothing."""
        rows = self.all()
        return name or (rows[0]["name"] if len(rows) == 1 else "")

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([(r["name"], r["path"], r["indexed_at"]) for r in self.all()], SCHEMA)

    def _current(self, name: str, table: str) -> str | None:
        """The folder of a table's newest complete version."""
        at = f"{self.folder}/{name}/{table}"
        version = small_text(self.spark, f"{at}/CURRENT")
        return f"{at}/{version}" if version else None

    def read(self, name: str, table: str) -> DataFrame:
        at = self._current(name, table)
        if not at:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(at)

    def write(self, name: str, table: str, df: DataFrame) -> None:
        """Replaces a table: a new version is written, then a file that names it is moved into place.

        So df may read what it replaces, a reader or a crash in between finds the old version, and of two writers the last counts.
        The version before stays for those who read it; older ones go.
        """
        shaped = df.select(*(F.col(c.split()[0]).cast(c.split(" ", 1)[1]) for c in TABLES[table].split(", ")))
        at, before = f"{self.folder}/{name}/{table}", self._current(name, table)
        version = f"v{uuid.uuid4().hex}"
        shaped.write.parquet(f"{at}/{version}")
        fs, new = self._fs(f"{at}/CURRENT.{version}")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, self._fs(f"{at}/CURRENT")[1], options)
        for s in fs.listStatus(self._fs(at)[1]):
            folder = s.getPath().getName()
            if s.isDirectory() and folder != version and not (before and before.endswith(folder)):
                fs.delete(s.getPath(), True)
