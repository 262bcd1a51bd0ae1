"""Substring deduplication by a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. Of the GRAM-word sequences in a window, the one with the least hash
(the first of equals) is its anchor; it depends on the window's words alone, so equal windows have equal anchors at equal
places. Neighbouring windows mostly share an anchor: such a run is one fingerprint, about one for fourteen words, and no window
is without. A fingerprint has two independent hashes, of the anchor's words (fp) and of all words that the run's windows cover
(area). Fingerprints with both hashes (128 bits) equal are a class; a class has a place: one of its fingerprints' document and
windows.

The index holds immutable runs. A run has two tables, each bucketed and sorted by its key: heads, one row for each fp with its
class, if it has one only, and cells, all classes of the fps that have several, an fp of many classes spread over several cells.
So no key has more than a bounded number of rows, however often a passage comes. A batch takes these steps:

1. Its fingerprints are counted by fp, with partial sums before the shuffle, and written as a run.
2. The run's heads are merge-joined with those of every older run (all are bucketed and sorted alike, so nothing is shuffled).
   An fp seen once has no twin and goes; of the others the classes are fetched, by merge joins with the cells.
3. A class seen more than once has twins for all its windows, in the batch and, where the class was alone so far, in the history.
4. Only where an fp has different areas, one place of each class is verified on its text: its windows are compared by two
   hashes of the whole window. So large groups of copies count once here, and of the history only such places' texts are read.
5. Runs of one level are compacted into one of the next as soon as there are FAN.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import HOT_KEYS, fresh_path, keyed_join, shuffle_partitions, written

WINDOW, GRAM = 35, 8
#: Runs of a level that are compacted; classes of an fp in one cell, about.
FAN, CELL = 4, 1000
#: Texts are cut into parts of so many words that overlap by WINDOW - 1; a place within one fits into the key below.
PART = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_OTHER = np.uint64(0x8CB92BA72F3D8DD7)
#: Documents to verify whose keys (16 bytes) are broadcast, to read their texts before any shuffle; with more, texts shuffle.
MOST_PLACES = 1 << 20
#: A document and the first and last window of a run in it, in the upper and lower half of span.
PLACE = ("k1", "k2", "span")


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 (128 bits that stand for doc_id and text, nulls too), doc_id, text. Rows with equal ones are equal throughout."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), "doc_id", "text")


def _runs(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, in texts with word hashes h and bounds at: text, first window, last, anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    low = (words.shingles(h, gram) & ~_LOW) | np.arange(len(h) - gram + 1, dtype=np.uint64)
    reach, span = window - gram + 1, 1
    least = low
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    anchor = (least & _LOW).astype(np.int64)[:n]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    good = np.arange(n) + window <= at[text + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = good[first]
    first, last = first[keep], last[keep]
    return text[first], first, last, anchor[first]


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, word hashes, bounds, place in the text of each text's first word here), long texts in overlapping parts."""
    for first, h, at in words.hashed(column):
        if len(h) <= PART:
            yield first, h, at, np.zeros(len(at) - 1, np.int64)
        else:
            for k in range(len(at) - 1):
                for a in range(int(at[k]), max(int(at[k]) + 1, int(at[k + 1]) - WINDOW + 1), PART):
                    part = h[a : min(int(at[k + 1]), a + PART + WINDOW - 1)]
                    yield first + k, part, np.array([0, len(part)]), np.array([a - at[k]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp, area and place (see PLACE; windows by their first words) of all windows of docs (k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, at, base in _parts(batch.column("text")):
                text, lo, hi, anchor = _runs(h, at, WINDOW, GRAM)
                if len(text):
                    fp = words.spans(*words.prefix(h), anchor, anchor + GRAM)
                    area = words.spans(*words.prefix(words.mix(h ^ _OTHER)), lo, hi + WINDOW)
                    begin = base[text] - at[text]
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(area.view(np.int64)), *(batch.column(k).take(pa.array(first + text)) for k in ("k1", "k2")), pa.array(((lo + begin) << 32) + hi + begin)], ["fp", "area", *PLACE])

    return docs.select("k1", "k2", "text").mapInArrow(run, "fp long, area long, k1 long, k2 long, span long")


def _first(*columns: str, names: tuple = PLACE) -> list[Column]:
    """The columns of the first row that has them, as names. They are null together, so all are of one row."""
    return [F.first(c, ignorenulls=True).alias(n) for c, n in zip(columns or names, names, strict=True)]


def _cell(parts: Column) -> Column:
    return F.xxhash64("fp", F.pmod("area", parts))


class FingerprintIndex:
    """The runs, as tables in the session's shared folder; see the module's text. A new index is empty."""

    OLD = ("o1", "o2", "ospan")

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN) -> None:
        self.spark, self.buckets, self.fan = spark, buckets or shuffle_partitions(spark), fan
        self.path = fresh_path(spark, "fingerprints")
        self.runs: list[tuple[int, str]] = []  # level, name

    def _save(self, df: DataFrame, name: str, key: str) -> None:
        df.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)

    def _run(self, rows: DataFrame, total: int, level: int) -> str:
        """Writes rows (fp, area, n, place), of which there are total, as a run. Rows with both hashes equal add up."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        heads = rows.groupBy("fp").agg(F.sum("n").alias("n"), F.min("area").alias("area"), F.max("area").alias("last"), *_first())
        self._save(heads, f"{name}_heads", "fp")
        several = self.spark.table(f"{name}_heads").filter("area < last").select("fp", F.col("n").alias("rows"))
        classes = keyed_join(rows, several, ["fp"], total, "rows").groupBy("fp", "area").agg(F.sum("n").alias("n"), *_first())
        classes = written(classes, "fingerprint-classes")
        # Of fps with very many classes there are HOT_KEYS at most; they are spread over several cells.
        parts = F.ceil(F.count(F.lit(1)) / max(CELL, classes.count() // HOT_KEYS)).alias("parts")
        wide = classes.groupBy("fp").agg(parts).filter("parts > 1")
        wide.write.option("path", f"{self.path}/{name}_wide").saveAsTable(f"{name}_wide")
        cells = classes.join(F.broadcast(self.spark.table(f"{name}_wide")), "fp", "left").withColumn("cell", _cell(F.coalesce("parts", F.lit(1))))
        self._save(cells.select("cell", "fp", "area", "n", *PLACE), f"{name}_cells", "cell")
        self.runs.append((level, name))
        return name

    def _classes(self, name: str, heads: DataFrame) -> DataFrame:
        """fp, area, n, place and mixed of the classes of a run whose fps are in heads (the run's, with the column mixed)."""
        alone = heads.filter("area = last").select("fp", "area", "n", *PLACE, "mixed")
        wide = F.broadcast(self.spark.table(f"{name}_wide"))
        several = heads.filter("area < last").select("fp", "mixed").join(wide, "fp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        several = several.select("fp", "mixed", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("area"))
        several = several.select(_cell(F.col("parts")).alias("cell"), F.col("fp").alias("of"), "mixed")
        found = self.spark.table(f"{name}_cells").join(several, "cell").filter("fp = of")
        return alone.unionByName(found.select("fp", "area", "n", *PLACE, "mixed"))

    def _drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in (f"{name}_heads", f"{name}_cells", f"{name}_wide"):
            self.spark.sql(f"DROP TABLE {table}")
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def add(self, members: DataFrame) -> DataFrame:
        """Adds a batch by its fingerprints; gives the classes that have twins or must be verified, written.

        fp, area, n (fingerprints of the batch and the history), own (of the batch), place (one of the batch's, null without
        one), OLD (one of the history's) and mixed (has fp several areas?).
        """
        older = [name for _, name in self.runs]
        name = self._run(members.withColumn("n", F.lit(1).cast("long")), members.count(), 0)
        mine = self.spark.table(f"{name}_heads")
        known = mine.select("fp", "n", F.col("area").alias("low"), F.col("last").alias("high"))
        for other in older:
            theirs = self.spark.table(f"{other}_heads").select("fp", F.col("n").alias("m"), F.col("area").alias("a"), F.col("last").alias("z"))
            known = known.join(theirs, "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.least("low", "a").alias("low"), F.greatest("high", "z").alias("high"))
        known = known.filter("n > 1").select("fp", (F.col("low") < F.col("high")).alias("mixed"))
        none = lambda names: [F.lit(None).cast("long").alias(c) for c in names]
        here = self._classes(name, mine.join(known, "fp")).select("fp", "area", "n", "mixed", F.col("n").alias("own"), *PLACE, *none(self.OLD))
        for other in older:
            there = self._classes(other, self.spark.table(f"{other}_heads").join(known, "fp"))
            renamed = [F.col(c).alias(o) for c, o in zip(PLACE, self.OLD, strict=True)]
            here = here.unionByName(there.select("fp", "area", "n", "mixed", F.lit(0).cast("long").alias("own"), *none(PLACE), *renamed))
        seen = here.groupBy("fp", "area").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.first("mixed").alias("mixed"), *_first(), *_first(names=self.OLD))
        found = written(seen.filter("n > 1 OR mixed"), "fingerprint-twins")
        self._compact()
        return found

    def _compact(self) -> None:
        """Merges the runs of a level, where there are enough, into one of the next; the old ones go."""
        while True:
            level = next((a for a in sorted({a for a, _ in self.runs}) if sum(b == a for b, _ in self.runs) >= self.fan), None)
            if level is None:
                return
            old = [name for a, name in self.runs if a == level]
            every = [self._classes(name, self.spark.table(f"{name}_heads").withColumn("mixed", F.lit(False))) for name in old]
            both = every[0]
            for other in every[1:]:
                both = both.unionByName(other)
            self.runs = [r for r in self.runs if r[0] != level]
            self._run(both.drop("mixed"), both.count(), level + 1)
            for name in old:
                self._drop(name)

    def close(self) -> None:
        """Drops all runs."""
        for _, name in self.runs:
            self._drop(name)
        self.runs = []


def _window_hashes(docs: DataFrame) -> DataFrame:
    """k1, k2, w1, w2, at of the windows in spans (array<struct<lo, hi>>) of docs (k1, k2, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = batch.column("spans")
            offsets = spans.offsets.to_numpy()
            los, his = (spans.values.field(k).to_numpy() for k in (0, 1))
            for first, h, at in words.hashed(batch.column("text")):
                which = [(k, lo, hi) for k in range(len(at) - 1) for lo, hi in zip(los[offsets[first + k] : offsets[first + k + 1]], his[offsets[first + k] : offsets[first + k + 1]], strict=True)]
                if not which:
                    continue
                k, lo, hi = np.array(which, np.int64).T
                size = hi - lo + 1
                start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                text = np.repeat(k, size)
                a = start + at[text]
                one = words.spans(*words.prefix(h), a, a + WINDOW)
                two = words.spans(*words.prefix(words.mix(h ^ _OTHER)), a, a + WINDOW)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first + text)) for c in ("k1", "k2")), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(start.astype(np.int32))], ["k1", "k2", "w1", "w2", "at"])

    return docs.select("k1", "k2", "text", "spans").mapInArrow(run, "k1 long, k2 long, w1 long, w2 long, at int")


def _windows(df: DataFrame) -> DataFrame:
    """k1, k2, lo, hi of places."""
    return df.select("k1", "k2", F.shiftright("span", 32).cast("int").alias("lo"), F.col("span").bitwiseAND((1 << 32) - 1).cast("int").alias("hi"))


def _spans(df: DataFrame) -> DataFrame:
    """k1, k2 and the distinct spans of a document, as an array; of a size in proportion to the document's own text at most."""
    return df.select("k1", "k2", F.struct("lo", "hi").alias("span")).distinct().groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def add_batch(index: FingerprintIndex, batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """k1, k2, lo, hi: runs of windows whose twins a batch brings, in the batch and in what the index held before.

    batch and corpus are keyed(); corpus holds the texts of all batches so far, this one's too, of which only those that must
    be verified are read beyond their keys. Whatever an earlier batch's call gave stays true, so the spans of all calls together
    are those of all windows with a twin.
    """
    members = written(fingerprints(batch), "fingerprints")
    found = index.add(members)
    old = [F.col(o).alias(c) for c, o in zip(PLACE, index.OLD, strict=True)]
    # Classes with one fingerprint in the batch have its place, those of more are looked up; so with one in the history.
    alone = found.filter("n > 1 AND own = 1").select(*PLACE)
    before = found.filter("own > 0 AND n - own = 1").select(*old)
    copies = keyed_join(members, found.filter("own > 1").select("fp", "area", F.col("own").alias("n")), ["fp", "area"], members.count()).select(*PLACE)
    there = [F.coalesce(c, o).alias(c) for c, o in zip(PLACE, index.OLD, strict=True)]
    open_ = written(_spans(_windows(found.filter("mixed").select(*there))), "fingerprint-places")
    if open_.count() <= MOST_PLACES:
        corpus = corpus.join(F.broadcast(open_.select("k1", "k2")), ["k1", "k2"], "left_semi")
    windows = written(_window_hashes(corpus.join(open_, ["k1", "k2"]).dropDuplicates(["k1", "k2"])), "fingerprint-windows")
    twice = written(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "fingerprint-windows")
    single = keyed_join(windows, twice, ["w1", "w2"], windows.count()).select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return _windows(alone.unionByName(before).unionByName(copies)).unionByName(single)


def removed(docs: DataFrame, spans: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words left, joined by one space) of every row of docs.

    docs is keyed(). What goes are the words that the windows in spans cover.
    """
    joined = docs.join(_spans(spans), ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            column = batch.column("spans")
            offsets, (los, his) = column.offsets.to_numpy(), (column.values.field(k).to_numpy() for k in (0, 1))
            filled = column.is_valid().to_numpy(zero_copy_only=False)
            out: list[list] = [[] for _ in range(3 + texts)]
            for k, text in enumerate(batch.column("text")):
                own = (text.as_py() or "").encode().split()
                n, gone = len(own), 0
                if filled[k]:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, los[offsets[k] : offsets[k + 1]], 1)
                    np.add.at(edge, his[offsets[k] : offsets[k + 1]] + WINDOW, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    own = [w for w, good in zip(own, keep.tolist(), strict=True) if good]
                    gone = n - len(own)
                kept = b" ".join(own)
                for values, value in zip(out, (n, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else ""), strict=False):
                    values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())[: 3 + texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def deduplicate(docs: DataFrame, batches: int = 2, texts: bool = True) -> DataFrame:
    """removed() for docs, indexed in so many batches, where every window of docs that also starts elsewhere goes.

    Null and empty texts have no words and keep nothing. Null doc_ids are like others; rows that repeat a doc_id are documents
    of their own, and equal rows repeat each other's windows. Texts of any length are taken whole. An empty table gives no rows.
    Other columns don't matter.
    """
    every = keyed(docs)
    index = FingerprintIndex(docs.sparkSession)
    spans = None
    for k in range(batches):
        new = add_batch(index, every.filter(F.pmod("k1", F.lit(batches)) == k), every.filter(F.pmod("k1", F.lit(batches)) <= k))
        spans = new if spans is None else spans.unionByName(new)
    index.close()
    return removed(every, spans, texts)
