"""MinHash near-deduplication with odd sketches.

A document's set are the distinct shingles of its words (A-Z as a-z); fewer words than a shingle has make one, no words an
empty set, linked with nothing. Documents are linked at a Jaccard similarity of num / den or more. A Likeness holds the
words of a shingle, the similarity and the bands: NEAR is the query's (three words, 0.85), STAGE the pipeline's (five, 0.8).

1. Documents with equal sets are one class, known by a 128-bit digest of the set; its least doc_id stands for it.
2. Bands of ROWS MinHash values make candidates. At 0.85 a pair shares none of 36 bands with a chance of
   (1 - 0.85**5)**36 = 7e-10, at 0.8 none of 54 with one of (1 - 0.8**5)**54 = 5e-10.
3. The MinHash samples of a set, folded into a parity bitmap, are its odd sketch. The XOR of two sketches has as many bits as
   the samples differ in, but for collisions; a pair whose count of bits lies beyond all that a linked pair may have (chance
   under 1e-9) is no candidate.
4. Candidates are confirmed on their full sets.

First each bucket's members meet its least member only. The components of these links join most groups, however large.
Buckets that still hold different components then compare the sketches of all their members, in blocks; the texts of members
that are near one of another component follow, and pairs of different components are confirmed by products of incidence
matrices within a task, so no link between different texts is lost; only links that join components leave the task, at most as
many as it has members.

Every join whose key a large group of copies may share (digest, bucket, hub, component) goes through keyed_join, which leaves
the rows of hot keys where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import bounds, by_group, keyed_join, written

SHINGLE, NUM, DEN = 3, 85, 100
BANDS, ROWS = 36, 5
BITS = 512
#: Members of a bucket that are compared at once in the second step; members that meet one document in a task of the first.
BLOCK, GROUP = 1024, 256

_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


@cache
def _seed(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(1, 2**32, (2, n), dtype=np.uint32) | np.uint32(1)


@cache
def _most_bits(n: int, p: float) -> int:
    """Bits in which the sketches of n samples of a linked pair differ but with a chance under 1e-9.

    The number of samples that differ is binomial; each differing sample flips two bits at most, whatever collides.
    """
    log = np.cumsum(np.log(np.arange(1, n + 1)))
    choose = lambda k: log[n - 1] - (log[k - 1] if k else 0) - (log[n - k - 1] if k < n else 0)
    chance = np.array([np.exp(choose(k) + k * np.log(p) + (n - k) * np.log(1 - p)) for k in range(n + 1)])
    tail = np.cumsum(chance[::-1])[::-1]
    return 2 * int(np.flatnonzero(tail < 1e-9)[0])


@dataclass(frozen=True)
class Likeness:
    """What links two documents, and the bands that find such pairs."""

    shingle: int = SHINGLE
    num: int = NUM
    den: int = DEN
    bands: int = BANDS

    @property
    def samples(self) -> int:
        return self.bands * ROWS

    @property
    def most_bits(self) -> int:
        return _most_bits(self.samples, 1 - self.num / self.den)


NEAR, STAGE = Likeness(), Likeness(5, 80, 100, 54)
MOST_BITS = NEAR.most_bits


def estimate(bits: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of bits in which two odd sketches differ."""
    full = np.minimum(2 * np.asarray(bits, float) / BITS, 1 - 1e-9)
    return np.clip(1 + BITS / (4 * BANDS * ROWS) * np.log(1 - full), 0, 1)


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, its sorted distinct shingles)."""
    for first, h, at in words.hashed(column, lower=True):
        grams = words.shingles(h, shingle)
        for k in range(len(at) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= shingle:
                yield first + k, np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield first + k, words.shingles(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield first + k, h[:0]


def min_hashes(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n MinHash values of a set of at least one shingle."""
    out, seed = np.full(n, 2**32 - 1, np.uint32), _seed(n)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(shingles), 512):
        v = low[a : a + 512] * seed[0][:, None]
        v ^= high[a : a + 512]
        v *= seed[1][:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def odd_sketch(mins: np.ndarray) -> bytes:
    """Parity bitmap of the samples (place, value)."""
    places = np.arange(1, len(mins) + 1, dtype=np.uint64)
    bit = (words.mix(mins.astype(np.uint64) + (places << np.uint64(32))) % np.uint64(BITS)).astype(int)
    return np.packbits(np.bincount(bit, minlength=BITS) % 2 == 1).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a with each row of b; rows are sketches as 16-bit words."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += _POP[a[:, k][:, None] ^ b[:, k][None]]
    return out


def linked(a: np.ndarray, b: np.ndarray, like: Likeness = NEAR) -> bool:
    if like.num * max(len(a), len(b)) > like.den * min(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return like.den * both >= like.num * (len(a) + len(b) - both)


def signatures(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, digest, bands, sketch of each row of docs; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            digest, bands, sketch = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for k, s in sets_of(batch.column("text"), like.shingle):
                n[k] = len(s)
                if len(s):
                    mins = min_hashes(s, like.samples)
                    folded = words.shingles(mins.astype(np.uint64), ROWS)[::ROWS]
                    digest[k] = xxhash.xxh3_128_digest(s.tobytes())
                    bands[k] = words.mix(folded + np.arange(like.bands, dtype=np.uint64)).view(np.int64)
                    sketch[k] = odd_sketch(mins)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "h", "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {kind}, h long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _near(pairs: DataFrame, hubs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """The (a, b) of pairs that sizes and odd sketches allow. hubs: a, n (pairs that have it)."""
    own = classes.select("cid", "n_shingles", "sketch")
    few = written(hubs.join(own.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a"), "minhash-hubs")
    x = keyed_join(pairs, few, ["a"], pairs.count())
    x = x.join(own.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    x = x.filter(f"{like.num} * greatest(na, nb) <= {like.den} * least(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                good = _POP[a ^ b].sum(axis=1) <= like.most_bits
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return x.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The (a, b) of pairs whose full sets are linked.

    Pairs that share a are confirmed together, some GROUP at a time: a's text goes to a task once for these.
    """
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    count = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts), "minhash-parts")
    members = keyed_join(pairs, count, ["a"], pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("cid"))
    hubs = count.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("cid"))
    needed = members.unionByName(hubs).join(texts, "cid").select("a", "part", "cid", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, keep, sets, hub = bounds(batch, ["a", "part"]), [], [], None
        a, own = (batch.column(c).to_numpy() for c in ("a", "cid"))
        every = (s for _, s in sets_of(batch.column("text"), like.shingle))
        for g in range(len(at) - 1):
            rows = range(at[g], at[g + 1])
            sets = [next(every) for _ in rows]
            hub = next((s for k, s in zip(rows, sets, strict=True) if own[k] == a[k]), None)
            keep += [k for k, s in zip(rows, sets, strict=True) if hub is not None and own[k] != a[k] and linked(hub, s, like)]
        yield batch.select(["a", "cid"]).take(pa.array(keep, pa.int64())).rename_columns(["a", "b"])

    return by_group(needed, ["a", "part"], run, "a long, b long")


def joins(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right: products of incidence matrices, some columns a time."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = seen > 1
    number = np.cumsum(common) - 1
    use = common[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for a in range(0, int(common.sum()), 2048):
        x, y = np.searchsorted(column, (a, a + 2048))
        part = np.zeros((len(left) + len(right), 2048), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        out += (part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return out


def forest(ids: np.ndarray, comps: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between rows p and q, as few as join the same components."""
    top: dict = {}

    def root(c: object) -> object:
        while c in top:
            c = top[c]
        return c

    out = []
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        x, y = root(comps[i]), root(comps[j])
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _across(rows: DataFrame, classes: DataFrame, comp: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between different components among the members of a bucket, confirmed on full sets. rows: h, cid.

    Members of a bucket with several components meet in pairs of blocks, first by their sketches. Those that sizes and sketches
    let be near one of another component meet again with their texts, and of links as few leave a task as join the same
    components.
    """
    placed = rows.join(comp, rows["cid"] == comp["node"], "left").select("h", "cid", F.coalesce("component", "cid").alias("c"))
    placed = written(placed, "minhash-placed")
    split = placed.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("n")).filter("c1 <> c2")
    split = written(split.select("h", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "minhash-split")
    inside = keyed_join(placed, split, ["h"], placed.count()).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # A member goes to each pair of blocks that holds its own.
    dealt = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "c")

    def near(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the left and right members of each group that are near one of another component, and which are."""
        at = bounds(batch, ["h", "i", "j"])
        comps, mine, low, high, n = (batch.column(k).to_numpy() for k in ("c", "mine", "i", "j", "n_shingles"))
        bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        for g in range(len(at) - 1):
            own = np.arange(at[g], at[g + 1])
            left, right = own[mine[own] == low[own[0]]], own[mine[own] == high[own[0]]]
            if len(left) and len(right):
                na, nb = n[left][:, None], n[right][None]
                good = (comps[left][:, None] != comps[right][None]) & (like.num * np.maximum(na, nb) <= like.den * np.minimum(na, nb))
                good &= apart(bits[left], bits[right]) <= like.most_bits
                left, right = left[good.any(axis=1)], right[good.any(axis=0)]
                if len(left):
                    yield left, right

    names = ["h", "i", "j", "mine", "cid", "c"]

    def by_sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        some = [np.union1d(left, right) for left, right in near(batch)]
        yield batch.select(names).take(pa.array(np.concatenate(some) if some else np.zeros(0, np.int64)))

    def by_text(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, comps, texts, out = batch.column("cid").to_numpy(), batch.column("c").to_numpy(), batch.column("text"), []
        for left, right in near(batch):
            some = np.union1d(left, right)
            sets = dict(zip(some.tolist(), (s for _, s in sets_of(texts.take(pa.array(some)), like.shingle)), strict=True))
            a, b = [sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()]
            na, nb = (np.array([len(s) for s in x]) for x in (a, b))
            both = joins(a, b)
            good = (like.den * both >= like.num * (na[:, None] + nb[None] - both)) & (comps[left][:, None] != comps[right][None])
            p, q = np.nonzero(good)
            out += forest(ids, comps, left[p], right[q])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    own = classes.select("cid", "n_shingles", "sketch")
    keys, kinds = ["h", "i", "j"], "h long, i int, j int, mine int, cid long, c long"
    some = by_group(dealt.join(own, "cid").select(*names, "n_shingles", "sketch"), keys, by_sketch, kinds)
    full = written(some, "minhash-near").join(own, "cid").join(texts, "cid").select(*names, "n_shingles", "sketch", "text")
    return by_group(full, keys, by_text, "a long, b long").distinct()


def _labelled(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id of every row of docs."""
    sig = written(signatures(docs, like).withColumn("row", F.monotonically_increasing_id()), "minhash-signatures")
    sets = sig.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # Classes of equal sets, numbered; the first row of the least doc_id stands for each.
    least = sets.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    least = written(least.withColumn("cid", F.monotonically_increasing_id()), "minhash-digests")
    classes = written(sig.join(least.select("row", "cid"), "row").select("cid", "doc_id", "h", "n_shingles", "bands", "sketch"), "minhash-classes")
    rows = classes.select(F.explode("bands").alias("h"), "cid")
    buckets = rows.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z").select("h", "a", "n")
    rows = written(keyed_join(rows, written(buckets, "minhash-buckets"), ["h"], like.bands * classes.count()).select("h", "a", "cid"), "minhash-members")
    # Only documents that share a bucket are read from here on.
    some = classes.join(rows.select("cid").distinct(), "cid").select("doc_id", "h", "cid")
    texts = written(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(some, ["doc_id", "h"]).select("cid", "text").dropDuplicates(["cid"]), "minhash-texts")
    pairs = written(rows.filter("cid <> a").select("a", F.col("cid").alias("b")).distinct(), "minhash-pairs")
    pairs = written(_near(pairs, pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), classes, like), "minhash-pairs")
    comp = components(written(_confirmed(pairs, texts, like), "minhash-links"))
    placed = classes.select("cid", "doc_id").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "doc_id", F.coalesce("component", "cid").alias("c"))
    more = written(_across(rows.select("h", "cid"), classes, comp, texts, like), "minhash-links")
    if not more.isEmpty():
        # These links join components, so their graph is that of components.
        ends = [comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in ("a", "b")]
        over = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        top = components(over)
        placed = placed.join(top, F.col("c") == F.col("node"), "left").select("cid", "doc_id", F.coalesce("component", "c").alias("c"))
    placed = written(placed, "minhash-components")
    label = written(placed.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "minhash-labels")
    of_class = keyed_join(placed, label, ["c"], placed.count()).select("cid", "component_id")
    of_set = written(least.select("digest", "n", "cid").join(of_class, "cid").select("digest", "n", "component_id"), "minhash-labels")
    some = keyed_join(sets, of_set, ["digest"], sets.count()).select("doc_id", "h", "n_shingles", "component_id")
    rest = sig.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(rest)


def link(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    component_id is the least doc_id reachable by links; kept is doc_id = component_id. Null and empty texts have no shingles
    and stay alone. Rows with a null doc_id are in no class: component_id is null and kept true. Rows that repeat a doc_id are
    documents of their own, each with its text's links; equal rows are equal. Of equal sets the least doc_id counts. Texts of
    any length are taken whole. An empty table gives no rows. Other columns don't matter.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _labelled(docs, like).select("doc_id", "n_shingles", "component_id", kept)


def kept_rows(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """The rows of docs that link() keeps, with all their columns. Equal rows of a kept doc_id all stay."""
    gone = _labelled(docs, like).filter("doc_id <> component_id").select("doc_id", "h").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["h"]), "left_anti").select(*(docs[c] for c in docs.columns))
