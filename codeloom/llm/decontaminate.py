"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters and digits, A-Z as a-z. A window of a document has as many words as the item (a shorter document is
one window). Two multisets of five-word shingles compare by weighted Jaccard: the sum of the lesser counts over the sum of the
greater ones. An item with fewer words is one shingle.

A window reaches the threshold only if enough of its shingles occur in items at all; that bound, which loses nothing, selects
windows by a prefix sum. Their SimHash has BITS bits; each of several equal shingles is a feature of its own (shingle and which
of the equal ones in the window), so that cosines follow the weighted Jaccard similarity. It is looked up in tables over its
bytes: a table has, for each value of a byte, the items whose byte differs in NEAR bits or fewer. Of two fingerprints within
RADIUS bits, AGREE bytes at least are that near, for otherwise BYTES - AGREE + 1 bytes or more would differ in NEAR + 1 bits or
more, which is over RADIUS; so items with fewer such bytes are left out and none within the radius is. Of random fingerprints
1.2 % pass. Those within the radius are verified on their exact shingle counts. At similarity 0.8 windows of equal size have a
cosine of 8/9, so 38.8 of 256 bits differ on average; over 68 do with a chance of 8.5e-7.

The benchmark is worked through in chunks of bounded size, each sent to the executors with the code; a larger benchmark takes
more passes over the documents, never a larger broadcast, and the driver holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import written

SHINGLE = 5
THRESHOLD = 0.8
BITS, RADIUS = 256, 68
BYTES, NEAR = BITS // 8, 2
#: Bytes that differ in NEAR bits or fewer, at least, of two fingerprints within the radius.
AGREE = BYTES - RADIUS // (NEAR + 1)
#: Of the benchmark, so much goes to the executors at once.
CHUNK_ITEMS, CHUNK_BYTES = 10_000, 16 << 20
_SKETCH = 1 << 22
#: Windows or shingles whose sums of bits are one matrix.
PART = 4096

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_IS_NEAR = (_POP[np.arange(256)[:, None] ^ np.arange(256)[None]] <= NEAR).astype(np.uint8)


def _simhash(signs: np.ndarray) -> np.ndarray:
    """Fingerprints, as bytes, of rows of BITS sums."""
    return np.packbits(signs > 0, axis=-1)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS ones and minus ones for each shingle."""
    parts = np.stack([words.mix(shingles + np.uint64(k * 0xA24BAED4963EE407 % 2**64)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(parts.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _numbered(shingles: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Features by position: that which a window of own shingles gains when its end passes a shingle, and that which it loses
    when its start does. A feature is a shingle and how many equal ones the window has besides; the first is the shingle."""
    n = len(shingles)
    group = np.unique(shingles, return_inverse=True)[1].astype(np.int64)
    if not n or group.max() + 1 == n:
        return shingles, shingles
    at = np.arange(n)
    key = group * n + at
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order] = at
    key = key[order]
    gained = rank - np.searchsorted(key, group * n + np.maximum(at - own + 1, 0))
    lost = np.searchsorted(key, group * n + np.minimum(at + own, n)) - rank - 1
    return tuple(np.where(k > 0, words.mix(shingles + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), shingles) for k in (gained, lost))


class Matcher:
    """Finds the items of one chunk in texts."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD) -> None:
        self.t = threshold
        self.items = []  # (id, words, shingle size, distinct shingles, counts)
        for first, h, at in words.hashed(pa.array(texts, pa.large_string()), lower=True, marks=True):
            for k in range(len(at) - 1):
                own = h[at[k] : at[k + 1]]
                if len(own):
                    size = min(SHINGLE, len(own))
                    sh = words.shingles(own, size)
                    self.items.append((ids[first + k], len(own), size, *np.unique(sh, return_counts=True), _simhash(sum(_signs(p).sum(axis=0) for p in np.array_split(_numbered(sh, len(sh))[0], len(sh) // PART + 1)))))
        length = np.array([x[1] for x in self.items], np.int64)
        self.kinds = {}  # shingle size -> (sorted shingles, their items' lengths)
        for size in {x[2] for x in self.items}:
            pairs = np.unique(np.array([(s, x[1]) for x in self.items if x[2] == size for s in x[3].tolist()], np.uint64), axis=0)
            sketch = np.zeros(_SKETCH, bool)
            sketch[(pairs[:, 0] & np.uint64(_SKETCH - 1)).astype(np.int64)] = True
            self.kinds[size] = (pairs[:, 0], pairs[:, 1].astype(np.int64), np.unique(pairs[:, 0]), sketch)
        self.tables = {}  # length -> (numbers of its items, their fingerprints, for each byte and value which items are near)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            prints = np.stack([self.items[k][5] for k in own])
            self.tables[n] = (own, prints, np.stack([_IS_NEAR[:, prints[:, b]] for b in range(BYTES)]))

    def _within(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (fingerprint's number, item's number) within the radius, for items of a length."""
        own, theirs, near = self.tables[length]
        found = []
        step = max(1, (1 << 22) // len(own))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            agree = np.zeros((len(part), len(own)), np.uint8)
            for b in range(BYTES):
                agree += near[b][part[:, b]]
            w, i = np.nonzero(agree >= AGREE)
            good = _POP[part[w] ^ theirs[i]].sum(axis=1) <= RADIUS
            found.append((w[good] + a, own[i[good]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def match(self, column: pa.Array) -> Iterator[tuple[int, object, int, float]]:
        """(text's number, item's id, first word of its best window, similarity), once per text and item."""
        for first, h, at in words.hashed(column, lower=True, marks=True):
            best: dict = {}
            for size, (values, lengths, distinct, sketch) in self.kinds.items():
                sh = words.shingles(h, size)
                maybe = np.flatnonzero(sketch[(sh & np.uint64(_SKETCH - 1)).astype(np.int64)])
                maybe = maybe[np.isin(sh[maybe], distinct)]
                doc = np.searchsorted(at, maybe, "right") - 1
                maybe = maybe[maybe + size <= at[doc + 1]] if len(maybe) else maybe
                doc = np.searchsorted(at, maybe, "right") - 1
                for d in np.unique(doc):
                    hits, a, b = maybe[doc == d], at[d], at[d + 1]
                    lo, hi = np.searchsorted(values, sh[hits], "left"), np.searchsorted(values, sh[hits], "right")
                    for length in np.unique(np.concatenate([lengths[x:y] for x, y in zip(lo, hi, strict=True)])):
                        self._windows(best, int(first + d), sh[a : b - size + 1], hits - a, int(length), size, int(b - a))
            for (d, item), (neg, start) in sorted(best.items()):
                yield d, self.items[item][0], start, -neg

    def _windows(self, best: dict, doc: int, sh: np.ndarray, hits: np.ndarray, length: int, size: int, n_words: int) -> None:
        n, own = length - size + 1, min(length, n_words) - size + 1  # shingles of item and window
        need = int(np.ceil(self.t * (n + own) / (1 + self.t) - 1e-9))
        if own < need:
            return
        # How many of its shingles each window has in items, by sums over the text up to a place.
        n_windows = len(sh) - own + 1
        if n_windows <= 0:
            return
        upto = np.zeros(len(sh) + 1, np.int32)
        upto[hits + 1] = 1
        np.cumsum(upto, out=upto)
        starts = np.flatnonzero(upto[own:] - upto[:n_windows] >= need)
        # Runs of windows that go on, PART at most.
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for part in (run[k : k + PART] for k in range(0, len(run), PART)):
                low = part[0]
                gained, lost = _numbered(sh[low : part[-1] + own], own)
                total = np.zeros((len(part), BITS), np.int32)
                total[0] = sum(_signs(p).sum(axis=0) for p in np.array_split(gained[:own], own // PART + 1))
                total[1:] = _signs(gained[own:]) - _signs(lost[: len(lost) - own])
                np.cumsum(total, axis=0, out=total)
                w, items = self._within(_simhash(total), length)
                for k, item in zip(w.tolist(), items.tolist(), strict=True):
                    there, counts = np.unique(sh[part[k] : part[k] + own], return_counts=True)
                    _, x, y = np.intersect1d(there, self.items[item][3], assume_unique=True, return_indices=True)
                    both = int(np.minimum(counts[x], self.items[item][4][y]).sum())
                    if both >= self.t * (n + own - both) - 1e-9:
                        key, value = (doc, item), (-both / (n + own - both), int(part[k]))
                        best[key] = min(best.get(key, value), value)


def _chunks(benchmark: DataFrame) -> tuple[int, Iterator[Matcher]]:
    """How many chunks, and a matcher for each in turn."""
    rows, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-rows // CHUNK_ITEMS), -(-size // CHUNK_BYTES))

    def each() -> Iterator[Matcher]:
        for k in range(n):
            part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else benchmark
            got = part.select("item_id", "text").collect()  # a chunk
            yield Matcher([r[0] for r in got], [r[1] for r in got])

    return n, each()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), similarity of every document's best window for every item that it holds.

    Null and empty texts hold nothing, items without words are in nothing. Repeated documents or items give repeated rows, and
    of windows that tie the first counts. Texts of any length are taken whole, with memory in proportion to their words. Either
    table may be empty; of the documents only doc_id and text are read. With several chunks, each one's rows are written.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    out = None
    n, matchers = _chunks(benchmark)
    for matcher in matchers:

        def find(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(matcher.match(batch.column("text")))
                if found:
                    rows, items, starts, scores = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(items), pa.array(starts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "item_id", "start", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {key}, item_id {item}, start long, similarity double")
        part = written(part, "leaks") if n > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. With several chunks, what each leaves is written."""
    n, matchers = _chunks(benchmark)
    for matcher in matchers:

        def keep(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[x[0] for x in matcher.match(batch.column("text"))]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
        docs = written(docs, "clean") if n > 1 else docs
    return docs
