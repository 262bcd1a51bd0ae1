"""Toxicity: a convolutional text classifier, trained in numpy.

Words are runs of letters and digits, A-Z as a-z. A word has a hash of itself and of each of its stems, its first STEMS bytes; they
fall into slots, and the word's embedding is the sum of the slots' vectors, so that unseen endings of a known stem count. Slots that two training texts have at least have a vector, others the zero vector. Filters of widths 1, 2 and 3 slide over the
embedded text; each filter's largest value, over the whole text, goes through a rectifier into a logistic unit.

The sample has three parts that share no text. On the first, embeddings and filters are trained together by gradient steps. An
embedding's first dimension begins at the slot's smoothed log odds of a toxic text; while training, each text sees the odds that
the other texts give (its own label left out), so that words that happen to occur in few texts don't look better than they are.
The other dimensions begin at a random code. On the second part the scores are calibrated, on the third the thresholds, by
language. Nothing changes the model afterwards.

The sample is bounded: SAMPLE rows a class, in order of a hash of doc_id; texts over SAMPLE_WORDS words are no examples, so that
the driver holds 3,000 * 4,000 * 12 bytes = 144 MB of slots at most. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

SAMPLE, SAMPLE_WORDS = 1500, 4000
#: Of ten rows of a class, so many train, so many calibrate scores, and the rest thresholds.
TRAIN, CALIBRATE = 7, 2
LEAST = 8  # examples of a class without which there is no model
SLOTS, STEMS = 1 << 22, (4, 6)
PARTS = 1 + len(STEMS)
WIDTHS, FILTERS, DIMENSIONS = (1, 2, 3), 6, 6
ALERT = 0.7
PRIOR = 4.0  # texts that smooth a slot's odds
ROUNDS, RATE, EMBED_RATE, DECAY = 40, 0.1, 0.01, 0.02
CHUNK = 1 << 16  # words that go through training at once
LEAST_BY_LANGUAGE = 20  # calibration rows below which a language has the threshold of all


def slotted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text's number, slots of each word and its stems, bounds of the texts), for groups of whole texts."""
    every = (words.hashed(column, lower=True, marks=True, stem=stem) for stem in (0, *STEMS))
    for own in zip(*every, strict=True):
        hashes = [own[0][1], *(words.mix(h ^ np.uint64(stem)) for (_, h, _), stem in zip(own[1:], STEMS, strict=True))]
        yield own[0][0], (np.stack(hashes, axis=1) & np.uint64(SLOTS - 1)).astype(np.int32), own[0][2]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _odds(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    share = (bad + PRIOR / 2) / (bad + good + PRIOR)
    return np.log(share / (1 - share))


class Model:
    """slots: the sorted slots that have an embedding; row 0 of the embeddings is that of all others."""

    def __init__(self) -> None:
        self.slots, self.embedding = np.zeros(0, np.int32), np.zeros((1, DIMENSIONS), np.float32)
        rng = np.random.default_rng(5)
        self.filters = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
        for f in self.filters:  # half of the filters begin at the log odds of one of their places
            for k in range(FILTERS // 2):
                f[k % len(f), 0, k] += 1
        self.bias, self.out, self.constant = np.zeros(len(WIDTHS) * FILTERS), np.full(len(WIDTHS) * FILTERS, 0.3), 0.0
        self.scale, self.shift = 1.0, 0.0
        self.base: float | None = None  # where a class has no example: the share of toxic ones
        self.thresholds: dict = {}
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def begin(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings to begin with, from the slots of labelled texts. Gives the slots' weights in toxic and in other texts."""
        each = [np.unique(r) for r in rows]
        slots, where, seen = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        bad = np.bincount(where, weights=np.repeat(labels, [len(r) for r in each]), minlength=len(slots))
        keep = seen >= 2
        self.slots = slots[keep].astype(np.int32)
        bad, good = bad[keep], (seen - bad)[keep] * (labels.sum() / (1 - labels).sum())  # the classes weigh alike
        code = np.random.default_rng(9).normal(0, 0.1, (SLOTS >> 8, DIMENSIONS))[self.slots & ((SLOTS >> 8) - 1)]
        code[:, 0] = _odds(bad, good)
        self.embedding = np.concatenate([np.zeros((1, DIMENSIONS)), code]).astype(np.float32)
        self._ready = None
        return np.append(0, bad), np.append(0, good)

    def rows_of(self, slots: np.ndarray) -> np.ndarray:
        if self._ready is None:
            table = np.zeros(SLOTS, np.int32)
            table[self.slots] = np.arange(1, len(self.slots) + 1, dtype=np.int32)
            lots = [[(self.embedding @ f[o]).astype(np.float32) for o in range(len(f))] for f in self.filters]
            self._ready = (table, lots)
        return self._ready[0][slots]

    def pooled(self, rows: np.ndarray, at: np.ndarray, lots: list) -> np.ndarray:
        """Largest value of each filter in each text; at are the texts' bounds among rows. Texts end in zero vectors."""
        n = len(at) - 1
        pad = max(WIDTHS)  # zero vectors around each text, so that short and empty ones have windows
        moved = np.zeros((len(rows) + pad * (n + 1), PARTS), np.int32)
        moved[np.arange(len(rows)) + pad * (np.searchsorted(at, np.arange(len(rows)), "right"))] = rows
        begin = at[:-1] + pad * np.arange(n)
        out = []
        for lot in lots:
            size = len(lot)
            total = np.zeros((len(moved) - size + 1, FILTERS), np.float32)
            for o in range(size):
                for k in range(PARTS):
                    total += lot[o][moved[o : len(moved) - size + 1 + o, k]]
            out.append(np.maximum.reduceat(total, begin, axis=0) if n else np.zeros((0, FILTERS), np.float32))
        return np.concatenate(out, axis=1)

    def train(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """Embeddings, filters and the logistic unit, by Adam. Gradients pass through each filter's largest window."""
        bad, good = self.begin(rows, labels)
        first = self.embedding[:, 0].copy()
        # Texts as runs of embedding rows; words without a vector carry nothing, runs of them are cut to the widest filter.
        edge, chunks, texts = np.zeros((3, PARTS), np.int32), [], []
        for number, r in enumerate(rows):
            t = self.rows_of(r)
            texts.append((number, np.concatenate([edge, t[np.convolve(t.any(axis=1), np.ones(7))[3 : len(t) + 3] > 0] if len(t) else t, edge])))
            if sum(len(t) for _, t in texts) >= CHUNK or number == len(rows) - 1:
                numbers, flat = [k for k, _ in texts], np.concatenate([t for _, t in texts])
                sizes = np.array([len(t) for _, t in texts])
                y = np.repeat(labels[numbers], sizes)[:, None]
                # What the odds of the other texts differ by from those of all.
                other = _odds(bad[flat] - y, good[flat] - (1 - y) * (labels.sum() / (1 - labels).sum())) - first[flat]
                other = np.where(flat > 0, other, 0.0).sum(axis=1).astype(np.float32)
                chunks.append((np.array(numbers), flat, other, np.append(0, np.cumsum(sizes)[:-1]), np.repeat(np.arange(len(sizes)), sizes)))
                texts = []
        # Words with the same slots are one type, whose sums are computed once a step.
        every = np.concatenate([c[1] for c in chunks])
        key = words.mix(every.astype(np.uint64) @ (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, PARTS + 1, dtype=np.uint64)))
        _, one, kind = np.unique(key, return_index=True, return_inverse=True)
        types, ends = every[one], np.cumsum([len(c[1]) for c in chunks])
        chunks = [(*c, k) for c, k in zip(chunks, np.split(kind.astype(np.int32), ends[:-1]), strict=True)]
        weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
        start = self.embedding.astype(np.float64)
        params = [start.copy(), *self.filters, self.bias, self.out, np.array([self.constant])]
        rates = [EMBED_RATE] + [RATE] * (len(params) - 1)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, ROUNDS + 1):
            table, filters, bias, out, constant = params[0], params[1:-3], params[-3], params[-2], params[-1]
            slopes = [DECAY * (table - start) / len(table), *(np.zeros_like(f) for f in filters), np.zeros_like(bias), 1e-4 * out, np.zeros(1)]
            lots = [[sum((table @ f[o]).astype(np.float32)[types[:, k]] for k in range(PARTS)) for o in range(len(f))] for f in filters]
            pulled, pulls = [], []  # rows of the table and their slopes
            for numbers, flat, other, begin, owner, kind in chunks:
                places, tops = [], []
                for f, lot in zip(filters, lots, strict=True):
                    n = len(flat) - len(f) + 1
                    total = np.zeros((n, FILTERS), np.float32)
                    for o in range(len(f)):
                        total += lot[o][kind[o : n + o]]
                        total += other[o : n + o, None] * f[o][0].astype(np.float32)
                    top = np.maximum.reduceat(total, begin, axis=0)
                    at, which = np.nonzero(total == top[owner[:n]])
                    place = np.zeros(top.shape, int)
                    place[owner[at][::-1], which[::-1]] = at[::-1]
                    tops.append(top)
                    places.append(place)
                pooled = np.concatenate(tops, axis=1) + bias
                hidden = np.maximum(pooled, 0)
                error = (_sigmoid(hidden @ out + constant[0]) - labels[numbers]) * weight[numbers]
                back = error[:, None] * out * (pooled > 0)
                for w, f in enumerate(filters):
                    own = back[:, w * FILTERS : (w + 1) * FILTERS]
                    for o in range(len(f)):
                        at = flat[places[w] + o]  # text, filter, word and stems
                        there = table[at].sum(axis=2)
                        there[:, :, 0] += other[places[w] + o]
                        slopes[1 + w][o] += np.einsum("tf,tfd->df", own, there)
                        pulled.append(at.reshape(-1, PARTS))
                        pulls.append((own[:, :, None] * f[o].T[None]).reshape(-1, DIMENSIONS))
                slopes[-3] += back.sum(axis=0)
                slopes[-2] += hidden.T @ error
                slopes[-1] += error.sum()
            at, slope = np.concatenate(pulled), np.concatenate(pulls)
            for k in range(PARTS):
                for d in range(DIMENSIONS):
                    slopes[0][:, d] += np.bincount(at[:, k], weights=slope[:, d], minlength=len(table))
            slopes[0][0] = 0
            for p, (m, v), g, rate in zip(params, moments, slopes, rates, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.embedding, self.filters = params[0].astype(np.float32), params[1:-3]
        self.bias, self.out, self.constant = params[-3], params[-2], float(params[-1][0])
        self._ready = None

    def raw(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = self.rows_of(slots)
        pooled = self.pooled(rows, at, self._ready[1]).astype(np.float64)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.constant

    def score(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(at) - 1, self.base)
        return _sigmoid(self.scale * self.raw(slots, at) + self.shift)

    def scores(self, column: pa.Array) -> np.ndarray:
        parts = [self.score(slots, at) for _, slots, at in slotted(column)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds.get("", ALERT))


def _calibrate(model: Model, raw: np.ndarray, labels: np.ndarray) -> None:
    """Slope and intercept of the score by Newton's method."""
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    middle, spread = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - middle) / spread, np.ones(len(raw))], axis=1)
    beta = np.zeros(2)
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(50):
        p = _sigmoid(x @ beta)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-3 * np.array([beta[0], 0]))
    model.scale, model.shift = beta[0] / spread, beta[1] - beta[0] * middle / spread


def _limit(model: Model, scores: np.ndarray, labels: np.ndarray, langs: list) -> None:
    """Thresholds: of all rows, and of languages with enough rows."""

    def best(own: np.ndarray) -> float:
        """Of thresholds from 0.5 to 0.9, the one with the least balanced error; ties to the one nearest ALERT."""
        y, s = labels[own], scores[own]
        error = lambda t: np.mean(s[y == 1] < t) + np.mean(s[y == 0] >= t)
        return min((round(error(t), 6), abs(t - ALERT), t) for t in np.arange(50, 91) / 100)[2]

    model.thresholds = {"": float(best(np.ones(len(labels), bool)))}
    for lang in {x for x in langs if x}:
        own = np.array([x == lang for x in langs])
        if own.sum() >= LEAST_BY_LANGUAGE and 0 < labels[own].sum() < own.sum():
            model.thresholds[lang] = float(best(own))


def parts(labels: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each row: those that train, that calibrate scores, and thresholds; in like shares of both classes."""
    turn = np.zeros(len(labels), int)
    for c in (0, 1):
        own = np.flatnonzero(labels == c)
        turn[own] = (np.arange(len(own)) * 7) % 10
    return np.where(turn < TRAIN, 0, np.where(turn < TRAIN + CALIBRATE, 1, 2))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, langs: list) -> Model:
    """A model from texts as slots. With less than LEAST examples of a class, its score is the share of toxic ones."""
    model = Model()
    if min(labels.sum(), (1 - labels).sum()) < LEAST:
        model.base = float(labels.mean()) if len(labels) else 0.0
        return model
    part = parts(labels)

    def raw(k: int) -> np.ndarray:
        own = [rows[j] for j in np.flatnonzero(part == k)]
        return model.raw(np.concatenate(own), np.concatenate([[0], np.cumsum([len(r) for r in own])]))

    model.train([rows[j] for j in np.flatnonzero(part == 0)], labels[part == 0])
    _calibrate(model, raw(1), labels[part == 1])
    _limit(model, _sigmoid(model.scale * raw(2) + model.shift), labels[part == 2], [langs[j] for j in np.flatnonzero(part == 2)])
    return model


def held_out(key: str = "doc_id"):
    """Rows that never give a label: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on a bounded sample of labelled documents that aren't held out.

    labels has doc_id and toxic; rows with a null are left out, the larger of several labels of a document counts. Of rows that
    repeat a doc_id one is an example, whose text has the least hash. Ties in the order of the sample go by doc_id.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    drawn = [known.filter(F.col("toxic") == c).orderBy(*order).limit(SAMPLE) for c in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang"), F.xxhash64(docs["text"]).alias("h")).join(F.broadcast(sample), "doc_id")  # 2 * SAMPLE rows at most

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, keep = [], []
            for first, s, at in slotted(batch.column("text")):
                for k in range(len(at) - 1):
                    if at[k + 1] - at[k] <= SAMPLE_WORDS:
                        got.append(s[at[k] : at[k + 1]].tobytes())
                        keep.append(first + k)
            part = batch.select(["doc_id", "lang", "toxic", "h"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], ["doc_id", "lang", "toxic", "h", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.select("doc_id", "lang", "toxic", "h", "text").mapInArrow(slots, f"doc_id {kind}, lang string, toxic int, h long, slots binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "lang", "toxic", "slots")).alias("x")).select("doc_id", "x.lang", "x.toxic", "x.slots").toArrow().sort_by("doc_id")
    rows = [np.frombuffer(x.as_py(), np.int32).reshape(-1, PARTS) for x in got.column("slots")]
    return fit_rows(rows, np.array(got.column("toxic").to_pylist(), np.int64), got.column("lang").to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null texts score as empty ones.

    Equal texts have equal scores, so repeated rows and ties stay such. Texts of any length are read whole, a piece at a time.
    Null doc_ids are like others, an empty table gives no rows, other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below the threshold of their language, with all their columns.

    A null language, or one without examples, has the threshold of all. Otherwise as score().
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_lang = "lang" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist() if has_lang else [None] * batch.num_rows
            limit = np.array([shared.value.threshold(x) for x in langs])
            yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < limit))

    return docs.mapInArrow(run, docs.schema)
