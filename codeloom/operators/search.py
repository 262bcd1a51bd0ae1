"""Ranked retrieval: a TF-IDF index, vector neighbours, and their fusion by reciprocal rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..functions import vectors as V
from .lookup import hydrate

#: The constant of reciprocal ranks, and how many more rows each list gives than are wanted.
RANK_CONSTANT, OVER_FETCH = 60, 2


def symbol_text(order: tuple = ("name", "kind", "file_path")) -> Column:
    return F.concat_ws(" ", *order)


def build_index(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """Postings (term, uid, tfidf) of nodes' names, kinds and paths, over the whole table.

    Term counts are pre-summed before their shuffle; totals and frequencies are joined back by key.
    """
    words = nodes.select("uid", F.explode(T.tokens(symbol_text() if text is None else text)).alias("term"))
    n = words.groupBy("uid", "term").agg(F.count(F.lit(1)).alias("n"))
    total = words.groupBy("uid").agg(F.count(F.lit(1)).alias("total"))
    frequency = n.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    documents = nodes.agg(F.countDistinct("uid")).scalar()
    joined = n.join(total, "uid").join(frequency, "term").withColumn("documents", documents)
    return joined.select("term", "uid", T.tf_idf(F.col("n"), F.col("total"), F.col("documents"), F.col("df")).alias("tfidf"))


def lexical(index: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """uid, score: the best sums of postings over the distinct lower-cased terms; none without terms."""
    wanted = sorted({t.lower() for t in terms})
    scores = index.filter(F.col("term").isin(wanted) if wanted else F.lit(False)).groupBy("uid").agg(F.round(F.sum("tfidf"), 9).alias("score"))
    return scores.orderBy(F.col("score").desc(), "uid").limit(limit)


def nearest(embeddings: DataFrame, query: list[float], limit: int = 20, candidates: int | None = None) -> DataFrame:
    """uid, distance: the vectors of least cosine distance; none for a zero query. candidates: how many to look at, if not all, in
    the order of their uids."""
    some = embeddings.orderBy("uid").limit(candidates) if candidates else embeddings
    q = F.array(*(F.lit(float(x)) for x in query)) if query else F.array().cast("array<double>")
    if not any(query or []):
        some = some.limit(0)
    scored = some.select("uid", F.round(1 - V.cosine(F.col("embedding"), q), 9).alias("distance"))
    return scored.orderBy("distance", "uid").limit(limit)


def fuse(*lists: DataFrame, limit: int = 20) -> DataFrame:
    """uid, score: the sum of 1 / (60 + rank) over lists of (uid, rank from 1)."""
    every = lists[0].select("uid", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("uid", "rank"))
    score = F.round(F.sum(F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))), 9).alias("score")
    return every.groupBy("uid").agg(score).orderBy(F.col("score").desc(), "uid").limit(limit)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """Ranks of a list that a limit has bounded."""
    return df.select("uid", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def hybrid(nodes: DataFrame, index: DataFrame, embeddings: DataFrame | None, terms: list[str], query: list[float] | None = None, limit: int = 20) -> DataFrame:
    """The nodes that lexical and, with a query vector, vector search find, fused."""
    lists = [ranked(lexical(index, terms, OVER_FETCH * limit), F.col("score").desc(), "uid")]
    if query and embeddings is not None:
        lists.append(ranked(nearest(embeddings, query, OVER_FETCH * limit), "distance", "uid"))
    return hydrate(fuse(*lists, limit=limit), nodes)


def split_by_cache(nodes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, text_hash, embedding) of nodes whose text is in cache (text_hash, embedding), and (uid, text_hash, text) of the rest."""
    named = nodes.select("uid", symbol_text(("name", "file_path", "kind")).alias("text")).withColumn("text_hash", ids.text_hash("text"))
    hits = named.join(cache, "text_hash").select("uid", "text_hash", "embedding")
    return hits, named.join(cache.select("text_hash"), "text_hash", "left_anti").select("uid", "text_hash", "text")


def zeros(texts: list[str], size: int = 384) -> list[list[float]]:
    """A provider without a model."""
    return [[0.0] * size for _ in texts]


def hashed(texts: list[str], size: int = 64) -> list[list[float]]:
    """A provider without a model: signed counts of words' hashes, of unit length."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().replace("/", " ").replace(".", " ").split():
            h = zlib.crc32(word.encode())
            v[h % size] += 1.0 if h >> 31 else -1.0
        length = sum(x * x for x in v) ** 0.5
        out.append([x / length for x in v] if length else v)
    return out


def embed(misses: DataFrame, provider: Callable[[list[str]], list[list[float]]] = hashed, batch: int = 64) -> DataFrame:
    """(uid, text_hash, embedding, error) from (uid, text_hash, text), batch texts a call.

    A call that fails costs its batch only, whose rows come with the error and no embedding, to be tried again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch][["uid", "text_hash", "text"]]
                try:
                    got, error = provider(part["text"].tolist()), None
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                except Exception as e:  # noqa: BLE001  whatever a provider raises
                    got, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part[["uid", "text_hash"]].assign(embedding=got, error=error)

    return misses.mapInPandas(run, "uid string, text_hash string, embedding array<float>, error string")


def embedded(done: DataFrame) -> DataFrame:
    """The rows of embed() that have a vector."""
    return done.filter("embedding IS NOT NULL").select("uid", "text_hash", "embedding")
