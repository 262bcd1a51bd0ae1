import random

import numpy as np
import pytest

from codeloom.llm import near_dedup, substring_dedup
from codeloom.llm.components import components
from codeloom.llm.substring_dedup import FingerprintIndex

from . import brute


def edit(words, r, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def corpus(prose):
    """Copies, near copies, shared passages in different surroundings, a common line, repeats within a text, edges."""
    r = random.Random(3)
    rows, n = [], iter(range(10_000))
    base = [prose(k, 150, 3000) for k in range(6)]
    for b in base:
        rows += [(next(n), " ".join(b)), (next(n), "\n".join(b))]
        rows += [(next(n), " ".join(edit(b, r, k))) for k in (1, 2, 4, 8, 30)]
    passage, line = prose(50, 60, 3000), prose(51, 36, 3000)
    for k in range(8):
        rows.append((next(n), " ".join(prose(100 + k, 40, 3000) + passage + prose(200 + k, 30, 3000))))
        rows.append((next(n), " ".join(prose(300 + k, 20, 3000) + line + prose(400 + k, 50, 3000))))
    twice = prose(60, 40, 3000)
    rows += [(next(n), " ".join(twice + prose(61, 9, 3000) + twice)), (next(n), " ".join(["same"] * 90)), (next(n), " ".join(passage[:34])), (next(n), " ".join(passage[:35]))]
    rows += [(next(n), t) for t in (None, "", " \t\n", "one", "One", "one two", "ONE two", "one two three", "one two three")]
    rows.append((next(n), " ".join(prose(70, 30_000, 3000) + passage)))
    return rows


def test_substring_dedup_is_exact(docs, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(docs(corpus)).collect()}
    want = brute.repeated_windows(corpus)
    assert {d: v for d, v in got.items() if v != want[d]} == {} and len(got) == len(corpus)


def test_substring_dedup_in_parts(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART", 50)
    import pyarrow as pa

    text = next(t for _, t in corpus if t and len(t) > 100_000)
    cut = sorted((int(a + base[0]), int(b + base[0])) for _, h, at, base in substring_dedup._parts(pa.array([text])) for _, a, b, _ in zip(*substring_dedup._runs(h, at, 35, 8), strict=True))
    covered = np.concatenate([np.arange(a, b + 1) for a, b in cut])
    assert len(covered) == len(set(covered.tolist())) == len(text.split()) - 34


def test_kept_text_and_edges(docs, spark):
    twice = " ".join(f"w{k}" for k in range(35))
    got = {r.doc_id: r for r in substring_dedup.deduplicate(docs([(1, f"a {twice} b"), (2, f"{twice}\nc"), (3, None), (None, "x")])).collect()}
    assert got[1].kept == "a b" and got[2].kept == "c" and got[3].kept == "" and got[None].kept == "x"
    assert substring_dedup.deduplicate(docs([])).count() == 0


def test_rows_without_an_id_of_their_own(docs):
    """Null ids, ids with several texts, and equal rows."""
    long = [" ".join(f"{t}{k}" for k in range(60)) for t in "abc"]
    rows = [(None, long[0]), (None, long[0] + " x"), (5, long[1]), (5, "y " + long[1]), (6, long[2]), (6, long[2]), (7, " ".join(f"d{k}" for k in range(60)))]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs(rows)).collect())
    assert got == sorted([(0, 60, 60, ""), (0, 61, 60, "x"), (5, 60, 60, ""), (5, 61, 60, "y"), (6, 60, 60, ""), (6, 60, 60, ""), (7, 60, 0, rows[-1][1])])


def test_batches_one_by_one(docs, corpus, monkeypatch):
    """Many batches, cells and levels; each call gives what the batch adds, and texts without a shared anchor are not read."""
    monkeypatch.setattr(substring_dedup, "CELL", 1)
    monkeypatch.setattr(substring_dedup, "HOT_KEYS", 1 << 30)
    some = [r for r in corpus if r[1] is None or len(r[1]) < 100_000]
    every = substring_dedup.keyed(docs(some))
    index = FingerprintIndex(every.sparkSession, buckets=4, fan=2)
    spans = None
    for k in range(3):
        new = substring_dedup.add_batch(index, every.filter(every.doc_id % 3 == k), every.filter(every.doc_id % 3 <= k))
        spans = new if spans is None else spans.unionByName(new)
        ids = {r.doc_id for r in every.join(new, ["k1", "k2"]).select("doc_id").distinct().collect()}
        want = [brute.repeated_windows([r for r in some if r[0] % 3 <= j]) for j in (k - 1, k)]
        assert {d for d, v in want[1].items() if v != want[0].get(d, (v[0], 0, v[2]))} <= ids
    assert [level for level, _ in index.runs] == [1, 0]
    heads = every.sparkSession.table(index.runs[0][1] + "_heads")
    assert heads.select("fp").distinct().count() == heads.count() and every.sparkSession.table(index.runs[0][1] + "_wide").count() > 0
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(every, spans).collect()}
    assert got == brute.repeated_windows(some)
    index.close()
    assert index.runs == []


def test_near_dedup_is_exact(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link(docs(corpus)).collect()}
    want = brute.linked(corpus)
    assert {d: (v, want[d]) for d, v in got.items() if v != want[d]} == {} and len(got) == len(corpus)


def test_near_dedup_links_that_the_least_member_hides(docs, prose):
    """b and c are linked with each other but not with a, the least; all share buckets."""
    base = prose(9, 400, 5000)
    r = random.Random(1)
    rows = [(0, " ".join(edit(base, r, 22)))]
    other = edit(base, r, 20)
    rows += [(k, " ".join(edit(other, r, 2))) for k in range(1, 40)]
    rows += [(40 + k, " ".join(edit(base, r, 24))) for k in range(30)]
    got = {x.doc_id: x.component_id for x in near_dedup.link(docs(rows)).collect()}
    assert got == {d: c for d, (_, c) in brute.linked(rows).items()}
    assert len(set(got.values())) > 2


def test_near_dedup_edges(docs, spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A B C D"), (8, None), (9, ""), (10, " ")]
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.link(docs(rows)).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (9, 9, True), (10, 10, True)]
    assert near_dedup.link(docs([])).count() == 0
    kept = near_dedup.kept_rows(docs(rows))
    assert kept.columns == docs(rows).columns and kept.count() == 6


def test_joins_and_forest():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 4000, n).astype(np.uint64)) for n in (3000, 2500, 10, 1)]
    got = near_dedup.joins(sets[:2], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:2]]
    ids, comps = np.array([1, 2, 3, 4]), np.array([1, 1, 3, 4])
    assert near_dedup.forest(ids, comps, np.array([0, 1, 2]), np.array([2, 2, 3])) == [(1, 3), (3, 4)]


def test_odd_sketches_estimate():
    r = np.random.default_rng(1)
    for share in (0.95, 0.9, 0.85):
        n = 4000
        both = int(n * 2 * share / (1 + share))
        pool = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = (near_dedup.odd_sketch(near_dedup.min_hashes(np.unique(x))) for x in (pool[:n], pool[n - both :]))
        bits = sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))
        assert bits <= near_dedup.MOST_BITS and near_dedup.estimate(bits) == pytest.approx(share, abs=0.12)


def test_min_hashes_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(2)
    agree = []
    for _ in range(60):
        pool = r.integers(0, 2**63, 300).astype(np.uint64)
        a, b = near_dedup.min_hashes(pool[:250]), near_dedup.min_hashes(pool[50:])
        agree.append((a == b).mean())
    assert np.mean(agree) == pytest.approx(200 / 300, abs=0.02)


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(7, 5), (5, 6), (9, 9)] + [(1000 + k, 999) for k in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and got[7] == got[6] == 5 and {got[1000 + k] for k in range(50)} == {999}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
