import collections
import hashlib
import random

import pytest

import corpus_pipeline
from codeloom.llm import mixing, sharding, toxicity

from . import brute
from .test_filters import toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    """Documents with toxic ones, near copies and leaks, their labels, and a benchmark."""
    r = random.Random(8)
    tox = toxic_rows(prose, 240, 3)
    rows = [(d, t, g, r.choice(["a", "b", "c", None])) for d, t, g, _ in tox]
    items = [(k, " ".join(prose(700 + k, 20, 900))) for k in range(4)]
    for k in range(60):
        w = prose(20_000 + k, 120, 3000)
        rows.append((1000 + 3 * k, " ".join(w), "en", "a"))
        if k % 3 == 0:
            rows.append((1001 + 3 * k, " ".join(w), "en", "b"))
            rows.append((1002 + 3 * k, " ".join(w[:60] + ["changed"] + w[61:]), "en", "c"))
        if k % 10 == 1:
            rows.append((2000 + k, " ".join(w[:9] + items[k % 4][1].split() + prose(30_000 + k, 80, 3000)), "en", "b"))
    rows += [(5000, None, None, None), (5001, "", "en", "a")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, _, y in tox], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, {d: y for d, _, _, y in tox}, items


def test_stages_against_brute_force(spark, corpus):
    at, rows, labels, items = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        assert out.columns[: len(columns)] == columns and (len(out.columns) == len(columns) or name == "sharding")
        out.write.parquet(f"{at}/stage-{k}")
        docs = spark.read.parquet(f"{at}/stage-{k}")
        got = docs.collect()
        after = {r.doc_id: r for r in got}
        texts = [(d, r.text) for d, r in before.items()]
        if name == "toxicity":
            wrong = [d for d in before if (d in after) == bool(labels.get(d, 0))]
            assert len(wrong) <= 0.03 * len(before) and not [d for d in wrong if d not in labels]
        elif name == "near_dedup":
            assert set(after) == {d for d, (_, c) in brute.linked(texts).items() if c == d}
        elif name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in brute.leaks(texts, items)} and len(after) < len(before)
        elif name == "mixing":
            copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(spark.read.parquet(f"{at}/stage-{k - 1}")).collect()}
            assert collections.Counter((r.doc_id, r.source) for r in got) == {x: c for x, c in copies.items() if c}
        else:
            table = sharding.fill_table([f"shard-{s}" for s in range(64)], 16381)
            assert all(r["shard"] == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 16381] for r in got)
        assert all(r.text == before[d].text for d, r in after.items())
        before = after
    run = corpus_pipeline.run(spark, at)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    at = corpus[0]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "shard"


def test_rejects_by_language():
    m = toxicity.Model()
    m.thresholds = {"": 0.6, "fr": 0.8}
    assert (m.threshold("fr"), m.threshold("xx"), m.threshold(None)) == (0.8, 0.6, 0.6)


def test_near_dedup_stage_takes_five_words_and_a_similarity_of_four_fifths(spark, docs, prose):
    r = random.Random(6)
    fresh = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    rows = []
    for k in range(12):
        base, added = fresh(f"b{k}x", 400), fresh(f"a{k}x", 80)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + added)), (10 * k + 2, " ".join(base + fresh(f"c{k}x", 130)))]
        at = r.randrange(400)
        rows.append((10 * k + 3, " ".join(base[:at] + added + base[at:])))
    plain = {d: (frozenset(brute.shingles(t, 5)), t) for d, t in rows}
    root = {d: d for d in plain}
    for a in sorted(plain):  # copies of one base only share shingles
        for b in sorted(x for x in plain if x // 10 == a // 10 and x > a):
            x, y = plain[a][0], plain[b][0]
            if 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {d: low if c == high else c for d, c in root.items()}
    got = {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs(rows), "").collect()}
    assert got == {d for d, c in root.items() if d == c}
    assert {10 * k + 1 for k in range(12)}.isdisjoint(got) and {10 * k + 2 for k in range(12)} <= got
