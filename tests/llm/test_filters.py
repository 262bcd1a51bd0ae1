import math
import random
import zlib

import numpy as np
import pytest

from codeloom.llm import decontaminate, license_scan, queries, toxicity, url_filter

from ..sql import connect, same
from . import brute


@pytest.fixture(scope="module")
def items(prose):
    return [(k, " ".join(prose(500 + k, n, 2000))) for k, n in enumerate((5, 8, 14, 37, 59, 59, 3, 1))] + [(90, None), (91, " . "), (92, "x y x y x y x y x y x y x y")]


def test_decontamination_is_exact(docs, spark, prose, items):
    r = random.Random(5)
    rows = []
    for i, text in items:
        w = (text or "").split()
        for k in range(7):
            own = list(w)
            if k and own:
                at = r.randrange(len(own))
                own = [own[:at] + own[at + 1 :], own[:at] + ["zz"] + own[at:], own[:at] + ["zz"] + own[at + 1 :], [x.upper() + "," for x in own], own[: len(own) * 9 // 10], own[::2]][k - 1]
            before, after = ([], []) if k == 5 else (prose(i * 10 + k, 30, 2000), prose(i * 10 + k + 5000, 20, 2000))
            rows.append((len(rows), " ".join(before + own + after)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(prose(77, 20_000, 2000) + items[4][1].split())), (1003, items[3][1]), (1003, items[3][1])]
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, start int")
    got = decontaminate.leaks(docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in brute.leaks(rows, items).items()}
    assert len([r for r in got if r.doc_id == 1003]) == 2  # the row comes twice
    left = decontaminate.clean(docs(rows), bench)
    assert left.columns == docs(rows).columns and {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {r.doc_id for r in got}


def test_decontamination_in_chunks(docs, spark, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t) for i, t in items]
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(rows), bench).collect()}
    assert found == set(brute.leaks(rows, items))
    assert decontaminate.clean(docs(rows), bench).count() == 2
    assert decontaminate.leaks(docs([]), bench).count() == 0 and decontaminate.leaks(docs(rows), bench.limit(0)).count() == 0
    assert decontaminate.clean(docs(rows), bench.limit(0)).count() == len(rows)


def test_decontamination_where_words_repeat(docs, spark, prose):
    """A long item's middle is a repeated word, in the document or in the item."""
    whole = [(k, [f"i{k}x{j}" for j in range(n)]) for k, n in enumerate((104, 304, 304, 604, 604))]
    blank = [(k, w[:40] + ["removed"] * ((len(w) - 4) // 9 - 4) + w[40 + (len(w) - 4) // 9 - 4 :]) for k, w in whole]
    rows = [(k, " ".join(prose(k, 50, 2000) + w + prose(90 + k, 40, 2000))) for k, w in blank]
    rows += [(10 + k, " ".join(w)) for k, w in whole] + [(20 + k, " ".join(w[:-30] + ["removed"] * 300)) for k, w in blank]
    items = [(k, " ".join(w)) for k, w in whole] + [(10 + k, " ".join(w)) for k, w in blank]
    want = brute.leaks(rows, items)
    assert {(k, k) for k, _ in whole} | {(10 + k, 10 + k) for k, _ in whole} <= set(want)
    got = decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_features_of_windows_number_equal_shingles():
    r = np.random.default_rng(3)
    sh, own = r.integers(0, 9, 200).astype(np.uint64), 24
    gained, lost = decontaminate._numbered(sh, own)
    held = sorted(gained[:own].tolist())
    for p in range(len(sh) - own + 1):
        assert held == sorted(decontaminate._numbered(sh[p : p + own], own)[0].tolist()) and len(set(held)) == own
        if p + own < len(sh):
            held.remove(int(lost[p]))
            held = sorted([*held, int(gained[p + own])])


def test_blocks_find_all_within_the_radius():
    r = np.random.default_rng(4)
    m = decontaminate.Matcher([k for k in range(300)], [f"w{k} x{k} y{k} z{k} q{k}" for k in range(300)])
    own, theirs, _ = m.tables[5]
    flips = np.zeros((50, decontaminate.BITS), np.uint8)
    for k, n in enumerate(r.integers(0, 2 * decontaminate.RADIUS, 50)):
        flips[k, r.choice(decontaminate.BITS, n, replace=False)] = 1
    prints = theirs[:50] ^ np.packbits(flips, axis=1)
    w, i = m._within(prints, 5)
    apart = np.unpackbits(prints[:, None] ^ theirs[None], axis=2).sum(axis=2)
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == {(a, own[b]) for a, b in zip(*np.nonzero(apart <= decontaminate.RADIUS), strict=True)}
    # Of pairs further apart few pass the bytes.
    agree = sum(m.tables[5][2][b][prints[:, b]].astype(int) for b in range(decontaminate.BYTES)) >= decontaminate.AGREE
    assert agree[apart <= decontaminate.RADIUS].all() and agree[apart > 100].mean() < 0.03


def test_decontamination_of_very_long_texts(prose):
    """Memory grows with the words of a text, not with words times those of an item."""
    import tracemalloc

    import pyarrow as pa

    item = prose(1, 2000, 3)
    m = decontaminate.Matcher([0], [" ".join(item)])
    text = " ".join((item * 60)[:100_000])
    tracemalloc.start()
    got = list(m.match(pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, 0, 1.0)] and peak < 200e6


BAD = {"en": ["idiotic", "scummy", "vile"], "fr": ["vilaino", "vilaine", "vilaint"]}


def toxic_rows(prose, n, seed=0):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang, bad = r.choice(["en", "fr"]), r.random() < 0.3
        w = prose(9000 + 13 * seed + k, r.randint(15, 60), 900)
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(BAD[lang]))
        rows.append((k, " ".join(w).capitalize() + ".", lang, int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, prose):
    rows = toxic_rows(prose, 700)
    docs = spark.createDataFrame([(d, t, g, "score") for d, t, g, _ in rows] + [(9000, None, None, ""), (9001, "", "de", ""), (9002, "plain words vilainest vilainity here", "fr", "")], "doc_id long, text string, lang string, toxic string")
    labels = spark.createDataFrame([(d, y, y) for d, _, _, y in rows] + [(9000, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(y, got[d] >= toxicity.ALERT) for d, _, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 150 and np.mean([y == p for y, p in held]) > 0.97
    assert len(got) == 703 and all(0 <= s <= 1 for s in got.values())
    assert got[9000] == got[9001] < 0.5 and got[9002] > 0.5  # unseen endings of a known stem
    assert set(model.thresholds) >= {"", "en"} and all(0.5 <= t <= 0.9 for t in model.thresholds.values())
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()} and kept.count() < 600
    again = toxicity.fit(docs, labels)
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == got


def test_toxicity_never_sees_held_out_labels(spark, prose):
    rows = toxic_rows(prose, 200, 1)
    docs = spark.createDataFrame([(d, t, g) for d, t, g, _ in rows], "doc_id long, text string, lang string")
    flip = [(d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, _, _, y in rows]
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()} for x in ([(d, y) for d, _, _, y in rows], flip)]
    assert scores[0] == scores[1]


def test_toxicity_without_examples(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs([(1, "a b"), (2, None)])
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.0}
    assert toxicity.score(docs([]), toxicity.fit(docs([]), none)).count() == 0
    one_class = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    toxicity.fit(df, one_class)


def test_pooling_spans_texts_of_any_length(prose):
    model = toxicity.fit_rows([np.array([[k % 50, k % 7, k % 3]] * 3, np.int32) for k in range(40)], np.array([0, 1] * 20), [None] * 40)
    parts = [np.array([[5, 1, 2]] * n, np.int32).reshape(-1, toxicity.PARTS) for n in (0, 1, 2, 5, 0, 900)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    together = model.raw(np.concatenate(parts), at)
    alone = [model.raw(p, np.array([0, len(p)]))[0] for p in parts]
    assert together == pytest.approx(alone)


def test_parts_of_the_sample_share_no_row():
    labels = np.array([0] * 30 + [1] * 20)
    part = toxicity.parts(labels)
    assert [[int(((part == k) & (labels == c)).sum()) for k in range(3)] for c in (0, 1)] == [[21, 6, 3], [14, 4, 2]]


def test_embeddings_are_trained():
    r = np.random.default_rng(1)
    rows = [r.integers(0, 40, (12, toxicity.PARTS)).astype(np.int32) + 40 * (k % 2) * (r.random((12, 1)) < 0.4) for k in range(60)]
    model, begun = toxicity.Model(), toxicity.Model()
    labels = np.array([k % 2 for k in range(60)])
    begun.begin([x.astype(np.int32) for x in rows], labels)
    model.train([x.astype(np.int32) for x in rows], labels)
    assert (model.slots == begun.slots).all() and (model.embedding[0] == 0).all()
    assert (np.abs(model.embedding[1:] - begun.embedding[1:]).max(axis=0) > 1e-3).all()


def test_very_long_toxic_texts(prose):
    """The toxic words come last, after a text of many pieces."""
    import pyarrow as pa

    rows = toxic_rows(prose, 300, 4)
    slots = [s[at[k] : at[k + 1]] for _, s, at in toxicity.slotted(pa.array([t for _, t, _, _ in rows])) for k in range(len(at) - 1)]
    model = toxicity.fit_rows(slots, np.array([y for *_, y in rows]), [g for _, _, g, _ in rows])
    clean = " ".join(prose(5, 400_000, 900))
    assert len(clean) > 2 << 20
    low, high = model.scores(pa.array([clean, clean + " idiotic scummy vile idiotic"]))
    assert low < 0.7 and high > low + 0.05


URLS = [
    ("http://Example.COM/en/12?x=1", "example.com", "/en/12", "com/en/", "block"), ("https://a.example.com/en/7/9#t", "a.example.com", "/en/7/9", "example.com/en/7", "allow"),
    ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), ("http://w.example.net/de/81", "w.example.net", "/de/81", "example.net/de/8", "block"),
    ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"), ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"), ("http://x.org/es", "x.org", "/es", None, "allow"),
    ("http://com/en/1", "com", "/en/1", "com/en/", "block"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("x://HÖST.com?/en/", "hÖst.com", "", None, "allow"), ("://q#/z", "q", "", None, "allow"), ("http://h/a\nb/c?d", "h", "/a\nb/c", None, "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "t", "r") for k, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {k: tuple(x) for k, (_, *x) in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_templates_learn_from_rules(spark):
    rows = [(k, f"http://spam.com/en/{k}.html") for k in range(200)] + [(1000 + k, f"http://spam.com/xx/{k}.html") for k in range(10)] + [(2000 + k, f"http://fine.de/a/{k}/{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k % 90 * 'z'}") for k in range(300)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[k].verdict for k in range(1000, 1010)} == {"block"} and {got[k].rule for k in range(1000, 1010)} == {None}
    assert {got[k].verdict for k in range(2000, 2300)} == {"allow"} and len(got) == len(rows)


def test_url_templates_of_any_depth(spark):
    """A blocked section and one like it, five segments down, beside one of another structure."""
    rows = [f"http://h.com/en/{k}/a/b/{k}.html" for k in range(100)] + [f"http://h.com/fr/{k}/a/b/{k}.html" for k in range(40)]
    rows += [f"http://h.com/about/{'abcdefgh'[k % 8]}" for k in range(40)] + ["http://h.com" + "/x" * 12] + [f"http://h.com/fr/{k}/a/c/{k}.html" for k in range(3)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    assert {got[k] for k in range(140)} == {"block"} and {got[k] for k in range(140, 181)} == {"allow"}


def test_url_templates_are_judged_on_their_labels(spark):
    """Templates of one host each: 122 of 137 labelled urls blocked, 100 of 137, and none labelled; 70 urls have no rule."""
    rows = []
    for host, bad, good in (("a.example.com", 122, 15), ("b.example.com", 100, 37), ("c.example.com", 0, 0)):
        rows += [f"http://{host}/en/1{k}" for k in range(bad)] + [f"http://{host}/en/7{k}" for k in range(good)] + [f"http://{host}/xx/{k}" for k in range(70)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).filter("rule IS NULL").collect()
    assert {(r.host, r.verdict) for r in got} == {("a.example.com", "block"), ("b.example.com", "allow"), ("c.example.com", "allow")} and len(got) == 210


def test_license_scan(docs, spark):
    filler = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"{filler} Licensed under the Apache License, Version 2.0. {filler}"), (2, "RELEASED under\nthe MIT license"), (3, "released under the mit"), (4, None), (5, ""), (6, filler),
            (7, "Licensed under CC BY-NC 4.0.\n" * 3), (8, f"This work is licensed under the GNU General Public License, version 3. {filler} Licensed under CC-BY-NC 4.0"), (7, "Licensed under CC BY-NC 4.0."),
            (9, filler + " permission is hereby granted free of charge to any person obtaining a copy of this software and its documentation files the software to deal in the software without restriction")]
    got = sorted((r.doc_id, r.license, r.start, round(r.containment, 2)) for r in license_scan.scan(docs(rows)).collect())
    assert [(a, b) for a, b, _, _ in got] == [(1, "Apache-2.0"), (2, "MIT"), (7, "CC-BY-NC-4.0"), (8, "CC-BY-NC-4.0"), (8, "GPL-3.0"), (9, "MIT-text")]
    assert license_scan.scan(docs([])).count() == 0
    plan = license_scan.scan(docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_scan_of_long_texts(docs, monkeypatch):
    """Parts are cut anywhere; a text full of anchors; the shortest templates."""
    rows = [(1, "license " * 30_000 + "SPDX-License-Identifier: MIT"), (2, " ".join(f"w{k}" for k in range(9000)) + " " + license_scan.TEMPLATES[12][1]), (3, "spdx license identifier gpl 3 0 or later")]
    want = {(1, "SPDX-MIT"), (2, "BSD-2-Clause-conditions"), (3, "SPDX-GPL-3.0-or-later")}
    for part in (4096, 7):
        monkeypatch.setattr(license_scan, "PART", part)
        got = license_scan.scan(docs(rows if part > 7 else [(d, " ".join(t.split()[-80:])) for d, t in rows])).collect()
        assert want <= {(r.doc_id, r.license) for r in got} and all(r.containment >= 0.8 for r in got)


def test_license_anchors_lose_nothing():
    for _, text in license_scan.TEMPLATES:
        w = license_scan._words(text)
        grams = license_scan._shingles(w)
        without = [s for s in grams if not set(s.split()) & set(license_scan.anchors_of(w))]
        assert len(without) < license_scan.CONTAINED * len(grams)
        size, step = license_scan._shape(len(w))
        assert size >= len(w) + step - 1
        windows = max(1, size - license_scan.SHINGLE + 1)
        need = math.ceil(license_scan.CONTAINED * len(grams))
        assert need / (len(grams) + windows - need) >= 0.45


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, tiny, name):
    same(queries.queries()[name](spark, tiny), connect(tiny), queries.oracle_sql()[name])


def test_native_queries_run_no_python(spark, tiny):
    for name in ("op5_url_filter", "op8_mixing", "op9_license_scan"):
        plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop")), name


def test_held_out_column(spark):
    got = {r.doc_id: r.h for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in range(50)}
    assert spark.createDataFrame([(None,)], "doc_id long").select(toxicity.held_out()).first()[0] is False
