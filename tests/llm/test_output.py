import collections
import hashlib
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.llm import mixing, sharding, token_records, topk
from codeloom.llm.shared import fresh_path, n_words

# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.fixture(scope="module")
def mixed(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for source, count in (("b", 900), ("a", 300), ("ä", 200), ("c", 60), (None, 40), ("d", 1), ("e", 5)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * int(r.integers(1, 200))), source, 9))
            n += 1
    rows += [(n, None, "a", 1), (n + 1, "", "b", 1), (n + 2, " \t ", "zero", 1), (None, "one two", "a", 1), (n + 3, "q " * 50_000, "b", 1), (5, "again", "b", 1), (5, "again", "b", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix(mixed):
    rows, df = mixed
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    for s in sizes:
        units = collections.Counter()
        for d, t, x, _ in rows:
            if x == s:
                units[d] += len((t or "").split())
        assert abs(taken[s] - want[s]) <= min(n for n in units.values() if n or not sizes[s]) + 1e-6 * want[s] or len(units) < 6, s
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_mixed_rows(mixed):
    rows, df = mixed
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    copies = {(r.doc_id, r.source): r.copies for r in mixing.mix(df).collect()}
    seen = collections.Counter((r.doc_id, r.source) for r in out.collect())
    rows_of = collections.Counter((d, s) for d, _, s, _ in rows)
    assert seen == {k: c * rows_of[k] for k, c in copies.items() if c}


def chance(seed, *key):
    text = "|".join([str(seed), *("~" if k is None else str(k) for k in key)])
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def plain_copies(units, fan, room, seed=7):
    """Copies of one source's units (doc_id -> (words, share)) by a plain tree of lists."""
    held = lambda v: min(max(v, 0.0), 2.0)

    def whole(v, u):
        v = round(v) if abs(v - round(v)) < 1e-9 else v
        return math.floor(v) + (u < v - math.floor(v))

    def settle(some, pool, off):
        """Copies by name of units that meet those after them and a pool; what is left to get from the pool."""
        left, got = sum(a for _, a, _, _ in some) + pool, {}
        off += sum((v - held(v)) * a for _, a, v, _ in some)
        for name, a, v, u in some:
            got[name] = whole(held(held(v) + (off / left if left > 0 else 0)), u)
            off, left = off + (held(v) - got[name]) * a, left - a
        return got, off

    def but_last(node, off=0.0):
        last = node[-1]
        got, off = settle(node[:-1], last[1], (last[2] - held(last[2])) * last[1])
        return got, (last[0], last[1], held(last[2]) + (off / last[1] if last[1] > 0 else 0.0))

    n, total, source = len(units), sum(a for a, _ in units.values()), next(iter(units))[0]
    blocks, every = math.ceil(n / fan), []
    for (s, d), (a, v) in units.items():
        some = min(room * a * n / total, n) if total else 1
        level = max(0, math.ceil(math.log(max(some, 1)) / math.log(fan) - 1e-9) - 1)
        every.append((math.floor(chance(seed, d) * blocks), level, (a > 0, -a, chance(seed + 1, d)), (d, float(a), v, chance(seed + 2, s, d))))
    depth = 0
    while fan**depth <= max(b for b, *_ in every):
        depth += 1
    done, shift = {}, collections.defaultdict(float)
    for k in range(depth, 0, -1):
        below = collections.defaultdict(float)
        for b in sorted({b // fan**k for b, *_ in every}):
            own = [x for _, x in sorted((o, (d, a, v + shift[k, b], u)) for c, lv, o, (d, a, v, u) in every if lv == k and c // fan**k == b)]
            pool = sum(x[1] for c, lv, _, x in every if lv < k and c // fan**k == b)
            got, off = settle(own, pool, 0.0)
            done |= got
            below[b] = shift[k, b] + (off / pool if pool else 0.0)
        for b in {b // fan ** (k - 1) for b, *_ in every}:
            shift[k - 1, b] = below[b // fan]
    nodes, levels = collections.defaultdict(list), []
    for b, level, o, (d, a, v, u) in every:
        if level == 0:
            nodes[b].append((o, (d, a, v + shift[0, b], u)))
    for k in range(depth + 1):
        levels.append({b: but_last([x for _, x in sorted(x)]) for b, x in nodes.items()})
        nodes = collections.defaultdict(list)
        for b, (_, (_, a, v)) in levels[-1].items():
            nodes[b // fan].append(((a > 0, -a, b), (b, a, v, chance(seed + 3 + k, source, b))))
    fate = {0: whole(held(levels[-1][0][1][2]), chance(seed + 99, source))}
    for level in reversed(levels):
        fate = {n: c for b, (got, (name, _, _)) in level.items() for n, c in [*got.items(), (name, fate[b])]}
    return fate | done


def test_copies_against_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    monkeypatch.setattr(mixing, "ROOM", 3)
    r = np.random.default_rng(4)
    rows = []
    for s, n, share in (("a", 200, 0.37), ("b", 9, 1.6), (None, 30, 2.0), ("c", 1, 0.5), ("d", 40, 1.0)):
        rows += [(s, None if k == 3 else k, int(x) if k % 7 else 0, n, share) for k, x in enumerate(r.lognormal(3, 1.5, n))]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long, n_units long, share double")
    df = df.withColumn("source_size", F.sum("size").over(Window.partitionBy("source")))
    got = {(x.source, x.doc_id): x.copies for x in mixing.copies_of(df).collect()}
    assert len(got) == len(rows)
    for s in {x[0] for x in rows}:
        want = plain_copies({(s, d): (a, v) for x, d, a, _, v in rows if x == s}, 4, 3)
        assert {d: c for (x, d), c in got.items() if x == s} == want
    words = lambda s: (sum(a * got[x, d] for x, d, a, _, _ in rows if x == s), sum(a * v for x, d, a, _, v in rows if x == s))
    for s, least in (("a", 0.05 * words("a")[1]), (None, 0), ("d", 0)):
        assert abs(words(s)[0] - words(s)[1]) <= least


def test_mix_keeps_expectations(spark):
    """Over seeds, each unit is taken about as often as its share says, and the words of all are right."""
    units = spark.range(40).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), (F.col("id") % 5 + 1).alias("size"), F.lit(40).cast("long").alias("n_units"), F.lit(120).cast("long").alias("source_size"), (F.lit(0.1) + (F.col("id") % 4) * 0.25).alias("share"))
    total, runs = collections.Counter(), 60
    for seed in range(runs):
        got = mixing.copies_of(units, seed * 1000).collect()
        assert abs(sum(r.copies * (r.doc_id % 5 + 1) for r in got) - sum((0.1 + k % 4 * 0.25) * (k % 5 + 1) for k in range(40))) <= 1
        for r in got:
            total[r.doc_id % 4] += r.copies
    for k in range(4):
        assert total[k] / (10 * runs) == pytest.approx(0.1 + 0.25 * k, abs=0.06)


def test_sources_come_near_their_targets(spark):
    """Within 2 % on the tables of the correctness check."""
    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    got = mixing.mix(spark.read.parquet(at)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) > 5 and max(abs(r.taken - r.target) / r.target for r in got if r.target) < 0.02


def test_mix_of_clashing_names(spark):
    df = spark.createDataFrame([(k, "a b c", "s", k, "x", 1, 2) for k in range(20)], "doc_id long, text string, source string, __copies long, __copy string, copies int, copy int")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in mixing.mix(df).collect()) == 30


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], none.schema)
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(empty).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_word_counts(spark):
    texts = [None, "", " ", "a", " a  b\tc\n\x0bd\x0ce\rf ", "a\u00a0b\u2003c", "x" * 10]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(n_words()).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


# ---- sharding


def brute_table(shards, slots):
    prefer = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefer.append([(offset + k * skip) % slots for k in range(slots)])
    owner = {}
    while len(owner) < slots:
        for k, order in enumerate(prefer):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = k
    return [owner[s] for s in range(slots)]


def test_table_is_filled_in_turns():
    names = [f"n{k}" for k in range(7)]
    assert sharding.fill_table(names, 101).tolist() == brute_table(names, 101)
    counts = np.bincount(sharding.fill_table([f"shard-{k}" for k in range(64)], 16381))
    assert counts.max() - counts.min() <= 1
    assert sharding.fill_table(["a"], 2).tolist() == [0, 0]


def test_table_moves_little():
    names = [f"n{k}" for k in range(20)]
    a, b = sharding.fill_table(names, 4099), sharding.fill_table(names[:-1], 4099)
    others = a != 19
    assert (a[others] == b[others]).mean() > 0.85


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], (1 << 20) + 7)])
def test_wrong_tables(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, slots)


def test_shard(spark):
    df = spark.createDataFrame([(1, "x", "s"), (1, "y", "s"), (None, None, None), (2, "", "t")], "doc_id long, text string, shard string")
    got = sharding.shard(df, shards=5, slots=101)
    rows = {(r.doc_id, r.text): r.shard for r in got.collect()}
    assert got.columns == df.columns and rows[1, "x"] == rows[1, "y"] and len(rows) == 4 and all(0 <= v < 5 for v in rows.values())
    assert sharding.shard(df.limit(0)).count() == 0
    table = sharding.fill_table([f"shard-{k}" for k in range(5)], 101)
    assert rows[2, ""] == table[int(hashlib.md5(b"2").hexdigest()[:15], 16) % 101]


def test_shard_of_clashing_names(spark):
    df = spark.createDataFrame([(k, k, "a", "b", "c") for k in range(9)], "doc_id long, slot long, Owner string, __shard string, __slot string")
    got = sharding.shard(df, shards=5, slots=101)
    assert got.columns == [*df.columns, "shard"] and {tuple(r)[:5] for r in got.collect()} == {tuple(r) for r in df.collect()}


# ---- token records

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_frames():
    payloads = [b"", b"x", b"\n" * 40, bytes(range(256))]
    data = b"".join(token_records.frame(p) + b"\n" for p in payloads)
    assert [p for _, p in token_records.frames(data)] == payloads
    assert struct.unpack_from("<Q", data)[0] == 0
    for at in (0, 9, len(data) - 3, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_records.frames(bytes(broken)))
    with pytest.raises(ValueError):
        list(token_records.frames(data[:-1]))
    for doc_id, ids in ((None, []), (-5, [1, 65535]), (7, [70000])):
        back = token_records.unpack(token_records.pack(doc_id, np.array(ids, np.uint32)))
        assert back[0] == doc_id and back[1].tolist() == ids


TEXTS = ["Hello, World! it's fine", None, "", " \n", "é É ÀÉ ß ẞ İ naïve n\u0303 日本語 текст", "a<|endoftext|>b <|startoftext|>", "x\u00a0y\u2003z\x1cq\x85w", "1234 12ab3 :-) ... 's 't", "word " * 9000, "long" * 9000, "\ufeffq a\u0301 \u0301b", "Hello, World! it's fine"]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_records, "ROW_BYTES", 100)
    monkeypatch.setattr(token_records, "FILE_ROWS", 2)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(10 * k - 30, t, 7) for k, t in enumerate(TEXTS)] + [(25, "twice", 7), (25, "twice", 7), (None, "no id", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    path = fresh_path(spark, "test-records")
    token_records.write(df, PATH, path, end=1)
    got = token_records.read(spark, path)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    start, want = 0, []
    for d, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((d, start, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        start += len(ids[d])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=str) == sorted(want, key=str)
    wanted = got.filter("doc_id > 30 OR doc_id IS NULL").orderBy(F.rand(1))
    assert sorted(((r.doc_id, r.ids) for r in token_records.fetch(spark, path, wanted).collect()), key=str) == sorted(((d, ids[d]) for d, _, _ in rows if d is None or d > 30), key=str)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """One that keeps white space."""
    import json

    import pyarrow as pa

    rules = json.load(open(PATH))
    rules["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    (tmp_path / "t.json").write_text(json.dumps(rules))
    e = token_records.Encoder(str(tmp_path / "t.json"))
    texts = ["Hello  world", None, "a b\nc"]
    assert not e.by_word and token_records.Encoder(PATH).by_word
    assert [x.tolist() for x in e.encode(pa.array(texts), 1)] == [[*e.library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_no_records(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_records.export(none, PATH).count() == 0


def test_encoder_starts_anew_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_records, "REMEMBERED", 12)
    e = token_records.Encoder(PATH)
    texts = [f"a{k} b{k} c{k % 3} the the" for k in range(40)]
    got = [x.tolist() for x in (y for t in texts for y in e.encode(pa.array([t]), None))]
    assert got == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


# ---- top-k


def held(score):
    return max(-(2**63) + 1, min(2**63 - 1, int(score)))


def brute_topk(rows, is_query, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = np.array([int(x) for x in np.floor(1024 * np.array(v, np.float64))], object)
    out = set()
    for q, x in good.items():
        if is_query(q):
            scores = sorted((-held(sum(a * b for a, b in zip(x, y, strict=False))), i) for i, y in good.items() if i != q)[:k]
            out |= {(q, r + 1, i, -int(s)) for r, (s, i) in enumerate(scores)}
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-3, 5e5])
def test_topk_is_exact(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "GROUP", 30)
    r = np.random.default_rng(5)
    centres = r.normal(0, scale, (6, 24))
    v = (centres[r.integers(0, 6, 400)] + r.normal(0, scale / 5, (400, 24))).astype(np.float32)
    v[50:90] = v[50]  # ties
    rows = [(k, [float(x) for x in v[k]]) for k in range(400)]
    rows += [(400, None), (401, [float("nan")] + [0.0] * 23), (402, [None] + [0.0] * 23), (403, [float("inf")] + [0.0] * 23), (None, [0.0] * 24), (404, [0.0] * 24), (20, rows[20][1])]
    df = spark.createDataFrame([(i, x, 3) for i, x in rows], "vec_id long, embedding array<float>, rank int").repartition(5)
    got = {tuple(x) for x in topk.search(df, F.col("vec_id") % 10 == 0, 10).collect()}
    assert got == brute_topk(rows, lambda i: i % 10 == 0, 10)


def test_topk_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert topk.search(one, F.lit(True)).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, [3.0, -1.0, 9.0])]
    assert {tuple(r) for r in topk.search(spark.createDataFrame(rows, schema), F.lit(True), 9).collect()} == brute_topk(rows, lambda i: True, 9)
    empty = [(k, []) for k in range(3)]
    assert {tuple(r) for r in topk.search(spark.createDataFrame(empty, schema), F.lit(True), 1).collect()} == brute_topk(empty, lambda i: True, 1)


def test_topk_of_huge_components(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1e20]), (2, [-3e38, 1.0]), (3, [1.0, 1.0]), (4, [1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.search(df, F.lit(True), 9).collect()} == brute_topk(rows, lambda i: True, 9)


def test_bounds_spare_exact_scores(spark):
    """On clustered vectors fewer than a tenth of all pairs are scored."""
    r = np.random.default_rng(8)
    v = r.normal(0, 1, (40, 64))[r.integers(0, 40, 3000)] + r.normal(0, 0.2, (3000, 64))
    rows = [(k, [float(x) for x in v[k]]) for k in range(3000)]
    pairs, exact = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {tuple(x) for x in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 30 == 0, 10, (pairs, exact)).collect()}
    assert got == brute_topk(rows, lambda i: i % 30 == 0, 10)
    assert pairs.value == 100 * 2999 and 1000 <= exact.value < pairs.value / 10


def test_bounds_hold():
    r = np.random.default_rng(6)
    a, b = r.normal(0, 300, (40, 64)), r.normal(50, 300, (60, 64))
    exact = a @ b.T
    ours, theirs = topk._features(a), topk._features(b, ours=False)
    bounds = [ours[s] @ theirs[s].T for s in ours]
    for bound in bounds:
        assert (bound >= exact - 1e-6).all()
    assert bounds[0].mean() > bounds[1].mean() > bounds[2].mean()
