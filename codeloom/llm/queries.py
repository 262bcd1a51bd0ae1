"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, mixing, near_dedup, sharding, substring_dedup, token_records, topk, toxicity, url_filter
from .shared import docs_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(docs_table(spark, sf_dir), texts=False)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = docs_table(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    records = token_records.export(docs_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return records.select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds: doc_id, item_id, start, similarity."""
    return decontaminate.leaks(docs_table(spark, sf_dir), docs_table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(docs_table(spark, sf_dir, "pages"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(docs_table(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(docs_table(spark, sf_dir).select("doc_id"), shards=64, slots=16381)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and license notice that it holds: doc_id, license, start, containment."""
    return license_scan.scan(docs_table(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.fit(docs, docs_table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= toxicity.ALERT).cast("int").alias("predicted")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", predicted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_topk": op2_topk,
        "op3_token_records": op3_token_records,
        "op4_decontamination": op4_decontamination,
        "op5_url_filter": op5_url_filter,
        "op6_near_dedup": op6_near_dedup,
        "op7_sharding": op7_sharding,
        "op8_mixing": op8_mixing,
        "op9_license_scan": op9_license_scan,
        "op10_toxicity": op10_toxicity,
    }


_SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_SQL_OP1 = f"""WITH doc AS MATERIALIZED (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM doc)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM win WHERE k IN (SELECT k FROM twice)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM doc),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id"""

_SQL_OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

#: Every window that holds a shingle of an item, without fingerprints.
_SQL_OP4 = f"""WITH doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-/:-`{{-\\x7F]+') AS w FROM documents),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x00-/:-`{{-\\x7F]+') AS w FROM benchmark),
item AS MATERIALIZED (SELECT item_id, w, len(w) AS l, least({decontaminate.SHINGLE}, len(w)) AS s FROM bench WHERE len(w) > 0),
igram AS MATERIALIZED (SELECT item_id, l, s, l - s + 1 AS n, g, count(*) AS c FROM (SELECT item_id, l, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, l - s + 2)) AS i FROM item)) GROUP BY ALL),
dgram AS (SELECT doc_id, len(w) AS dl, s, p, array_to_string(w[p + 1:p + s], ' ') AS g FROM (SELECT doc_id, w, s, unnest(range(0, len(w) - s + 1)) AS p FROM doc, (SELECT DISTINCT s FROM item))),
hit AS (SELECT doc_id, item_id, p, g, c, n, dl, least(l, dl) AS wl, least(l, dl) - s + 1 AS own FROM dgram JOIN igram USING (s, g)),
win AS (SELECT doc_id, item_id, g, c, n, own, p, unnest(range(greatest(0, p - own + 1), least(p, dl - wl) + 1)) AS start FROM hit),
part AS (SELECT doc_id, item_id, start, n, own, least(count(*), c) AS m FROM win GROUP BY doc_id, item_id, start, n, own, g, c),
whole AS (SELECT doc_id, item_id, start, n, own, CAST(sum(m) AS DOUBLE) AS m FROM part GROUP BY ALL)
SELECT doc_id, item_id, start, similarity FROM (SELECT doc_id, item_id, start, m / (n + own - m) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m / (n + own - m) DESC, start) AS r FROM whole WHERE m >= {decontaminate.THRESHOLD} * (n + own - m) - 1e-9) WHERE r = 1"""

_SQL_OP6 = f"""WITH RECURSIVE doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
gram AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM doc WHERE len(ws) > 0)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, d.doc_id = coalesce(l.c, d.doc_id) AS kept FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id"""


def _sql_op9() -> str:
    """Each template against every window of the scan's sizes and steps, without bands and anchors."""
    parts = []
    for name, text in license_scan.TEMPLATES:
        words = license_scan._words(text)
        size, step = license_scan._shape(len(words))
        want = license_scan._shingles(words)
        parts.append(f"SELECT '{name}' AS license, {size} AS size, {step} AS step, {want!r} AS wanted")
    return f"""WITH doc AS MATERIALIZED (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL),
template AS MATERIALIZED ({' UNION ALL '.join(parts)}),
gram AS (SELECT doc_id, s, p, array_to_string(w[p + 1:p + s], ' ') AS g FROM (SELECT doc_id, w, s, unnest(range(0, len(w) - s + 1)) AS p FROM doc, (SELECT DISTINCT least(5, size - 1) AS s FROM template))),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, license, size, step, s, len(wanted) AS n, p, g FROM gram JOIN (SELECT *, least(5, size - 1) AS s, unnest(wanted) AS g FROM template) USING (s, g)),
place AS (SELECT DISTINCT doc_id, license, size, step, n, unnest(range(greatest(0, CAST(ceil((p - size + s) / step) AS BIGINT)), p // step + 1)) * step AS start FROM hit),
held AS (SELECT x.doc_id, x.license, x.start, count(DISTINCT g)::DOUBLE / x.n AS containment FROM place x JOIN hit h ON h.doc_id = x.doc_id AND h.license = x.license AND h.p >= x.start AND h.p + s <= x.start + x.size GROUP BY x.doc_id, x.license, x.start, x.n)
SELECT doc_id, license, start, containment FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS r FROM held WHERE containment >= {license_scan.CONTAINED}) WHERE r = 1"""


def _sql_op5(levels: int = 8) -> str:
    """The tree by lists and windows, unrolled for paths of so many segments (the first, before the leading slash, counts)."""
    R = url_filter
    fits = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for _, r in R.RULES}
    rules = " UNION ALL ".join(f"SELECT *, '{r}' AS rule, '{v}' AS label FROM page WHERE {fits[r]}" for v, r in R.RULES)
    out = f"""WITH page AS MATERIALIZED (SELECT page_id, translate(string_split_regex(u, '[/?#]')[1], '{R.UPPER}', '{R.LOWER}') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS u FROM pages)),
fit AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(label, len(rule)) AS label FROM ({rules}) GROUP BY page_id),
judged AS MATERIALIZED (SELECT page.*, rule, label, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM page LEFT JOIN fit USING (page_id)),
x0 AS MATERIALIZED (SELECT host, shape, string_split(shape, '/') AS seg, '' AS t, count(*) AS n, count(label) AS known, count(*) FILTER (label = 'block') AS bad FROM judged GROUP BY host, shape),"""
    for k in range(levels):
        out += f"""
a{k} AS (SELECT *, seg[{k + 1}] AS s, array_to_string(list_transform(seg[{k + 2}:], lambda z: '/' || z), '') AS rest, sum(n) OVER (PARTITION BY host, t) AS total, sum(n) OVER (PARTITION BY host, t, seg[{k + 1}]) AS own FROM x{k} WHERE len(seg) > {k}),
b{k} AS MATERIALIZED (SELECT *, CASE WHEN count(DISTINCT s) OVER (PARTITION BY host, t) > {R.MANY} AND own * {R.SHARE} < total THEN '*' ELSE s END AS g FROM a{k}),
d{k} AS MATERIALIZED (SELECT host, t, g, sum(n)::DOUBLE AS n, sum(known)::DOUBLE AS known, sum(bad)::DOUBLE AS bad FROM b{k} GROUP BY ALL),
f{k} AS MATERIALIZED (SELECT host, t, g, rest, sum(l.n) / any_value(d{k}.n) AS p FROM b{k} l JOIN d{k} USING (host, t, g) GROUP BY ALL),
o{k} AS (SELECT y.host, y.t, y.g AS big, z.g AS small, sum(least(y.p, z.p)) AS common FROM f{k} y JOIN f{k} z ON y.host = z.host AND y.t = z.t AND y.rest = z.rest GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT o.host, o.t, big, small, y.n FROM o{k} o JOIN d{k} y ON y.host = o.host AND y.t = o.t AND y.g = big JOIN d{k} z ON z.host = o.host AND z.t = o.t AND z.g = small
  WHERE common >= {R.LIKE} - 1e-9 AND (y.n, small) > (z.n, big) AND (y.bad * z.known - z.bad * y.known) ** 2 * (y.known + z.known) <= 4 * (y.bad + z.bad) * (y.known + z.known - y.bad - z.bad) * y.known * z.known),
j{k} AS (SELECT host, t, small AS g, first(big ORDER BY n DESC, big) AS into_ FROM s{k} l WHERE NOT EXISTS (SELECT 1 FROM s{k} r WHERE r.host = l.host AND r.t = l.t AND r.small = l.big) GROUP BY ALL),
x{k + 1} AS MATERIALIZED (SELECT host, shape, seg, t || '/' || coalesce(into_, g) AS t, n, known, bad FROM b{k} LEFT JOIN j{k} USING (host, t, g) UNION ALL SELECT * FROM x{k} WHERE len(seg) <= {k}),"""
    return out + f"""
verdict AS (SELECT host, shape, CASE WHEN sum(bad) OVER w + {R.SMOOTH}e0 / 2 >= {R.PURITY}e0 * (sum(known) OVER w + {R.SMOOTH}e0) THEN 'block' ELSE 'allow' END AS v FROM x{levels} WINDOW w AS (PARTITION BY host, t))
SELECT page_id, judged.host, path, rule, coalesce(label, v) AS verdict FROM judged JOIN verdict ON verdict.host = judged.host AND verdict.shape = judged.shape"""


def oracle_sql() -> dict[str, str]:
    owners = sharding.fill_table([f"shard-{k}" for k in range(64)], 16381).tolist()
    return {
        "op1_substring_dedup": _SQL_OP1,
        "op2_topk": _SQL_OP2,
        "op4_decontamination": _SQL_OP4,
        "op5_url_filter": _sql_op5(),
        "op6_near_dedup": _SQL_OP6,
        "op9_license_scan": _sql_op9(),
        "op7_sharding": f"""SELECT doc_id, CAST(({owners})[1 + ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % 16381] AS INTEGER) AS shard FROM documents""",
    }
