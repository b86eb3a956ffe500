"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import common as C
from cairn.llm import decontam, license, mixing, neardup, quality, sharding, substring, tokens, topk, toxicity

#: The id that ends each document, and the vocabulary, of the token query.
END_ID, VOCABULARY = 1, "word_bpe_49k.json"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=64.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(C.table(spark, sf_dir, "documents"), 8, keep=["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.drop("rk")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(C.table(spark, sf_dir, "documents")).drop("blocks")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(C.table(spark, sf_dir, "documents"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, path = C.scratch(spark), public_tokenizers.path(VOCABULARY)
    width = tokens.id_width(path)
    manifest = tokens.write_tokens(C.table(spark, sf_dir, "documents"), folder, path, END_ID, width=width)
    return tokens.read_tokens(manifest, folder, width)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(C.table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(C.table(spark, sf_dir, "documents"), window=35).drop("kept_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_topk, op2_toxicity, op3_sharding, op4_decontamination, op5_license, op6_mixing, op7_tokens, op8_quality, op9_neardup, op10_substring)
    return {f.__name__: f for f in ops}


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY source),
w AS (SELECT source, n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, sum(n) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(3 * n) OVER b, 0) AS caps, sum(w) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW b AS (ORDER BY 3.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
k AS (SELECT total - caps AS left_, open FROM o WHERE (total - caps) * w <= 3 * n * open ORDER BY 3.0 * n / w, source LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN 3 * n * open < left_ * w THEN CAST(3 * n AS DOUBLE) ELSE CAST(left_ * w AS DOUBLE) / CAST(open AS DOUBLE) END AS target
  FROM w, k
),
r AS (
  SELECT doc_id, size, n, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, copies, copies * size AS taken FROM c
"""


CRC_SQL = """
b AS (SELECT range AS i, range AS c FROM range(256)),
steps AS (SELECT i, list_reduce(list_prepend(c, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM b),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps)"""

#: Minimax cuts: the least capacity by bisection, each tried greedily with eight shards over the running sums of groups.
SHARDING_SQL = (
    "WITH RECURSIVE "
    + CRC_SQL
    + r"""
,
d AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, coalesce(substr(sha256(text), 1, 32), 'null') AS g,
    CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc
),
g AS (SELECT g, sum(size) AS bytes, min(doc_id) AS f FROM d GROUP BY g),
e AS (SELECT g, bytes, CAST(sum(bytes) OVER (ORDER BY f NULLS FIRST, g ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM g),
l AS (SELECT list(e ORDER BY e) AS l, max(e) AS total, max(bytes) AS largest FROM e),
tries(l, total, bad, good) AS (
  SELECT l, total, CAST(greatest(ceil(total / 8.0), largest) - 1 AS BIGINT), CAST(greatest(ceil(total / 8.0), largest) + largest AS BIGINT) FROM l
  UNION ALL
  SELECT l, total, CASE WHEN ok THEN bad ELSE mid END, CASE WHEN ok THEN mid ELSE good END FROM (
    SELECT l, total, bad, good, mid, list_reduce([0, 1, 2, 3, 4, 5, 6, 7, 8], lambda z, x: coalesce(list_max(list_filter(l, lambda y: y <= z + mid)), 0)) = total AS ok
    FROM (SELECT *, (bad + good) // 2 AS mid FROM tries WHERE good - bad > 1)
  )
),
c0 AS (SELECT l, good AS c, list_max(list_filter(l, lambda y: y <= good)) AS c1 FROM tries WHERE good - bad <= 1),
c2 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c1 + c)) AS c2 FROM c0),
c3 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c2 + c)) AS c3 FROM c2),
c4 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c3 + c)) AS c4 FROM c3),
c5 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c4 + c)) AS c5 FROM c4),
c6 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c5 + c)) AS c6 FROM c5),
c7 AS (SELECT *, list_max(list_filter(l, lambda y: y <= c6 + c)) AS c7 FROM c6),
s AS (SELECT e.g, CAST((e > c1)::INT + (e > c2)::INT + (e > c3)::INT + (e > c4)::INT + (e > c5)::INT + (e > c6)::INT + (e > c7)::INT AS INTEGER) AS shard FROM e, c7)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size, g) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN s USING (g)
"""
)


def license_sql() -> str:
    """Base phrases by the places of their words; notices by counting distinct template words from each start near one."""
    rows = [(t, x.label, len(x.words), x.need, x.size, x.phrase, i, w) for t, x in enumerate((*license.BASE, *license.NOTICES)) for i, w in enumerate(x.words)]
    values = ", ".join(f"({t}, '{label}', {m}, {need}, {size}, {phrase}, {i}, '{w}')" for t, label, m, need, size, phrase, i, w in rows)
    return rf"""
WITH tw(t, label, m, need, size, phrase, i, w) AS (VALUES {values}),
tpl AS (SELECT DISTINCT t, label, m, need, size, phrase FROM tw),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
n AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM d),
p AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM d),
spot AS (SELECT r, p, w FROM p SEMI JOIN tw USING (w)),
base AS (
  SELECT r, t, p - i AS s FROM spot JOIN tw USING (w) WHERE phrase GROUP BY r, t, p - i, m HAVING count(*) = m
),
tok AS (SELECT DISTINCT t, w FROM tw WHERE NOT phrase),
has AS (SELECT r, t FROM (SELECT DISTINCT r, w FROM spot) JOIN tok USING (w) JOIN tpl USING (t) GROUP BY r, t, need HAVING count(*) >= need),
near AS (SELECT has.r, has.t, p, spot.w FROM has JOIN spot USING (r) JOIN tok ON tok.t = has.t AND tok.w = spot.w),
starts AS (
  SELECT DISTINCT r, t, least(s, greatest(n - m, 0)) AS s FROM (SELECT r, t, m, n, unnest(range(greatest(p - m + 1, 0), p + 1)) AS s FROM near JOIN tpl USING (t) JOIN n USING (r))
),
held AS (
  SELECT s.r, s.t, s.s, count(DISTINCT near.w) AS c FROM starts s JOIN tpl USING (t) JOIN near ON near.r = s.r AND near.t = s.t AND p >= s AND p < s + m GROUP BY ALL
),
hit AS (
  SELECT r, label, CAST(c AS DOUBLE) / size AS share, NULL AS s FROM held JOIN tpl USING (t) WHERE c >= need
  UNION ALL SELECT r, label, 1.0, s FROM base JOIN tpl USING (t)
),
by_doc AS (
  SELECT r, count(s) AS n_base, min(s) AS first_word, max(s) AS last_word, max(share) AS score,
    array_to_string(list_sort(list(DISTINCT label) FILTER (s IS NOT NULL)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM hit GROUP BY r
)
SELECT doc_id, n AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM n LEFT JOIN by_doc USING (r)
"""


NEARDUP_SQL = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, n, md5(string_agg(x, ' ' ORDER BY x)) AS k FROM s JOIN n USING (doc_id) GROUP BY doc_id, n),
rep AS (SELECT k, n, min(doc_id) AS id FROM sets GROUP BY k, n),
held AS (SELECT s.doc_id AS id, x, n, count(*) OVER (PARTITION BY x) AS c FROM s JOIN rep ON s.doc_id = rep.id),
ranked AS (SELECT id, x, n, row_number() OVER (PARTITION BY id ORDER BY c, x) AS place FROM held),
prefix AS (SELECT id, x, n FROM ranked WHERE place <= n - CAST(ceil(0.85 * n - 1e-9) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
both_ AS (SELECT a, b, na, nb, count(*) AS c FROM cand JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b AND q.x = p.x GROUP BY ALL),
link AS (SELECT a, b FROM both_ WHERE 100 * c >= 85 * (na + nb - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT id, id FROM rep UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
part AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN rep USING (k, n) LEFT JOIN part ON part.a = rep.id
"""

#: Windows that hold a shingle of an item, for pairs that share enough of them; similarity by multisets of shingles.
DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
i0 AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{license.UPPER}', '{license.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
i AS (SELECT q, item_id, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM i0 WHERE len(w) > 0),
ix AS (SELECT q, k, array_to_string(list_slice(w, p + 1, p + k), ' ') AS x FROM (SELECT q, w, k, unnest(range(m)) AS p FROM i)),
ic AS (SELECT q, k, x, count(*) AS c FROM ix GROUP BY ALL),
dx AS (
  SELECT r, k, n, p, array_to_string(list_slice(w, p + 1, p + k), ' ') AS x
  FROM (SELECT r, w, k, len(w) - k + 1 AS n, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
),
hit AS (SELECT r, q, p, x, c, n, m, least(n, m) AS size FROM dx JOIN ic USING (k, x) JOIN (SELECT q, m FROM i) USING (q)),
pair AS (SELECT r, q FROM hit GROUP BY r, q, m HAVING 100 * count(*) >= 80 * m),
near AS (SELECT * FROM hit SEMI JOIN pair USING (r, q)),
start AS (SELECT DISTINCT r, q, s FROM (SELECT r, q, unnest(range(greatest(p - size + 1, 0), least(p, n - size) + 1)) AS s FROM near)),
held AS (SELECT t.r, t.q, t.s, x, c, m, size, count(*) AS own FROM start t JOIN near h ON h.r = t.r AND h.q = t.q AND p >= t.s AND p < t.s + size GROUP BY ALL),
sums AS (SELECT r, q, s, m, size, CAST(sum(least(own, c)) AS BIGINT) AS b FROM held GROUP BY ALL),
found AS (
  SELECT r, item_id, CAST(b AS DOUBLE) / (size + m - b) AS similarity, s, size + k - 1 AS n_words FROM sums JOIN (SELECT q, item_id, k FROM i) USING (q) WHERE 100 * b >= 80 * (size + m - b)
),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, s) AS place FROM found)
SELECT doc_id, item_id, similarity, CAST(s AS BIGINT) AS first_word, CAST(n_words AS BIGINT) AS n_words FROM best JOIN d USING (r) WHERE place = 1
"""

SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT r, s, array_to_string(list_slice(w, s, s + 34), ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM v GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM v JOIN twice USING (k)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": TOPK_SQL,
        "op3_sharding": SHARDING_SQL,
        "op4_decontamination": DECONTAMINATION_SQL,
        "op5_license": license_sql(),
        "op6_mixing": MIXING_SQL,
        "op9_neardup": NEARDUP_SQL,
        "op10_substring": SUBSTRING_SQL,
    }
