"""The queries that apply each corpus operator to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import alignment, audit, fingerprints, labelled, minhash, mixing, pieces, quality, secrets, sharding, substrings, toxicity, vptrees, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = labelled.remainder("doc_id", 3) == 1
    scorer = quality.train(docs, labels, usable=~held_out)
    return labelled.predictions(quality.score(docs, scorer), held_out)


def op2_mix_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages")))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = labelled.remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels, usable=~held_out)
    return labelled.predictions(toxicity.score(docs, model), held_out)


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


def op10_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptrees.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, factor=1.0)


def op11_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), shards=8)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_compression, op2_mix_pivotal, op3_secret_scan, op4_warc_dictionary, op5_hyperminhash, op6_sentencepiece, op7_toxicity_fm, op8_weighted_fingerprints, op9_substring_dedup, op10_vantage_points, op11_jump_hash, op12_filter_audit, op13_token_alignment)}

ORACLES = {
    "op4_warc_dictionary": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
""",
    "op5_hyperminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM w),
n AS (SELECT w.doc_id, count(x) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m ON n.doc_id = m.doc_id
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: sha256(array_to_string(w[i:i + 49], ' ')))) AS x FROM d WHERE len(w) >= 50),
f AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x),
g AS (SELECT doc_id, unnest(range(i, i + 50)) AS i FROM s JOIN f ON s.x = f.x WHERE first < doc_id),
r AS (SELECT doc_id, list(DISTINCT i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
""",
    "op11_jump_hash": r"""
WITH RECURSIVE t AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8),
c AS (SELECT list(v ORDER BY i) AS v FROM t WHERE k = 8),
z AS (SELECT 18446744073709551616::UHUGEINT AS w),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda s, x: xor(s >> 8, c.v[(xor(s, x) & 255) + 1])), 4294967295) AS crc,
             coalesce(doc_id, -1) AS key FROM documents, c),
m0 AS (SELECT DISTINCT key, CASE WHEN key < 0 THEN (w - (-key)::UHUGEINT) ELSE key::UHUGEINT END AS x FROM d, z),
m1 AS (SELECT key, xor(x, x >> 30) * 13787848793156543929 % w AS x FROM m0, z),
m2 AS (SELECT key, xor(x, x >> 27) * 10723151780598845931 % w AS x FROM m1, z),
m3 AS (SELECT key, xor(x, x >> 31) AS x FROM m2),
j AS (SELECT key, n, x, -1::BIGINT AS b, 0::BIGINT AS nxt FROM m3, (VALUES (8), (9)) v(n)
      UNION ALL SELECT key, n, y, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((y >> 33) + 1)::DOUBLE))::BIGINT FROM (SELECT key, n, nxt, (x * 2862933555777941757 + 1) % w AS y FROM j, z WHERE nxt < n)),
s AS (SELECT key, max(b) FILTER (n = 8)::INTEGER AS shard, max(b) FILTER (n = 9)::INTEGER AS grown_shard FROM j GROUP BY key)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS slot, grown_shard FROM d JOIN s ON d.key = s.key
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 5 * length(d.text))::INT
             + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS mask
      FROM d JOIN f ON d.text = f.text LEFT JOIN k ON d.doc_id = k.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(i)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
""",
}
