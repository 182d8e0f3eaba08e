"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, divergence, html_text, language, mixing, near_dups, neighbours, packing, personal, repair, repeats, sharding, token_store
from .common import table


def _tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark, table(spark, sf_dir, "embeddings"), query_mod=50, k=5)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.cluster(spark, table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(spark, table(spark, sf_dir, "documents"), alpha=0.5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), _tokenizer(), capacity=4096, end_id=1)


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(spark, table(spark, sf_dir, "documents"), length=200)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = token_store.store_tokens(spark, table(spark, sf_dir, "documents"), _tokenizer(), end_id=2)
    return token_store.read_shards(manifest)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(spark, table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"), shards=16)


def op10_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(spark, docs, docs.where("doc_id % 20 = 0"), k=10).withColumn("score", F.round("score", 6))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(spark, table(spark, sf_dir, "conversations"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nearest_neighbours, op2_near_duplicates, op3_source_mixing, op4_best_fit_packing, op5_repeated_strings, op6_token_store, op7_html_text, op8_language_id, op9_sharding, op10_bm25_search, op11_source_divergence, op12_conversation_repair, op13_personal_data)}


#: Words of whole texts, A-Z in lower case.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{}]+'), lambda w: w <> '')"

NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("\\x20\\x09-\\x0D")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) g USING (doc_id)"""

REPEATED_STRINGS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, c, substr(h, 400 * c + 1, 800) AS part FROM (SELECT doc_id, h, unnest(range(0, (n - 1) // 200 + 1)) AS c FROM d WHERE n >= 200)),
k AS (SELECT doc_id, 200 * c + i + 1 AS p, md5(substr(part, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, c, part, unnest(range(0, least(200, length(part) // 2 - 199))) AS i FROM c)),
hit AS (SELECT doc_id, p FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 199 AS b FROM g GROUP BY doc_id, g),
s AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM r),
o AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1)::BIGINT AS n_removed, string_agg(substr(h, 2 * c + 1, 2 * (a - c - 1)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM s JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

BM25_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F")} AS w FROM documents),
d AS (SELECT doc_id, len(w) AS size FROM w WHERE len(w) > 0),
stats AS (SELECT count(*) AS n, sum(size)::DOUBLE / count(*) AS mean FROM d),
tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY ALL),
idf AS (SELECT t, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf CROSS JOIN stats GROUP BY t, n),
scored AS (SELECT q.doc_id AS query_id, tf.doc_id, sum(idf * tf.f * 2.2::DOUBLE / (tf.f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score
  FROM tf q JOIN idf USING (t) JOIN tf USING (t) JOIN d ON d.doc_id = tf.doc_id CROSS JOIN stats WHERE q.doc_id % 20 = 0 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM placed WHERE rank <= 10"""


SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) + 2 * count(*) AS whole FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.n, 0)::HUGEINT AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
gw AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 2) // (gw.n + 2 * v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // v.whole AS q FROM c JOIN gw ON gw.lang = c.lang AND gw.source = c.source JOIN v ON v.lang = c.lang JOIN kept k ON k.lang = c.lang AND k.term = c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM placed WHERE part = 'pair' OR rank <= 10"""

#: The cheapest edits forwards, row by row, with the least of equally cheap audits.
CONVERSATION_REPAIR_SQL = r"""
WITH RECURSIVE source AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 20 AS kind FROM source),
damaged AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS o, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS said FROM damaged),
faults AS (SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, said > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
rows_ AS (SELECT *, lag(i) OVER (PARTITION BY c ORDER BY o) AS before FROM faults),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (WHERE o > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c),
inserts AS (SELECT * FROM (VALUES (0, '', 0, 0, []::VARCHAR[]), (0, 'I', 2, 2, ['user:']), (0, 'II', 4, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 2, 2, ['user:']), (1, 'II', 4, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 2, 3, ['assistant:']), (2, 'II', 4, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 2, 2, ['user:']), (3, 'II', 4, 3, ['user:', 'assistant:'])) AS t(q, ops, cost, q2, lines)),
steps AS (
  SELECT c, o, q, 'D' AS op, 3 AS cost, q AS q2, []::VARCHAR[] AS lines FROM rows_ CROSS JOIN range(4) AS s(q)
  UNION ALL SELECT c, o, q, 'R', 2 + cut::INT, CASE q WHEN 2 THEN 3 ELSE 2 END, [CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] FROM rows_ CROSS JOIN range(4) AS s(q) WHERE NOT blank AND NOT again
  UNION ALL SELECT c, o, q, 'K', cut::INT, q2, [role || ':' || text] FROM rows_ JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS s(q, i, q2) USING (i) WHERE NOT blank AND NOT again),
dp(c, o, q, best) AS (
  SELECT DISTINCT c, 0::BIGINT, 0::BIGINT, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM damaged
  UNION ALL SELECT d.c, d.o + 1, s.q2::BIGINT, min({'cost': (d.best.cost + i.cost + s.cost)::BIGINT, 'audit': d.best.audit || i.ops || s.op, 'lines': list_concat(list_concat(d.best.lines, i.lines), s.lines)})
  FROM dp d JOIN inserts i ON i.q = d.q JOIN steps s ON s.c = d.c AND s.o = d.o + 1 AND s.q = i.q2 GROUP BY d.c, d.o, s.q2),
ends AS (SELECT n.c, min({'cost': d.best.cost + i.cost, 'audit': d.best.audit || i.ops, 'lines': list_concat(d.best.lines, i.lines)}) AS best FROM n JOIN dp d ON d.c = n.c AND d.o = n.n JOIN inserts i ON i.q = d.q WHERE i.q2 IN (0, 3) GROUP BY n.c)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM source) s LEFT JOIN n ON n.c = s.c LEFT JOIN ends ON ends.c = s.c"""


def oracle_sql() -> dict[str, str]:
    """Where SQL says the same over whole tables; the other queries are tested against brute force."""
    return {"op2_near_duplicates": NEAR_DUPLICATES_SQL, "op5_repeated_strings": REPEATED_STRINGS_SQL, "op10_bm25_search": BM25_SQL, "op11_source_divergence": SOURCE_DIVERGENCE_SQL, "op12_conversation_repair": CONVERSATION_REPAIR_SQL}
