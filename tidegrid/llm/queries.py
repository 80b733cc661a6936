"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

import json

import public_tokenizers

from tidegrid.llm import alignment, chat, chunks, classifier, cover, languages, lexical, near, packing, pages, quality, secrets, sharding
from tidegrid.llm.common import table
from tidegrid.session import fresh_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
# 48 shards, every fourth of double weight.
SHARDS = {f"shard-{i:03d}": 2 if i % 4 == 0 else 1 for i in range(48)}

QUERIES = {
    "op1_language_id": lambda spark, d: languages.identify(table(spark, d, "documents")),
    "op2_sentencepiece": lambda spark, d: chunks.digests(table(spark, d, "documents"), PIECES),
    "op3_quality_rules": lambda spark, d: quality.judge(table(spark, d, "documents")),
    "op4_sharding": lambda spark, d: sharding.write_shards(
        table(spark, d, "documents"), fresh_path(spark, "shards"), SHARDS).select("doc_id", "slot", "shard"),
    "op5_secret_scan": lambda spark, d: secrets.digests(table(spark, d, "documents")),
    "op6_html_extraction": lambda spark, d: pages.page_texts(table(spark, d, "pages")),
    "op7_minhash_dedup": lambda spark, d: near.clusters(table(spark, d, "documents")),
    "op8_embedding_dedup": lambda spark, d: cover.clusters(table(spark, d, "embeddings")),
    "op9_chat_format": lambda spark, d: chat.read_back(chat.format_turns(chat.with_probe(table(spark, d, "conversations")), BYTES)),
    "op10_packing": lambda spark, d: packing.pieces(table(spark, d, "documents"), BYTES),
    "op11_token_alignment": lambda spark, d: alignment.statistics(table(spark, d, "documents"), BYTES, PIECES),
    "op12_lexical_search": lambda spark, d: lexical.ranked(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_quality_classifier": lambda spark, d: classifier.classify(table(spark, d, "documents"), table(spark, d, "labels")),
}

_SHARD_SQL = f"""SELECT doc_id, slot, CAST(t.entries[slot + 1] AS INT) AS shard FROM (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SIZE} AS INT) AS slot
  FROM documents) d, (SELECT CAST('{json.dumps(sharding.lookup_table(SHARDS), separators=(",", ":"))}' AS INT[]) AS entries) t"""

_NEAR_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(
    list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT rep AS node, rep AS label FROM classes UNION SELECT s.b, w.label FROM walk w JOIN sides s ON s.a = w.node),
labels AS (SELECT node, min(label) AS label FROM walk GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(l.label, d.doc_id) AS component_id,
    d.doc_id = coalesce(l.label, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON list_sort(d.s) = c.s LEFT JOIN labels l ON l.node = c.rep"""

_COVER_SQL = """WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    AND list_cosine_similarity(a.v, b.v) >= 0.9),
walk AS (SELECT vec_id AS node, vec_id AS label FROM embeddings UNION SELECT p.b, w.label FROM walk w JOIN pairs p ON p.a = w.node),
labels AS (SELECT node, min(label) AS label FROM walk GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS n_links, l.label AS component_id, e.vec_id = l.label AS kept
FROM embeddings e JOIN labels l ON l.node = e.vec_id"""

_CHAT_SQL = r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(32 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT)
    AS formatted_chars FROM turns GROUP BY conv_id"""

_LEXICAL_SQL = r"""WITH words AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM words WHERE len(w) > 0),
counts AS (SELECT doc_id, d, n, term, count(*) AS tf FROM (SELECT doc_id, d, len(w) AS n, unnest(w) AS term FROM words) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(total.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total WHERE term IN (SELECT term FROM asked) GROUP BY term),
scores AS (SELECT item_id, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * counts.n * total.n) // total.l)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term), total GROUP BY item_id, doc_id, d)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20"""

ORACLES = {"op4_sharding": _SHARD_SQL, "op7_minhash_dedup": _NEAR_SQL, "op8_embedding_dedup": _COVER_SQL, "op9_chat_format": _CHAT_SQL, "op12_lexical_search": _LEXICAL_SQL}
