"""Registered queries of the operators in this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from prepkit.llm import bm25
from prepkit.llm.align import Alignment
from prepkit.llm.bpe import BytePairs
from prepkit.llm.chat import format_turns, read_back
from prepkit.llm.common import table
from prepkit.llm.exact_dedup import exact_groups
from prepkit.llm.langid import identify
from prepkit.llm.line_dedup import LineDedup
from prepkit.llm.mixing import Mix
from prepkit.llm.packing import pack_documents
from prepkit.llm.secrets import scan_secrets
from prepkit.llm.simhash import near_duplicates
from prepkit.llm.toxicity import toxicity
from prepkit.llm.trie import PrefixTrie, conversations, share_heads


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id 100 divides."""
    return bm25.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], chats.schema)
    return read_back(format_turns(chats.union(extra)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup does to each document; line numbers count from 0."""
    found = LineDedup(table(spark, sf_dir, "documents")).documents()
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "n_links")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).taken()


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BytePairs(table(spark, sf_dir, "documents")).digests()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PrefixTrie(share_heads(conversations(table(spark, sf_dir, "conversations")))).nodes()


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents")).documents()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bm25_search, op2_toxicity, op3_chat_formatting, op4_packing, op5_language_id, op6_simhash_dedup,
                            op7_line_dedup, op8_secret_scans, op9_exact_dedup, op10_mixing, op11_byte_bpe,
                            op12_prefix_trie, op13_tokenizer_alignment)}

ORACLE: dict[str, str] = {
    "op1_bm25_search": r"""
WITH tok AS (
  SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
stat AS (SELECT count(*) AS n, (SELECT sum(dl) FROM len) / count(*) AS mean FROM documents),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stat GROUP BY term, n),
score AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = d.doc_id, stat
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM best WHERE rank <= 10""",
    "op3_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE)', '\1\1\\\2', 'g'))
         + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 ELSE 16 + length(url_encode(role)) END AS n
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, true AS round_trip
FROM sized GROUP BY conv_id""",
    "op7_line_dedup": r"""
WITH line AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line,
         unnest(string_split(coalesce(text, ''), chr(10))) AS body
  FROM documents),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+'))) AS words
  FROM line),
class AS (
  SELECT words, len(words) AS n, min((doc_id, line)) AS first, row_number() OVER () AS c
  FROM sets WHERE len(words) >= 1 GROUP BY words),
word AS (SELECT c, n, unnest(words) AS w FROM class),
seen AS (SELECT w, count(*) AS times FROM word GROUP BY w),
ranked AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY times, w) AS pos FROM word JOIN seen USING (w)),
prefix AS (SELECT * FROM ranked WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
pair AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM prefix a JOIN prefix b USING (w)
  WHERE a.c <> b.c AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
link AS (
  SELECT a, b, y.first AS other FROM pair JOIN class x ON x.c = a JOIN class y ON y.c = b
  WHERE len(list_intersect(x.words, y.words)) >= 0.8 * (x.n + y.n - len(list_intersect(x.words, y.words))) - 1e-9),
near AS (SELECT a AS c, count(*) AS links, min(other) AS other FROM link GROUP BY a),
judged AS (
  SELECT s.doc_id, s.line, coalesce(links, 0) AS links,
         coalesce(least(first, coalesce(other, first)) < (s.doc_id, s.line), false) AS removed
  FROM sets s LEFT JOIN class USING (words) LEFT JOIN near USING (c))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
       coalesce(string_agg(line, ',' ORDER BY line) FILTER (removed), '') AS removed, CAST(sum(links) AS BIGINT) AS n_links
FROM judged GROUP BY doc_id""",
    "op9_exact_dedup": r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM base WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id NULLS LAST)""",
    "op12_prefix_trie": r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
coded AS (SELECT *, md5(length(role) || ':' || role || text) AS digest FROM given),
turns AS (
  SELECT conv_id, digest, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos FROM coded),
ids AS (
  SELECT conv_id, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, k: xor(t >> 1, (t & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM given)),
rebuilt AS (
  SELECT i.conv_id, pos, digest, size FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND pos <= h
  UNION ALL SELECT i.conv_id, pos, digest, size FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND pos > h),
steps AS (SELECT *, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS node FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
prefix AS (
  SELECT conv_id, depth, size, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS parent FROM steps
  UNION ALL SELECT conv_id, 0, 0, 'root', NULL FROM ids),
node AS (SELECT node, parent, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefix GROUP BY node, parent, depth),
kids AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT over.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved_tokens
  FROM node x JOIN prefix over ON over.conv_id = x.conv_id AND over.depth <= x.depth LEFT JOIN kids k ON k.node = x.node GROUP BY over.node),
last AS (SELECT conv_id, max_by(node, depth) AS node FROM prefix GROUP BY conv_id),
ends AS (SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM last GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node n LEFT JOIN node p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node""",
}
