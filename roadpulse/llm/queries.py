"""The operators as registered queries, with their oracle SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, exact_dedup, language, mixing, packing, prefix_trie, quality, sharding, simhash, suffix_dedup, url_filter
from .common import read_table
from .url_filter import Rule

URL_RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, map_path=sharding.map_folder(spark, sf_dir, "op5_sharding")).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    made = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer)
    return made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"), group=20, most=4)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def registered():
    ops = (
        op1_url_filter,
        op2_simhash,
        op3_chat,
        op4_mixing,
        op5_sharding,
        op6_quality,
        op7_decontam,
        op8_exact_dedup,
        op9_suffix_dedup,
        op10_language,
        op11_packing,
        op12_prefix_trie,
        op13_divergence,
    )
    return {f.__name__: f for f in ops}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# CRC-32 of the ASCII string ``s`` in DuckDB; 4294967295 and 3988292384 are its fixed values.
CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda v, step: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""


def oracle() -> dict[str, str]:
    turn = f"'{chat.TURN_OPEN}' || coalesce(role, '{chat.NO_ROLE}') || chr(10) || coalesce(text, '') || '{chat.TURN_CLOSE[:-1]}' || chr(10)"
    return {
        "op3_chat": f"""
WITH numbered AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
turns AS (
  SELECT conv_id, alone, {turn} AS said, count(*) OVER (PARTITION BY conv_id, alone) AS n,
         row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM numbered),
prefixes AS (
  SELECT conv_id, n, pos, string_agg(said, '') OVER (PARTITION BY conv_id, alone ORDER BY pos) AS rendered FROM turns),
whole AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, 0::BIGINT AS part, rendered
  FROM prefixes WHERE pos = n GROUP BY n, rendered)
SELECT * FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.pos = w.n_turns AND p.rendered = w.rendered)""",
        "op8_exact_dedup": f"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
made AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM low GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM low JOIN made USING (t)""",
        "op12_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS j
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, c::VARCHAR AS s, c - c % 20 AS donor, count(*) AS n FROM t GROUP BY c),
drawn AS (SELECT c, donor, n, {CRC32} % 4 AS h FROM own),
convs AS (
  SELECT a.c, a.donor, a.h, least(a.h, coalesce(b.n, 0)) AS took FROM drawn a LEFT JOIN own b ON b.c = a.donor),
rebuilt AS (
  SELECT v.c, j + 1 AS d, r, x FROM convs v JOIN t ON t.c = v.donor AND j < took
  UNION ALL
  SELECT v.c, j - h + took + 1, r, x FROM convs v JOIN t ON t.c = v.c AND j >= h),
paths AS (
  SELECT c, d, x, string_agg(length(r) || ':' || r || length(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d) AS k
  FROM rebuilt
  UNION ALL
  SELECT c, 0, '', '' FROM convs),
turns AS (SELECT *, max(d) OVER (PARTITION BY c) AS m FROM paths),
nodes AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(x), '[^\x20\x09-\x0D]+')) AS words,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = m), '') AS ends
  FROM turns GROUP BY d, k),
parented AS (SELECT n.*, q.k AS pk FROM nodes n LEFT JOIN paths q ON q.c = n.conv_id AND q.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM parented WHERE d > 0 GROUP BY ALL),
whole AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children, u.conv_id AS parent_conv_id
  FROM parented p LEFT JOIN kids USING (d, k) LEFT JOIN nodes u ON u.d = p.d - 1 AND u.k = p.pk),
sums AS (
  SELECT q.d, q.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM whole v JOIN paths q ON q.c = v.conv_id AND q.d <= v.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM whole JOIN sums USING (d, k)""",
        "op13_divergence": f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
met AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM groups JOIN kept USING (lang) LEFT JOIN met USING (lang, source, term)),
p AS (
  SELECT lang, source, term, c,
         (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v))::HUGEINT AS p
  FROM filled JOIN kinds USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c FROM met GROUP BY ALL),
q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v))::HUGEINT AS q
  FROM whole JOIN kinds USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
        "op9_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT rid, doc_id, unnest(range(0, length(h) // 2)) AS k FROM d),
w AS (SELECT rid, k, b.doc_id, substr(h, 2 * k + 1, 100) AS s FROM b JOIN d USING (rid) WHERE 2 * k + 100 <= length(h)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT rid, k, k AS start FROM w JOIN least USING (s) WHERE m < doc_id),
seen AS (
  SELECT b.rid, b.k, max(start) OVER (PARTITION BY b.rid ORDER BY b.k) AS last_start
  FROM b LEFT JOIN hit ON hit.rid = b.rid AND hit.k = b.k),
gone AS (SELECT rid, k, coalesce(k - last_start < 50, false) AS g FROM seen),
runs AS (SELECT rid, k, g, g AND NOT lag(g, 1, false) OVER (PARTITION BY rid ORDER BY k) AS first FROM gone),
kept AS (
  SELECT rid, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE first) AS n_spans,
         string_agg(substr(h, 2 * k + 1, 2), '' ORDER BY k) FILTER (WHERE NOT g) AS rest
  FROM runs JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)""",
    }
