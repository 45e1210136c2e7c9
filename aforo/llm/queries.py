"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.llm import chat, decontam, exact, ibf, language, lm, merkle, mixing, repair, simhash, tokenfile, urls, warc
from aforo.llm.common import table
from aforo.session import scratch_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("h")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = language.bucket_of("doc_id", 7)
    return lm.scores(table(spark, sf_dir, "documents"), rest != 2, rest == 2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    records = warc.read_records(index)
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes",
        F.when(~F.col("intact"), F.raise_error(F.lit("a record lost its payload"))).otherwise(F.col("intact")).alias("intact"),
    )


URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"messages": [{"role": role, "content": said} for role in ("user", "assistant")]})
    rows = chat.variants_of_table(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"])
    odd = spark.range(1).select(F.lit(-7).alias("conv_id"), F.lit(0).cast("long").alias("first"), F.parse_json(F.lit(extra)).alias("v"))
    # digests are over the roles as they were read
    turns = chat.turns_of_variants(rows.unionByName(odd)).withColumn("role", F.col("role_read"))
    return chat.conversation_digests(chat.stored_conversations(turns))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_ids(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = language.bucket_of("doc_id", 5)
    found = language.predict(docs, language.fit(docs, rest != 0))
    return found.withColumn("held_out", F.coalesce(language.bucket_of("doc_id", 5) == 0, F.lit(False)))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibf.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, quality=mixing.fitted_quality(docs, table(spark, sf_dir, "labels"))).drop("text_hash")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_lm_scores": op2_lm_scores,
    "op3_warc": op3_warc,
    "op4_url_filter": op4_url_filter,
    "op5_chat": op5_chat,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_fingerprints": op9_fingerprints,
    "op10_mixing": op10_mixing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of ASCII text: eight shifts a byte."""
    byte = "list_reduce([xor({0}, {1}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda s, b: {byte.format('s', 'b')}), 4294967295)"


def _field(value: str) -> str:
    return f"COALESCE(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op3_warc": """
WITH p AS (SELECT page_id, sha256(COALESCE(html, '')) AS d, octet_length(encode(COALESCE(html, ''))) AS n FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to,
       CASE WHEN n >= 100 AND page_id <> m THEN 0 ELSE CAST(n AS BIGINT) END AS stored_bytes, TRUE AS intact
FROM f""",
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>|/?start_of_turn>|/?end_of_turn>|bos>|eos>)', '\1\\\2', 'g') AS body FROM c)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(23 + length(role) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, MAX(doc_id) OVER (PARTITION BY h) AS keep_id, COUNT(*) OVER (PARTITION BY h) AS group_size,
       doc_id = MAX(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t""",
    "op12_conversation_repair": f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         {_crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM c, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS tidy FROM d),
p AS (SELECT *, CASE WHEN tidy = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                     WHEN tidy[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             LAG(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
made(a, b, price, audit, said) AS (VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('', 'u', 3, 'I', chr(10) || 'user:'), ('', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 'u', 3, 'I', chr(10) || 'user:'), ('s', 'a', 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'a', 3, 'I', chr(10) || 'assistant:'), ('a', 'u', 3, 'I', chr(10) || 'user:')),
step(a, b, edit, price, as_role) AS (VALUES ('', '', 'D', 4, NULL), ('s', 's', 'D', 4, NULL), ('u', 'u', 'D', 4, NULL), ('a', 'a', 'D', 4, NULL),
  ('', 's', 'K', 0, NULL), ('', 'u', 'K', 0, NULL), ('s', 'u', 'K', 0, NULL), ('u', 'a', 'K', 0, NULL), ('a', 'u', 'K', 0, NULL),
  ('', 'u', 'R', 3, 'user'), ('s', 'u', 'R', 3, 'user'), ('u', 'a', 'R', 3, 'assistant'), ('a', 'u', 'R', 3, 'user')),
n AS (SELECT conv_id, COUNT(*) AS n FROM p GROUP BY conv_id),
walk AS (
  SELECT n.conv_id, n, CAST(0 AS BIGINT) AS i, m.b AS st, {{'cost': CAST(m.price AS BIGINT), 'audit': m.audit, 'said': m.said}} AS best
  FROM n, made AS m WHERE m.a = ''
  UNION ALL
  SELECT w.conv_id, w.n, w.i + 1, m.b,
         MIN({{'cost': CAST(w.best.cost + s.price + m.price + CASE WHEN p.fault = 'truncated' AND s.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT),
              'audit': w.best.audit || s.edit || m.audit,
              'said': w.best.said || CASE WHEN s.edit = 'D' THEN '' ELSE chr(10) || COALESCE(s.as_role, p.role) || ':' || p.text END || m.said}})
  FROM walk AS w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1
  JOIN step AS s ON s.a = w.st AND (s.edit <> 'K' OR s.b = p.role[1]) AND (s.edit = 'D' OR p.fault NOT IN ('blank', 'duplicate'))
  JOIN made AS m ON m.a = s.b
  GROUP BY w.conv_id, w.n, w.i, m.b),
e AS (SELECT conv_id, MIN(best) AS best FROM walk WHERE i = n AND st IN ('', 'a') GROUP BY conv_id),
f AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 'blank') AS blank,
             COUNT(*) FILTER (fault = 'duplicate') AS duplicate, COUNT(*) FILTER (fault = 'truncated') AS truncated,
             COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY conv_id)
SELECT q.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, COALESCE(best.cost, 0) AS cost, COALESCE(best.audit, '') AS audit, sha256(COALESCE(best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS shown,
         ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx FROM documents),
node AS (
  SELECT 0 AS lvl, lang, idx, leaf AS h, COUNT(*) OVER (PARTITION BY lang) AS n FROM d
  UNION ALL
  SELECT lvl + 1, lang, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY lvl, lang, idx // 2, n),
sub AS (SELECT lang, h, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM node WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, h, COUNT(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
beside AS (
  SELECT d.doc_id, a.lvl AS k, CASE WHEN a.idx % 2 = 1 THEN b.h END AS l, CASE WHEN a.idx % 2 = 0 THEN b.h END AS r
  FROM d JOIN node AS a ON a.lang IS NOT DISTINCT FROM d.lang AND a.n > 1 AND a.idx = d.idx >> a.lvl
  LEFT JOIN node AS b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.idx = xor(a.idx, 1)
  UNION ALL
  SELECT d.doc_id, 1000 + a.lvl, CASE WHEN a.idx % 2 = 1 THEN b.h END, CASE WHEN a.idx % 2 = 0 THEN b.h END
  FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN top AS a ON a.n > 1 AND a.idx = sub.idx >> a.lvl
  LEFT JOIN top AS b ON b.lvl = a.lvl AND b.idx = xor(a.idx, 1)),
path AS (SELECT doc_id, COALESCE(l, '') AS l, COALESCE(r, '') AS r, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY k) AS k FROM beside),
fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS k, shown AS h FROM d
  UNION ALL
  SELECT f.doc_id, p.k, sha256(p.l || f.h || p.r) FROM fold AS f JOIN path AS p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
proof AS (SELECT doc_id, string_agg(l || r, '' ORDER BY k) AS t FROM path GROUP BY doc_id),
ended AS (SELECT doc_id, arg_max(h, k) AS h FROM fold GROUP BY doc_id)
SELECT d.doc_id, d.leaf, sub.h AS subroot, root.h AS root, sha256(COALESCE(proof.t, '')) AS proof_sha256, ended.h AS folded_root, ended.h = root.h AS verified
FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN (SELECT h FROM top WHERE n = 1) AS root ON TRUE
JOIN ended ON ended.doc_id = d.doc_id LEFT JOIN proof ON proof.doc_id = d.doc_id""",
}
