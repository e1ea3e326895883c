"""The corpus operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import bpe, chat, decontaminate, fingerprints, lexical, licenses, manifest, mixing, quality, simhash
from usagelens.llm import substring_dedup, suffix_dedup, token_files
from usagelens.llm.common import table
from usagelens.session import materialize, new_path

#: The vocabulary of the queries; operators take any path.
VOCABULARY = "byte_bpe_50k.json"
#: The id that ends a document in token files.
END_ID = 2


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return token_files.round_trip(table(spark, sf_dir, "documents"), path, new_path(spark, "tokens"), END_ID)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = chat.canonical_table(rows.unionByName(planted))
    return chat.digest(chat.read_turns(materialize(chat.format_turns(turns), "chat")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The auditor finds n_chars one higher in every seventh document or so.
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    found = {"n_chars": F.col("n_chars") + F.when(touched, 1).otherwise(0)}
    return manifest.audit(spark, manifest.write_manifest(docs, new_path(spark, "manifest"), found))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scan": op3_license_scan,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_source_mix": op13_source_mix,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {'i': i, 'h': sha256(array_to_string(w[i:i + 19], ' '))})) AS x
  FROM words WHERE len(w) >= 20
),
later AS (SELECT doc_id, x.i AS i, row_number() OVER (PARTITION BY x.h ORDER BY doc_id, x.i) > 1 AS again FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later WHERE again),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
  FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""",
    "op7_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(0, (length(h) // 2) - 399), lambda i: {'i': i, 'k': md5(substr(h, 2 * i + 1, 800))})) AS x
  FROM docs WHERE length(h) >= 800
),
repeated AS (SELECT doc_id, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY x.k) > 1),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM repeated),
runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, b AS a FROM spans UNION ALL SELECT doc_id, 0 FROM docs),
gaps AS (
  SELECT e.doc_id, e.a, substr(h, 2 * e.a + 1, 2 * (coalesce(min(s.a), length(h) // 2) - e.a)) AS piece
  FROM edges e JOIN docs USING (doc_id) LEFT JOIN spans s ON s.doc_id = e.doc_id AND s.a >= e.a GROUP BY e.doc_id, e.a, h
),
kept AS (SELECT doc_id, unhex(string_agg(piece, '' ORDER BY a)) AS text FROM gaps GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(kept.text) AS kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
""",
    "op10_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '([<\\[])(\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|/?INST\\]|/?SYS>)', '\\1\\\\\\2\\3', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
""",
    # DuckDB has no crc32: the eight steps of a byte make its table, a fold over the digits of doc_id the checksum.
    "op11_merkle_manifest": """
WITH RECURSIVE bytes AS (
  SELECT b, list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)
),
crc AS (SELECT list(v ORDER BY b) AS crc_table FROM bytes),
docs AS (
  SELECT *, coalesce('=' || lang, '') AS tree,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) % 7 = 0 AS touched
  FROM documents, crc
),
hashed AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || tail) AS found
  FROM (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
      n_chars + CASE WHEN touched THEN 1 ELSE 0 END AS n
    FROM docs
  )
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed
),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS level, pos, n, h FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM over_nodes WHERE n > 1 GROUP BY level, pos // 2, n
),
steps AS (
  SELECT d.tree, d.pos, s.level, m.h, (d.pos >> s.level) & 1 AS side
  FROM placed d JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) s USING (tree)
  LEFT JOIN nodes m ON m.tree = d.tree AND m.level = s.level AND m.pos = xor(d.pos >> s.level, 1)
  UNION ALL
  SELECT d.tree, d.pos, 100 + s.level, m.h, (t.pos >> s.level) & 1
  FROM placed d JOIN tops t USING (tree) CROSS JOIN (SELECT DISTINCT level FROM over_nodes WHERE n > 1) s
  LEFT JOIN over_nodes m ON m.level = s.level AND m.pos = xor(t.pos >> s.level, 1)
),
ways AS (
  SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256,
    list({'h': coalesce(h, ''), 'side': side} ORDER BY level) AS way
  FROM steps GROUP BY tree, pos
),
told AS (
  SELECT p.doc_id, p.leaf, p.found, t.h AS subroot, r.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(way, []) AS way
  FROM placed p LEFT JOIN ways USING (tree, pos) JOIN tops t USING (tree) CROSS JOIN (SELECT h FROM over_nodes WHERE n = 1) r
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM (
  SELECT *, list_reduce([{'h': found, 'side': 0}] || list_transform(way, lambda x: {'h': x.h, 'side': x.side::INT}),
    lambda a, x: {'h': sha256(CASE WHEN x.side = 1 THEN x.h || a.h ELSE a.h || x.h END), 'side': 0}).h AS folded_root
  FROM told
)
""",
    "op12_ranked_search": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
),
held AS (SELECT doc_id, len(t) AS n, row_number() OVER () AS k, t FROM docs WHERE len(t) > 0),
sums AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
places AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM held) GROUP BY ALL),
items AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM places, sums GROUP BY term),
scored AS (
  SELECT item_id, i.text, k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items i JOIN places USING (term) JOIN weights USING (term) JOIN held USING (k), sums GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored JOIN held USING (k) WHERE score > 0 QUALIFY rank <= 50
""".replace("\\\\", "\\"),
}
