"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, embeddings, fingerprints, langid, lines, ranked, secrets, sharding, simhash, substring, toxicity

BPE_RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(parts: int, column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_fold(4) != 2), langid.sentencepiece_vocabulary(public_tokenizers.path(PIECES)))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(_fold(3) != 1), labels.where(_fold(3) != 1))
    found = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= toxicity.DECISION).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.rewrite(docs, counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "start", "length", F.sha2(F.col("secret").cast("binary"), 256).alias("secret_sha256"), "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated_windows(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprints.compare_with_edits(docs, fingerprints.fit(docs))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.summary_of_all(conversations.damaged(rows), rows)


def queries() -> dict:
    own = (op1_simhash_dedup, op2_byte_bpe, op3_language_id, op4_embedding_dedup, op5_sharding, op6_toxicity, op7_decontaminate, op8_line_dedup, op9_secret_scan, op10_substring_dedup, op11_document_fingerprints, op12_ranked_search, op13_conversation_repair)
    return {f.__name__: f for f in own}


#: Cosines of all pairs, and components by spreading the least id along links.
EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
 reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
 least AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
 SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON node = vec_id"""


#: Every window of 20 words, the first place of each, and the words that later ones cover.
WINDOWS_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS nth FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
 gone AS (SELECT DISTINCT doc_id, s + o AS p FROM windows, (SELECT unnest(range(20)) AS o) WHERE nth > 1),
 each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
 told AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
 SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN told ON told.doc_id = w.doc_id"""


#: Every item against every document.
RANKED_SQL = r"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS nth, text FROM documents UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
 w AS (SELECT kind, id, nth, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
 tf AS (SELECT id AS doc_id, nth, term, count(*) AS tf FROM w WHERE kind = 'd' GROUP BY ALL),
 d AS (SELECT nth, sum(tf)::BIGINT AS n FROM tf GROUP BY 1), c AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
 q AS (SELECT DISTINCT id AS item_id, nth AS item, term FROM w WHERE kind = 'i'),
 weighed AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), c),
 scored AS (SELECT item_id, item, doc_id, tf.nth, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN weighed USING (term) JOIN d ON d.nth = tf.nth, c GROUP BY ALL)
 SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""


def _moves() -> str:
    """(state, kind, fault, edits, cost, after) of every way to use up a turn, with up to two turns inserted before it, as SQL values."""
    rows = []
    for kind in range(4):
        for fault in range(4):
            for state in range(4):
                edits, cost, at = "", 0, state
                for _ in range(3):
                    rows += [(state, kind, fault, edits + e, cost + c, to) for e, c, to in conversations._moves(chr(65 + 4 * kind + fault), at)]
                    edits, cost, at = edits + conversations.INSERT, cost + conversations.INSERT_COST, conversations.AFTER[at]
    return ", ".join(map(str, rows))


_space = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The checksum bit by bit, the cheapest and least edits of each state turn by turn, and the repaired turns from the edits.
CONVERSATIONS_SQL = f"""WITH RECURSIVE moves(state, kind, fault, edits, cost, after) AS (VALUES {_moves()}),
 raw AS (SELECT conv_id, coalesce('=' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark FROM conversations),
 crc AS (SELECT mark, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(mark, ''), lambda c: ord(c)::BIGINT)), lambda x, b: list_reduce(list_concat([xor(x, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS way FROM (SELECT DISTINCT mark FROM raw)),
 harmed AS (SELECT key, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw JOIN crc USING (mark)),
 placed AS (SELECT key, turn, role, text, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS nth FROM harmed),
 judged AS (SELECT *, CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind, CASE WHEN rtrim(text, {_space}) = '' THEN 2 WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY nth) > 1 THEN 3 WHEN right(rtrim(text, {_space}), 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM placed),
 walk AS (SELECT key, 0::BIGINT AS nth, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT key FROM judged)
  UNION ALL SELECT w.key, j.nth, m.after, min(w.cost + m.cost), arg_min(w.audit || m.edits, struct_pack(c := w.cost + m.cost, a := w.audit || m.edits)) FROM walk w JOIN judged j ON j.key = w.key AND j.nth = w.nth + 1 JOIN moves m ON m.state = w.state AND m.kind = j.kind AND m.fault = j.fault GROUP BY 1, 2, 3),
 ended AS (SELECT key, cost + [0, 6, 3, 0][state + 1] AS cost, audit || ['', 'II', 'I', ''][state + 1] AS audit FROM walk WHERE nth = (SELECT max(nth) FROM judged j WHERE j.key = walk.key)),
 best AS (SELECT key, min(cost) AS cost, arg_min(audit, struct_pack(c := cost, a := audit)) AS audit FROM ended GROUP BY 1),
 edits AS (SELECT key, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS spot FROM best WHERE audit <> ''),
 turned AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS nth, sum((edit <> 'D')::INT) OVER w AS out FROM edits WINDOW w AS (PARTITION BY key ORDER BY spot)),
 repaired AS (SELECT t.*, j.role, j.text, max((edit = 'K' AND out = 1 AND j.role[1] = 's')::INT) OVER (PARTITION BY t.key) AS has_system FROM turned t LEFT JOIN judged j ON j.key = t.key AND j.nth = t.nth WHERE edit <> 'D'),
 said AS (SELECT key, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS whole FROM repaired GROUP BY 1),
 pairs AS (SELECT key, nth > 1 AND role[1] || lag(role[1]) OVER (PARTITION BY key ORDER BY nth) NOT IN ('us', 'au', 'ua') AS illegal, turn, fault FROM judged),
 counts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (illegal) AS illegal FROM pairs GROUP BY 1)
 SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, key FROM raw) LEFT JOIN counts USING (key) LEFT JOIN best USING (key) LEFT JOIN said USING (key)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": EMBEDDING_SQL, "op10_substring_dedup": WINDOWS_SQL, "op12_ranked_search": RANKED_SQL, "op13_conversation_repair": CONVERSATIONS_SQL}
