"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.llm import (
    bpe,
    chat,
    codes,
    content_sort,
    merkle,
    minhash,
    mixing,
    repetition,
    resampling,
    secret_scan,
    token_counts,
    topk,
    toxicity,
)
from wardflow.sources.scratch import written

#: Tokenizer files, by name in the folder of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    words = mixing.n_words(F.col("text").cast("string"))
    # the words are counted once; what follows reads the narrow table
    sized = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("words")), "sized")
    found = mixing.mixed(sized, F.col("words"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.written_and_counted(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts look like another template's marks."""
    extra = conversations.sparkSession.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text"
        " FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = with_control_strings(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.formatted(chat.events_of(conversations)))


def trained(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.train(table(spark, sf_dir, "documents"), labels.select("doc_id", "toxic"))


def score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.written_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def rate_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.scored(table(spark, sf_dir, "documents"))


def encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def make_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves whose id's checksum 3 divides are tampered with: their texts' A-Z are lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), {"text": lowered}, chosen)


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mix,
    "op2_token_counts": count_tokens,
    "op3_secret_scan": scan_secrets,
    "op4_chat_format": format_chat,
    "op5_toxicity": score_toxicity,
    "op6_near_duplicates": near_duplicates,
    "op7_top_k": search,
    "op8_token_codes": code_tokens,
    "op9_repetition": rate_repetition,
    "op10_byte_bpe": encode_decode,
    "op11_content_sort": exact_duplicates,
    "op12_merkle_manifest": make_manifest,
    "op13_resampling": resample,
}

#: A text's CRC-32, given the column ``crc_table``.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({0})),
    lambda k: 16 * (instr('0123456789ABCDEF', hex(encode({0}))[2 * k + 1]) - 1) + instr('0123456789ABCDEF', hex(encode({0}))[2 * k + 2]) - 1)),
    lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)])))"""
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc_table FROM range(256) t(i)"""
_LEAF = (
    "sha256(concat("
    + "".join(f"coalesce(concat(strlen({c}::VARCHAR), ':', {c}), '-'), " for c in ("doc_id", "source", "lang", "n_chars"))
    + "coalesce(concat(strlen({0}), ':', {0}), '-')))"
)
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat(doc_id, ':7')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM docs GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][1 + place % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
final AS (  -- of the first source in order that isn't full; none if all are
  SELECT arg_min(level, cap / w) FILTER (WHERE cap > level * w) AS level FROM levels),
targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM final) * w), cap) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * least(whole + (upto - size / 2.0::DOUBLE <= target - whole * source_size)::INT, 2))::BIGINT AS taken
FROM placed""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsq;') AS body,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsq;'), chr(10), '&lf;') AS head
  FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    sum(length('<|turn|>') + length(head) + 1 + length(body) + length('<|end|>') + 1)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars
FROM joined""",
    "op6_near_duplicates": r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least_one AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM words w JOIN least_one c ON c.doc_id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id""",
    "op7_top_k": r"""
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
  FROM points q JOIN points p ON p.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
    "op11_content_sort": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
  sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.format(_LOWERED)} ELSE {_LEAF.format("text")} END AS start,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc),
nodes AS (
  SELECT tree, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY tree, lvl, i // 8),
subroots AS MATERIALIZED (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1
  GROUP BY lvl, i // 8),
runs AS MATERIALIZED (
  SELECT tree, lvl, i // 8 AS up, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 8),
top_runs AS MATERIALIZED (SELECT lvl, i // 8 AS up, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY lvl, i // 8),
climb AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, i, '' AS proof, start AS h FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.lvl + 1, c.i // 8,
    c.proof || array_to_string(list_concat(r.hs[1 : c.i % 8], r.hs[c.i % 8 + 2 :]), ''),
    sha256(array_to_string(list_concat(r.hs[1 : c.i % 8], [c.h], r.hs[c.i % 8 + 2 :]), ''))
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.up = c.i // 8),
at_subroot AS (SELECT doc_id, max_by(struct_pack(leaf, tree, proof, h), lvl) AS s FROM climb GROUP BY doc_id),
climb_top AS (
  SELECT a.doc_id, a.s.leaf AS leaf, b.subroot, 0 AS lvl, b.i, a.s.proof AS proof, a.s.h AS h
  FROM at_subroot a JOIN subroots b ON b.tree = a.s.tree
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.i // 8,
    c.proof || array_to_string(list_concat(r.hs[1 : c.i % 8], r.hs[c.i % 8 + 2 :]), ''),
    sha256(array_to_string(list_concat(r.hs[1 : c.i % 8], [c.h], r.hs[c.i % 8 + 2 :]), ''))
  FROM climb_top c JOIN top_runs r ON r.lvl = c.lvl AND r.up = c.i // 8),
ended AS (SELECT doc_id, max_by(struct_pack(leaf, subroot, proof, h), lvl) AS s FROM climb_top GROUP BY doc_id),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, s.leaf AS leaf, s.subroot AS subroot, root, sha256(s.proof) AS proof_sha256, s.h AS folded_root,
  s.h = root AS verified
FROM ended, root""",
    "op13_resampling": rf"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS MATERIALIZED (
  SELECT kind, id, regexp_extract_all(coalesce({_LOWERED}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
buckets AS MATERIALIZED (
  SELECT f, ({_CRC32.format("f")} % 10000)::BIGINT AS b FROM (SELECT DISTINCT f FROM features), ({_CRC_TABLE})),
totals AS (
  SELECT b, (count(*) FILTER (WHERE kind = 0))::DOUBLE AS s, (count(*) FILTER (WHERE kind = 1))::DOUBLE AS t
  FROM features JOIN buckets USING (f) GROUP BY b),
gains AS (
  SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS g FROM totals),
summed AS (
  SELECT id, count(*) AS n, sum(g)::BIGINT AS g FROM features JOIN buckets USING (f) JOIN gains USING (b) WHERE kind = 0 GROUP BY id),
weighted AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || sha256('7:' || w.id)[1:8])::BIGINT AS h
  FROM words w LEFT JOIN summed USING (id) WHERE w.kind = 0),
scored AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weighted),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id""",
}
