"""The corpus operators as queries over ``documents``, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm.chat_format import conversation_digests, write_conversations
from fathom.llm.decontaminate import mark_contamination
from fathom.llm.jaccard import jaccard_components
from fathom.llm.licenses import license_reports
from fathom.llm.line_dedup import drop_frequent_lines
from fathom.llm.mixing import mix_sources
from fathom.llm.pii import pii_digests
from fathom.llm.prefix_trie import WIDTH, conversation_paths, end_digests, prefix_trie
from fathom.llm.quality import FIGURES, judge_quality
from fathom.llm.secrets import secret_digests
from fathom.llm.suffix_dedup import string_digests
from fathom.llm.token_files import token_digests, write_token_files
from fathom.llm.vector_codes import code_digests
from fathom.runtime import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha(F.col("text")).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), often AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE o.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.k = o.k
GROUP BY doc_id
"""


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_reports(_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The byte-level vocabulary's file, where the library that ships it has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = write_token_files(_table(spark, sf_dir, "documents"), vocabulary())
    return token_digests(spark, folder)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("rate", 6).alias("rate"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), sha(F.array_join("hit_items", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents")).select("doc_id", *FIGURES, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_digests(_table(spark, sf_dir, "documents"))


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """(conv, path): each conversation behind the first h turns of conversation c - c % 100 in place of
    its own first h; h is a checksum of c."""
    conv, h = F.col("conv"), F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % 6 * WIDTH
    heads = paths.where(conv % 100 == 0).select(conv.alias("of"), F.left("path", F.lit(5 * WIDTH)).alias("head"))
    head = F.substring(F.coalesce("head", F.lit("")), F.lit(1), h.cast("int"))
    own = F.substring("path", (h + 1).cast("int"), F.length("path"))
    return paths.join(heads, conv - conv % 100 == F.col("of"), "left").select("conv", F.concat(head, own).alias("path"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = materialize(rebuilt_paths(conversation_paths(_table(spark, sf_dir, "conversations"))), "paths")
    ends = end_digests(paths).withColumnRenamed("node", "at")
    nodes = prefix_trie(paths).join(ends, F.col("node") == F.col("at"), "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256"))


OP11_SQL = """
WITH rows_ AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST) AS i FROM rows_),
ids AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(c::VARCHAR, '')]),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h FROM (SELECT DISTINCT c FROM numbered)),
again AS (
  SELECT ids.c, n.i, role, text FROM ids JOIN numbered n ON n.c = ids.c - ids.c % 100 AND n.i <= h
  UNION ALL SELECT ids.c, n.i + 1000000, role, text FROM ids JOIN numbered n ON n.c = ids.c AND n.i > h
),
turns AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(length(role) || ':' || role || text) AS k, length(text) AS chars FROM again),
path AS MATERIALIZED (SELECT c, list(k ORDER BY d) AS ks FROM turns GROUP BY c UNION ALL SELECT c, [] FROM ids WHERE c NOT IN (SELECT c FROM turns)),
pre AS MATERIALIZED (
  SELECT p.c, d, sha256(array_to_string(list_slice(ks, 1, d), ',')) AS node, sha256(array_to_string(list_slice(ks, 1, d - 1), ',')) AS parent, chars, d = len(ks) AS ends
  FROM path p JOIN turns t ON p.c = t.c UNION ALL SELECT c, 0, sha256(''), NULL, 0, len(ks) = 0 FROM path
),
node AS MATERIALIZED (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM pre GROUP BY node),
kids AS MATERIALIZED (SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY 1),
above AS MATERIALIZED (SELECT DISTINCT a.node AS up, b.node AS down FROM pre a JOIN pre b ON a.c = b.c AND a.d <= b.d),
sub AS (SELECT up, count(*) FILTER (WHERE k.node IS NULL) AS leaves, sum((m.n - 1) * m.chars) AS saved FROM above JOIN node m ON m.node = down LEFT JOIN kids k ON k.node = down GROUP BY up)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, m.ends AS ends_sha256
FROM node m LEFT JOIN node u ON u.node = m.parent LEFT JOIN kids k ON k.node = m.node JOIN sub ON sub.up = m.node
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    more = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return conversation_digests(spark, write_conversations(rows))


_CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|", "|>"]
_ESCAPES = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', ''))) // {len(x)}" for x in ["\\", *_CONTROL])
OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(text) + {_ESCAPES.format("text")} + CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 1 + 5
    ELSE length(role) + {_ESCAPES.format("role")} + 11 END AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digests(_table(spark, sf_dir, "embeddings"))


_DISTANCE = " + ".join(f"(v.x[{i}] - b.x[{i}]) * (v.x[{i}] - b.x[{i}])" for i in range(1, 5))


def _assign_sql(n: int) -> str:
    return f"near{n} AS MATERIALIZED (SELECT id, p, x, (min([d, e]))[2] AS e, (min([d, e]))[1] AS d FROM (SELECT v.id, v.p, v.x, b.e, {_DISTANCE} AS d FROM part v JOIN book{n} b ON v.p = b.p) GROUP BY id, p, x)"


def _move_sql(n: int) -> str:
    return f"""sum{n} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{n}, generate_series(1, 4) g(i) GROUP BY ALL),
mean{n} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sum{n} GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m ON b.p = m.p AND b.e = m.e)"""


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v, row_number() OVER (ORDER BY vec_id) AS id FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT id, p, list_slice(v, 4 * p + 1, 4 * p + 4) AS x FROM kept, generate_series(0, 15) g(p)),
book0 AS MATERIALIZED (SELECT p, id - 1 AS e, x FROM part WHERE id <= 64),
{_assign_sql(0)}, {_move_sql(0)}, {_assign_sql(1)}, {_move_sql(1)}, {_assign_sql(2)},
final AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY id),
sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM final JOIN kept USING (id) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM final JOIN kept USING (id) JOIN sums ON sums.label IS NOT DISTINCT FROM kept.label
"""


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_license_scans, op3_quality_rules, op4_token_files, op5_ngram_jaccard, op6_suffix_dedup, op7_mixing, op8_decontaminate, op9_secrets, op10_pii, op11_prefix_trie, op12_chat_format, op13_vector_codes)
}
SQL = {"op1_line_dedup": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op12_chat_format": OP12_SQL, "op13_vector_codes": OP13_SQL}
