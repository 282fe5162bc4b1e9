"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import (
    bpe,
    chat,
    cotraining,
    cross_polytope,
    jaccard,
    lengths,
    line_dedup,
    merkle,
    packing,
    periodic,
    sharding,
    topk,
    transducer,
)
from loamline.llm.common import table
from loamline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 16
CONTEXT = 2048
# Context limits and shares that the length table answers besides the lengths that occur.
CONTEXT_LIMITS = tuple(1 << k for k in range(7, 21))
LENGTH_SHARES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)
END_ID = 1
BEST = 5
QUERY_EVERY = 50
SPECIAL = {"<|endoftext|>": 50256}
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
# Every fifth document is tampered with, every tenth gets a repetition.
TAMPERED = 5
PLANTED = 10


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    placed = sharding.shard_rows(docs, SHARDS, scratch_path(spark, "slot-map"), ["doc_id", "text_crc32"], F.col("size"))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.col("row.text_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, placed = packing.pack_documents(docs, RANKS, PATTERN, CONTEXT, END_ID, SPECIAL)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_template_lines(docs).select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_dropped").cast("long").alias("n_dropped")
    )


OP5_SQL = f"""
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
single AS (SELECT DISTINCT source, text, lines FROM pages WHERE source IS NOT NULL),
counted AS (
  SELECT source, line, COUNT(*) AS pages
  FROM (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))),
                                                        lambda x: x <> ''))) AS line
        FROM single)
  GROUP BY ALL HAVING COUNT(*) >= {line_dedup.MIN_PAGES}),
bad AS (
  SELECT source, list(line) AS bad
  FROM counted JOIN (SELECT source, COUNT(*) AS total FROM single GROUP BY ALL) USING (source)
  WHERE pages > total * {line_dedup.RATIO}e0 GROUP BY source),
kept AS (
  SELECT doc_id, text, lines,
         list_filter(lines, lambda x: bad IS NULL OR NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS left_
  FROM pages LEFT JOIN bad USING (source))
SELECT doc_id, array_to_string(left_, chr(10)) AS text, length(array_to_string(left_, chr(10))) AS n_chars,
       len(lines) - len(left_) AS n_dropped
FROM kept"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = lengths.context_table(lengths.length_histogram(docs, RANKS, PATTERN), CONTEXT_LIMITS, LENGTH_SHARES)
    return made.withColumn("quantile_of", F.array_join(F.col("quantile_of").cast("array<string>"), ","))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = cotraining.score_documents(docs, labels)
    return scored.select("doc_id", "quality_probability", cotraining.accepted().alias("accepted"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    made = chat.format_conversations(turns.unionByName(tricky))
    read = F.transform(
        chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_mask")), "")
    return made.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        read.alias("turns"),
        loss.alias("loss"),
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen AS (
  SELECT *, LAG(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS earlier,
         length(text) + length(text) * 3 - length(replace(text, '\', ''))
           - length(replace(text, '[', '')) - length(replace(text, '<', '')) AS escaped,
         length(role) + length(role) * 4 - length(replace(role, '\', '')) - length(replace(role, '[', ''))
           - length(replace(role, '<', '')) - length(replace(role, ']', '')) AS name
  FROM turns)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(SUM(escaped + CASE WHEN role = earlier THEN 2 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
                               WHEN role = 'assistant' THEN 7 ELSE 14 + name END) AS BIGINT) AS formatted_chars
FROM seen GROUP BY conv_id"""


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter(F.col("vec_id") % QUERY_EVERY == 0)
    return topk.top_k(rows, queries, BEST, "vec_id", "embedding")


OP9_SQL = f"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {BEST}"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode_texts(docs, RANKS, PATTERN, keep=["doc_id"])
    read = bpe.decode_ids(coded, RANKS, PATTERN, keep=["doc_id", "ids"])
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = transducer.encode_texts(docs, WORD_FILE, keep=["doc_id"])
    read = transducer.decode_ids(coded, WORD_FILE, keep=["doc_id", "ids"])
    return read.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = merkle.leaf_digest([*map(F.col, fields), F.translate("text", upper, upper.lower())])
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    rows = docs.select(
        "doc_id",
        "source",
        merkle.leaf_digest([*map(F.col, fields), F.col("text")]).alias("digest"),
        F.when(tampered, changed).alias("changed"),
    )
    made = merkle.manifest(rows, F.col("digest"), "source", "doc_id", keep=["changed"])
    seen = F.coalesce("changed", "leaf")
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.siblings_digest(F.col("witness")).alias("proof_sha256"),
        merkle.folded(seen, F.col("witness")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, key: str, levels: int) -> str:
    """Tables of one tree's levels over ``{name}_0`` (key, i, h): runs, and the nodes they make."""
    parts = []
    for k in range(levels):
        parts.append(f"""
{name}_runs_{k} AS (
  SELECT {key}, i // 16 AS run, list(h ORDER BY i) AS hs, ANY_VALUE(n) AS n
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY {key}) AS n FROM {name}_{k}) GROUP BY ALL),
{name}_{k + 1} AS (
  SELECT {key}, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_runs_{k})""")
    return ",".join(parts)


def _path_sql(source: str, name: str, key: str, index: str, levels: int) -> str:
    """Tables that lead rows with ``siblings`` and ``folded`` up a tree, one level each."""
    parts = []
    for k in range(levels):
        at = f"CAST({index} // {16**k} % 16 + 1 AS BIGINT)"
        parts.append(f"""
{name}_path_{k} AS (
  SELECT p.* REPLACE (
      CASE WHEN n = 1 THEN siblings ELSE siblings || array_to_string(hs[:{at} - 1] || hs[{at} + 1:], '') END AS siblings,
      CASE WHEN n = 1 THEN folded
           ELSE sha256(array_to_string(list_append(hs[:{at} - 1], folded) || hs[{at} + 1:], '')) END AS folded)
  FROM {source if k == 0 else f"{name}_path_{k - 1}"} p
  JOIN {name}_runs_{k} r ON r.{key} IS NOT DISTINCT FROM p.{key} AND r.run = p.{index} // {16 ** (k + 1)})""")
    return ",".join(parts)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ["doc_id", "source", "lang", "n_chars", text])) + ")"


# Bytes of a number's digits, each followed by eight shifts of the check sum.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    range(1, length(d) + 1), lambda j: list_prepend(CAST(ascii(d[j]) AS BIGINT), list_transform(range(8), lambda b: CAST(256 AS BIGINT)))))),
    lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""

# Enough levels for a million documents a source and 4096 sources.
OP12_SQL = f"""
WITH docs AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS d, {_leaf_sql("text")} AS h,
         {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed
  FROM documents),
leaves AS (
  SELECT doc_id, source, h, CASE WHEN {_CRC_SQL} % {TAMPERED} = 0 THEN changed ELSE h END AS folded,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i
  FROM docs),
tree_0 AS (SELECT source, i, h FROM leaves),{_tree_sql("tree", "source", 5)},
top_0 AS (
  SELECT 0 AS one, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, h, source FROM tree_5),
{_tree_sql("top", "one", 3)},
started AS (SELECT *, '' AS siblings FROM leaves),
{_path_sql("started", "tree", "source", "i", 5)},
placed AS (
  SELECT p.*, 0 AS one, t.i AS place, t.h AS subroot
  FROM tree_path_4 p JOIN top_0 t ON t.source IS NOT DISTINCT FROM p.source),
{_path_sql("placed", "top", "one", "place", 3)}
SELECT doc_id, p.h AS leaf, subroot, r.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root,
       folded = r.h AS verified
FROM top_path_2 p CROSS JOIN top_3 r"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs, keep=["doc_id"])
    best = periodic.strongest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """Texts of one document in ten with a part repeated; its words are then joined by one space."""
    hashed = F.crc32(doc_id.cast("string"))
    g = ((hashed - hashed % PLANTED) / PLANTED).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        first = g % n
        period = 1 + F.floor((n - first) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        taken = F.transform(place, lambda i: F.when(i < first, i).otherwise(first + (i - first) % period).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(taken, lambda i: F.get(words, i)), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The lambda binds the words, so that they are cut once a text and not once a word.
    made = F.transform(F.array(words), repeat)[0]
    return F.when((hashed % PLANTED == 0) & text.isNotNull(), made).otherwise(text)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_word_bpe": op11_word_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op9_exact_top_k": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
