"""The queries opN_<name>: each operator over its whole table, with production parameters, in the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import additive, chat, chosenpath, covertree, ecoc, mixing, pii, quality, spm, urlfilter
from terrane.llm.common import held_out, table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), spm.model_bytes(), keep=["doc_id"])


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.search(table(spark, sf_dir, "embeddings"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, weights = ecoc.train(docs)
    found = ecoc.predict(docs, languages, weights, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    sample = "\\### Assistant: </turn> ok"
    kinds = dict(rows.dtypes)
    added = spark.createDataFrame([(-7, 0, "user", sample), (-7, 1, "assistant", sample)], "conv_id long, turn long, role string, text string")
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(added.withColumns({c: F.col(c).cast(kinds[c]) for c in added.columns}))
    chosen = chat.best_paths(chat.linear(rows))
    made = chat.formatted(chosen, ["tree"])
    turns = chat.parsed(F.col("formatted"))
    all_turns = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select("tree", "formatted", F.size(turns).cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"), chat.masked(F.col("formatted"), F.col("spans")).alias("loss"))
    return read.select(
        F.when(~F.col("tree.none"), F.col("tree.conv_id")).alias("conv_id"),
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, weights, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_url_filter,
        op3_sentencepiece,
        op4_additive_search,
        op5_embedding_near_dedup,
        op6_ngram_jaccard_join,
        op7_language_id,
        op8_chat_format,
        op9_personal_data,
        op10_quality,
    )
}
ORACLES: dict[str, str] = {
    "op2_url_filter": urlfilter.ORACLE,
    "op8_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) + 9) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""",
}
