"""A training-corpus pipeline over the documents table: quality filter, near-duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a DataFrame, which ``run`` writes as
Parquet on the shared scratch folder and reads again for the next one. All stages but the last return the columns of documents, and any others that come with them.

In every stage, nulls may stand in any column, ids and whole rows may repeat, texts may be empty or very long and are read whole, and a table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import chosenpath, mixing, pii, quality, spm
from terrane.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of this corpus, doesn't reject.

    Null and empty texts have no features and are judged by the model's intercept alone. Repeated rows are judged one by one, with the same result. Scores of exactly the threshold stay.
    Columns named like the classifier's results keep their own values. Without labels nothing is learned, every score is 0.5, and no document stays.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    scored = quality.score(docs.withColumnsRenamed({c: f"__doc_{i}" for i, c in enumerate(names) if c != "text"}), weights)
    kept = scored.where("predicted = 1").drop("score", "predicted")
    return kept.withColumnsRenamed({f"__doc_{i}": c for i, c in enumerate(names)}).select(*[f"`{c}`" for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by five-word Jaccard similarity of 0.8 or more: that of the least id, null ids last; of rows that share it one, by a hash of the row.

    Null texts and texts without words link with nothing and all stay, repeated rows too.
    """
    return chosenpath.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kind, n_chars with them. Null texts stay null, empty ones empty. No row is added or dropped; repeated rows are redacted alike."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none or twice among it.

    Null sources are a source of their own. Null texts and texts without words have size 0: they are taken as often as their source's rate, rounded down. Rows that repeat count one by one; of equal
    ones it plays no role which are taken. Ties are broken by hashes, so reruns agree.
    """
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, parity and round_trip of each text. A null text has null ids, an empty one none; both have 0 tokens and true checks. Rows repeat as they come."""
    return spm.encode(docs, spm.model_bytes(), keep=["doc_id", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenise),
]

#: The classifier, the join's hashes and the random mix have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
