"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of documents.

1. language: rows whose language cannot be told (no letter, or two codewords equally near) go; all others stay.
2. near_duplicates: of each class of linked texts the row with the smallest id stays (of several rows of that id the one whose values come first); empty texts are linked with nothing and stay.
3. personal_data: spans are replaced by their kind in angle brackets, and n_chars follows.
4. mixing: rows are left out, kept or repeated so that each source comes near its target.
5. encoding: token ids and digests of each row.

Cases, for all stages: null texts are empty, and the first stage drops them (no letter); a null id is kept apart from all others by the second stage; rows with
the same id are one document to it; any further columns are carried along, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logwarden.llm.common import fold
from logwarden.llm.op2_jaccard import near_duplicates
from logwarden.llm.op5_language import fit_languages, keep_known
from logwarden.llm.op6_mixing import mix, repeat_taken
from logwarden.llm.op7_pii import fit_tagger, redact
from logwarden.llm.op8_bpe import encode_texts
from logwarden.session import materialise

TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, fit_languages(docs, fold("doc_id", 3) != 1))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_duplicates(docs)
    kept = materialise(classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("times")), "kept")
    stay = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    if not kept.where("times > 1").isEmpty():  # of several rows of an id that whose values come first
        in_order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        stay = stay.select(F.struct("*").alias("row"), F.row_number().over(in_order).alias("nth")).where("nth = 1").select("row.*")
    return stay.unionByName(docs.where(docs["doc_id"].isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, fit_tagger(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_taken(docs, mix(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each_class),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted models decide in the first and third stage, and a seeded walk in the fourth; tests/llm compares the stages with plain versions.
ORACLE_SQL = None
