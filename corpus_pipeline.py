"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as
the next one's input.

1. language ID: documents whose language can't be told go: null texts, texts without a letter, and texts of which no language
   has ``LEAST_SCORE`` of the score, as two-letter texts or even mixtures of three languages; where no model can be learned (no
   document with a language) the letter test decides alone;
2. line dedup: later occurrences of repeated three-line windows are cut out of the texts;
3. SimHash near-dedup: one document of each group stays, the one with the smallest id;
4. benchmark decontamination: documents go if 1 of 20 of their words or more is in a benchmark window;
5. SentencePiece: the number of ids of each document, and digests of the ids and of the text they decode to.

Each stage takes (spark, docs, sf_dir); ``docs`` has the columns of documents, which all but the
last stage return.  Every stage works on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import decontaminate, langid, line_dedup, piece_bpe, simhash
from shopmetrics.llm.common import free_prefix, shared_folder
from shopmetrics.llm.queries import piece_model


#: The score, a share, with which a language counts as told: no other one can have more.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language; a text that is ambiguous between two languages stays with the better one."""
    prefix = free_prefix(docs, "found_", langid.FIELDS)
    names = [prefix + f.name for f in langid.FIELDS]
    model = langid.learn(docs)
    found = langid.identify(docs, model, prefix=prefix)
    # Without a model every text is undetermined, and only those without a letter are ambiguous.
    told = (F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LEAST_SCORE) if model else ~F.col(names[2])
    return found.where(told).drop(*names)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows out; ``n_chars`` follows the text."""
    return line_dedup.remove_repeated(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), piece_model(), digest=True).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", pieces),
]

#: Trained classifiers, 64-bit shingle hashes and the tokenizer have no DuckDB counterpart; tests/llm
#: compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{root}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
