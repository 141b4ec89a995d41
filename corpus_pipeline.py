"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns
of ``documents``:

1. quality: documents that the co-trained classifier rejects go;
2. near duplicates: of every group linked by the n-gram Jaccard join (``WORDS`` words,
   similarity ``PERCENT`` / 100 at least), the document with the smallest id stays;
3. secrets: the spans that the blob ledger finds are replaced by a mark;
4. mixing: documents are taken as often as the sources' target weights ask,
   the one at a source's cut up to the cut;
5. SentencePiece: what is left becomes ids of pieces.

``ORACLE_SQL`` is None: SQL expresses neither the classifier nor the encoding;
tests hold the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from learnlens.llm import jaccard_join, mixing, quality, secrets, sentencepiece_codec
from learnlens.llm.common import table
from learnlens.session import cleaned, remove_scratch, scratch_path

# The stage's own; those of the op2 query are stricter.
WORDS, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "pages"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs, WORDS, PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables go when its result is stored, and a result
    goes when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove_scratch(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
