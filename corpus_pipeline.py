"""Training-data pipeline over the documents table, each stage written and read again by the next.

Every stage keeps the columns of documents (the last adds to them), takes null and repeated ids and
sources as values like others, and gives no rows for an empty table; other columns pass through."""

from pyspark.sql import DataFrame, SparkSession

from serialis.llm import language, linedup, mixing, neardup, pieces
from serialis.llm.common import settled


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Null and empty texts, and texts without a letter, have none and go;
    of repeated rows each stays or goes by its own text."""
    return language.identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; documents of which nothing is left go. Texts
    without such runs stay as they are, null and empty ones too; rows alike in id and text are one
    document, whose lines are no copies of each other."""
    return linedup.without_repeats(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five-word shingles: the smallest id's. Documents
    without words, and rows without an id, link nothing and stay; of rows alike in id and text one stays."""
    return neardup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row per epoch of a document. Null and empty texts are never taken; a null
    source is a source of its own; repeated rows are taken one by one."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and their spans of source bytes; null and empty texts have none. A row for every row."""
    return pieces.encoded_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The first stage is a trained model, which SQL cannot express; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written; the tables of a stage go once the next is written."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spent)
    return STAGES[-1][1](spark, docs, sf_dir)
