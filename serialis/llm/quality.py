"""Quality scores: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

Features are the lower-cased words and the words' shapes (runs of letters, capitals, digits and
marks), each alone and in pairs (a
word after itself is one pair for all words), hashed; a text's value of a feature is its share of the text's.
Scores are sparse dot products, so a text is read once. The weights are fitted on a sample of at
most about SAMPLE labelled rows.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import documents, fold, list_array, saved, slices, utf8, with_text
from serialis.llm.ftrl import Leader, train

FEATURES = 1 << 18
#: Bound, on average, of the labelled rows that the weights are fitted on.
SAMPLE = 12_000
PASSES = 4
SCALE = 10.0
THRESHOLD = 0.3
_MEMO = 100_000
_KINDS = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
_RUN = re.compile(rb"(.)\1{1,}", re.S)


class _Words(dict):
    """Word -> (hash of its lower-case form, hash of its shape)."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > _MEMO:
            self.clear()
        shape = _RUN.sub(rb"\1\1", word.translate(_KINDS))
        value = self[word] = (xxhash.xxh32_intdigest(word.lower()), xxhash.xxh32_intdigest(shape, 1))
        return value


def features(text: bytes, memo: dict) -> np.ndarray:
    """The hashed features of the text, in any order and with repeats."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    pairs = np.array([memo[w] for w in words], np.uint64)
    later = (pairs[:-1] * np.uint64(0x9E3779B97F4A7C15) + pairs[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
    # A word after itself is one feature, whatever the word.
    later[pairs[:-1, 0] == pairs[1:, 0], 0] = 1
    return (np.concatenate([pairs.ravel(), later.ravel()]) & np.uint64(FEATURES - 1)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Words()
    for batch in slices(batches):
        ids, values = [], []
        for text in utf8(batch.column(0)):
            every = features(text, memo)
            unique, counts = np.unique(every, return_counts=True)
            ids.append(unique)
            values.append(counts * (SCALE / max(1, len(every))))
        yield pa.RecordBatch.from_arrays([list_array(ids, pa.int32()), list_array(values, pa.float32()), batch.column(1), batch.column(2)], ["ids", "values", "label", "key"])


def _scorer(text_col: str, weights: np.ndarray, intercept: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in slices(batches):
            scores = []
            for text in utf8(batch.column(text_col)):
                every = features(text, memo)
                z = intercept + (float(weights[every].mean()) * SCALE if len(every) else 0.0)
                scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    return score


def _share(n: int) -> int:
    """Keys below it are SAMPLE of n rows, on average."""
    return int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept from a sample of labelled rows (text, label 0 or 1, key in [0, 10^6))."""
    sample = saved(rows.mapInArrow(_featurise, "ids array<int>, values array<float>, label int, key long"))
    weights = train(sample, Leader(FEATURES, 1, alpha=0.8, l1=0.001, l2=0.001), PASSES).weights()[:, 0]
    return weights[:-1].astype(np.float32), float(weights[-1])


def quality_scores(df: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns to keep) with `score`, the probability (0 to 1) that a text has label 1.

    Learns from the rows of `labels` that `training` (over the id) marks, joined by id; scores every
    row from its text alone. Null labels and null ids are not learned from; null or empty texts get
    the intercept's score. Without labels every score is 0.5. A column of df named score gives way,
    others pass through, repeated rows too. An empty table gives no rows.
    """
    marked = labels.where(training & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    ids, texts = df.select(F.col(id_col).alias("__doc")), df.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    # The sample is drawn from the labelled ids before any text is joined to them, and then, by a hash of the whole row,
    # from their rows, as an id may have many; rows alike are learned from once.
    drawn = marked.where(F.pmod(F.xxhash64("__id", F.lit(6)), F.lit(1_000_000)) < _share(marked.count()))
    labelled = F.col("__doc") == F.col("__id")
    whole = F.xxhash64("__id", "text", "label", F.lit(7))
    rows = texts.join(drawn, labelled).select("text", "label", whole.alias("whole"), F.pmod(whole, F.lit(1_000_000)).alias("key"))
    rows = rows.where(F.col("key") < _share(ids.join(drawn, labelled).count())).dropDuplicates(["whole"])
    weights, intercept = fit(saved(rows.select("text", "label", "key")))
    sent, name, kinds = with_text(df, text_col, "score", keep=keep)
    return sent.mapInArrow(_scorer(name, weights, intercept), f"{kinds}score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels, fold("doc_id", 5) != 0, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
