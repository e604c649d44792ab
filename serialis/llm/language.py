"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

A feature is a hashed run of 1 to 3 code points of the lower-cased text; its value is its share of
the text's runs times its inverse document frequency, which covers every training text. The
weights are learned by follow-the-regularised-leader with elastic-net penalties on a sample of at
most about SAMPLE training rows, and one temperature, fitted on an eighth of the sample that the
weights never saw, calibrates the scores.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import documents, fold, list_array, saved, slices, summed, with_text
from serialis.llm.ftrl import Leader, train

FEATURES = 1 << 16
ORDERS = 3
#: Bound, on average, of the labelled rows that the weights and the temperature are fitted on.
SAMPLE = 8_000
PASSES = 3
#: The weights have a column for each language, so more of them are an error.
MOST_LANGUAGES = 256
#: Values are shares of a text, so they are scaled up for the learner.
SCALE = 30.0
#: A prediction of less confidence is rejected by the filter.
LEAST_SCORE = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def runs(text: str) -> list[np.ndarray]:
    """The hashed features of the text's runs, an array per order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, mixed = [], np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        if len(points) <= order:
            break
        mixed = (mixed[: len(points) - order] + points[order:] + np.uint32(order + 1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        out.append((mixed & np.uint32(FEATURES - 1)).astype(np.int64))
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    total = np.zeros(FEATURES + 1)
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            seen = np.zeros(FEATURES, bool)
            for ids in runs(text or ""):
                seen[ids] = True
            total[:FEATURES] += seen
            total[FEATURES] += 1
    yield total


def _featuriser(idf: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, values = [], []
            for text in batch.column(0).to_pylist():
                found = runs(text)
                every = np.concatenate(found) if found else np.zeros(0, np.int64)
                unique, counts = np.unique(every, return_counts=True)
                ids.append(unique)
                values.append(counts * idf[unique] * (SCALE / max(1, len(every))))
            yield pa.RecordBatch.from_arrays([list_array(ids, pa.int32()), list_array(values, pa.float32()), batch.column(1), batch.column(2)], ["ids", "values", "label", "key"])

    return features


def logits(text: str, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """The model's raw scores; weights have the inverse document frequencies and SCALE in them."""
    found = runs(text)
    total = sum(len(x) for x in found)
    return intercept + sum(weights[x].sum(0) for x in found) / total if total else intercept


def temperature(raw: np.ndarray, labels: np.ndarray) -> float:
    """Of a grid of temperatures, the one under which the labels are likeliest."""

    def loss(t: float) -> float:
        z = raw / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).sum())

    return min(np.geomspace(0.05, 20, 121), key=loss) if len(raw) else 1.0


def _predictor(text_col: str, languages: list[str], weights: np.ndarray, intercept: np.ndarray, heat: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(text_col).to_pylist():
                if not languages or text is None or not _LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                z = logits(text, weights, intercept) / heat
                p = np.exp(z - z.max())
                names.append(languages[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(names), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return predict


def fit(df: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"):
    """(languages, weights, intercept, temperature), learned from the rows that `training` marks and
    that have a text and a language. The sample is drawn by a hash of the whole row, and rows alike in it are learned
    from once, so that an id, text or row that repeats can't fill it."""
    whole = F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col), F.lit(3))
    rows = df.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), whole.alias("whole"), F.pmod(whole, F.lit(1_000_000)).alias("key"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return [], np.zeros((FEATURES, 0)), np.zeros(0), 1.0
    counts = summed(rows.select("text"), _document_counts, FEATURES + 1)
    n = counts[FEATURES]
    idf = np.log((1 + n) / (1 + counts[:FEATURES])) + 1
    label = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int")
    sample = rows.where(F.col("key") < int(1_000_000 * min(1.0, SAMPLE / n))).dropDuplicates(["whole"]).select("text", label.alias("label"), "key")
    sample = saved(sample.mapInArrow(_featuriser(idf), "ids array<int>, values array<float>, label int, key long"))
    leader = train(sample.where("key % 8 > 0"), Leader(FEATURES, max(2, len(languages)), alpha=0.5, l1=0.02, l2=0.01), PASSES)
    weights = leader.weights()
    held = sample.where("key % 8 = 0").orderBy("key", F.xxhash64("ids", "values")).toPandas()
    raw = np.array([np.asarray(v, float) @ weights[np.asarray(i, int)] + weights[-1] for i, v in zip(held["ids"], held["values"], strict=True)])
    heat = temperature(raw, held["label"].to_numpy())
    return languages, (weights[:-1] * idf[:, None] * SCALE).astype(np.float32), weights[-1], heat


def predict_languages(df: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns to keep) with `lang_pred` and `score` (0 to 1).

    Learns from the rows that `training` marks and that have text and language; predicts from the text
    alone. A null text, one without a letter, or any text if nothing could be learned is `und` with
    score 0. Columns of df with these names give way; others pass through. An empty table gives no rows.
    """
    model = fit(df, training, text_col, lang_col, id_col)
    sent, name, kinds = with_text(df, text_col, "lang_pred", "score", keep=keep)
    return sent.mapInArrow(_predictor(name, *model), f"{kinds}lang_pred string, score double")


def identified(df: DataFrame) -> DataFrame:
    """The documents whose language is told with some confidence. Columns as in df."""
    training = fold("doc_id", 3) != 1
    return predict_languages(df.withColumn("__lang", F.col("lang")), training, lang_col="__lang", keep=df.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*df.columns)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = predict_languages(docs, fold("doc_id", 3) != 1, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
