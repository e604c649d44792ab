"""Every operator over null texts, empty tables, and extra columns named as its own."""

import pytest
from pyspark.sql import functions as F

from serialis.llm import alignment, audio, hmm, html, language, lexicon, linedup, mixing, neardup, neighbours, pieces, quality, spelling

ROWS = [(1, "Hello there world this is text\nsecond line", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (3, "an id again", "fr", None), (None, "no id", "fr", "b"), (5, "Hello there world this is text\nsecond line", "en", "b")]
CLASHES = "size source_size target taken node label key n score kept component_id n_shingles ids begins ends decoded lang_pred held_out predicted word form root near pair pairs chunk a_ids b_ids n_tokens media samples mels spans segments h1 h2 keys a b n_bytes n_chars n_lines n_removed df rank".split()
#: name -> (operator, rows it gives for ROWS, and for ROWS without any text or language).
OPERATORS = {
    "audio": (lambda d: audio.audio_features(audio.store_clips(d)), 6, 6),
    "neighbours": (lambda d: neighbours.nearest(d.withColumn("embedding", F.when(F.col("text").isNotNull(), F.array(F.length("text") + 1.0, F.lit(1.0)))), F.col("doc_id") > 0, id_col="doc_id"), 12, 0),
    "pieces": (lambda d: pieces.decode(pieces.encode(d, pieces.default_model()), pieces.default_model()), 6, 6),
    "mixing": (mixing.mix, 6, 6),
    "mixed": (mixing.mixed_documents, None, 0),
    "language model": (hmm.language_model_scores, 6, 6),
    "quality": (lambda d: quality.quality_scores(d, d.sparkSession.createDataFrame([(1, 1), (5, None), (None, 0), (1, 0)], "doc_id long, quality int"), F.lit(True)), 6, 6),
    "quality without labels": (lambda d: quality.quality_scores(d, d.sparkSession.createDataFrame([], "doc_id long, quality int"), F.lit(True)), 6, 6),
    "near copies": (neardup.near_duplicates, 6, 6),
    "without near copies": (neardup.without_near_duplicates, 5, 6),
    "languages": (lambda d: language.predict_languages(d, F.lit(True)), 6, 6),
    "identified": (language.identified, None, 0),
    "html": (lambda d: html.extract(d.withColumn("html", F.col("text"))), 6, 6),
    "lines": (linedup.dedup_lines, 6, 6),
    "spelling": (lambda d: spelling.variants(spelling.corpus_words(d, least=2, least_count=1)), None, 0),
    "word bpe": (lambda d: lexicon.decode(lexicon.encode(d, lexicon.default_tokenizer(), lexicon.compiled(d.sparkSession, lexicon.frequent_words(d, lexicon.default_tokenizer()), lexicon.default_tokenizer())), lexicon.default_tokenizer()), 6, 6),
    "alignment": (lambda d: alignment.align(d, *alignment.default_tokenizers()), 6, 6),
    "alignment counts": (lambda d: alignment.alignment_counts(d, *alignment.default_tokenizers()), 6, 6),
    "without lines": (linedup.without_repeats, 6, 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    operator, rows, rows_of_nulls = OPERATORS[name]
    base = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clashing = base.withColumns({c: F.lit("x") for c in CLASHES})
    found = operator(clashing)
    assert len(set(found.columns)) == len(found.columns)
    assert rows in (None, found.count())
    assert operator(clashing.where("false")).count() == 0
    nulls = clashing.withColumns({c: F.lit(None).cast("string") for c in ("text", "lang")})
    assert operator(nulls).count() == rows_of_nulls


@pytest.mark.parametrize("name", [n for n, (_, rows, _) in OPERATORS.items() if rows == 6])
def test_very_long_text(spark, name):
    """A text of 60,000 words in 600 lines beside short ones: a row for each, none cut."""
    text = "\n".join(" ".join(f"word{i * 7 % 911} w{k}" for i in range(50)) for k in range(600))
    df = spark.createDataFrame([(1, text, "en", "a"), (2, "short", "en", "a"), (3, text + " end", "fr", "b")], "doc_id long, text string, lang string, source string")
    found = OPERATORS[name][0](df).collect()
    assert len(found) == 3
    if name == "language model":
        assert sorted(r["n_tokens"] for r in found) == [2, 60_001, 60_002]
    if name == "mixing":
        assert sorted(r["size"] for r in found) == [1, 60_000, 60_001]
    if name == "near copies":
        assert sorted(r["component_id"] for r in found) == [1, 1, 2]
    if name == "pieces":
        assert all(r["decoded"] == r["text"] and r["ends"][-1] == len(r["text"].encode()) for r in found)
