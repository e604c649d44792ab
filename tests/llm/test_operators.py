"""Each operator against brute force or an exact round trip, on small tables that hold nulls, empty and
long texts, repeated rows, ties and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from serialis.llm import audio, ftrl, hmm, html, language, linedup, mixing, neardup, neighbours, pieces, quality
from serialis.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string"
LONG = " ".join(f"w{i}" for i in range(5_000))
NEAR = " ".join(f"n{i}" for i in range(300))
ROWS = [
    (1, NEAR, "en", "a", 1, "x", None), (2, NEAR.replace("n150 ", "other "), "en", "a", 1, "x", None), (3, NEAR.upper(), "en", None, 1, "x", None), (4, None, None, "b", None, None, None), (5, "", "en", "b", 0, None, None),
    (6, LONG, "en", "c", 1, "x", "y"), (6, LONG, "en", "c", 1, "x", "y"), (None, "lonely words here", "fr", "c", 1, None, None), (8, "two words", "fr", "a", 1, None, None), (9, "  \n ", "fr", "a", 1, None, None),
    (10, f"head line\n{LONG}\ntail", "en", "a", 1, None, None), (11, "tail ünï ▁ <s> \x00 𝄞", "de", "a", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def words(text):
    return (text or "").encode().lower().split()


def test_audio(spark, docs):
    found = audio.audio_features(audio.store_clips(docs.select("doc_id", "text", "size"))).collect()
    assert len(found) == len(ROWS)
    wanted = Counter((i, (t or "").encode()) for i, t, *_ in ROWS)
    for r in found:
        payload, _ = audio.from_wav(r["media"])
        assert len(payload) % 64 == 0 and payload and (r["doc_id"], payload[: r["n_bytes"]]) in wanted and not payload[r["n_bytes"] :].strip(b"\0")
        assert audio.tensors(r["mels"]).num_rows == len(r["spans"]) and r["spans"][0]["begin"] == 0
    odd = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert tuple(audio.audio_features(odd).first())[2:] == (None,) * 4


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3)])
def test_resampling(up, down):
    x = np.random.default_rng(0).normal(size=300).astype(np.float32)
    h = audio.kernel(up, down)
    full = np.zeros(h.size)
    for p in range(up):
        full[p::up] = h[p][::-1]
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    wanted = np.convolve(spread, full)[audio._reach(up, down) * up :: down]
    found = audio.resample(x, up, down)
    assert np.allclose(found, wanted[: len(found)], atol=1e-5)


def test_hysteresis():
    assert audio.segments(np.array([0, 0, 3, 1, 1, 0, 1, 0, 0, 3.0])) == [(2, 5), (9, 10)]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    vectors[7] = (7, vectors[50][1])
    odd = [(401, None), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id"):
        scores = x @ x[r[0]]
        scores[r[0]] = -2
        best = np.lexsort((np.arange(400), -scores))[:5]
        assert len(r[1]) == 5 and np.allclose(r[1].sort_values("rank")["score"], scores[r[1].sort_values("rank")["vec_id"]])
        hit += len({*best} & {*r[1]["vec_id"]})
    assert hit >= 0.9 * 8 * 5
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0)
    assert few.count() == 2
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_every_length_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(60)] + [(i, rng.normal(size=3).tolist(), "y") for i in range(60, 80)] + [(50, rng.normal(size=6).tolist(), "z"), (1, rows1 := rng.normal(size=6).tolist(), "z"), (2, rows1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumns({c: F.lit("q") for c in ("id", "rid", "v", "list", "part", "lists", "rank", "n")})
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    asked = [r for r in rows if r[0] % 50 == 0]
    wanted = sorted((q[0], k + 1, i, round(-s, 9)) for q in asked for k, (s, i) in enumerate(sorted((-cosine(q[1], v), i) for r in rows if r is not q and len(r[1]) == len(q[1]) for i, v in [r[:2]])[:5]))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found) == wanted


def recall(spark, df, queries, k=5):
    """The share of the true k nearest that are found, for every query, by brute force."""
    t = df.toPandas()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = neighbours.nearest(df, queries).toPandas().groupby("query_id")["vec_id"].apply(set).to_dict()
    hits = []
    for q, mine in found.items():
        i = np.flatnonzero(ids == q)[0]
        scores = x @ x[i]
        scores[i] = -2
        hits.append(len(mine & set(ids[np.lexsort((ids, -scores))[:k]])) / k)
    assert len(found) == df.where(queries).count()
    return np.mean(hits)


def test_recall_and_lists_read(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert recall(spark, given, F.col("vec_id") % 50 == 0) >= 0.9
    # Vectors in clusters: the distance ratio leaves few lists, and they hold the neighbours.
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(60, size=12_000)] + 0.25 * rng.normal(size=(12_000, 16)))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    assert recall(spark, df, F.col("vec_id") % 50 == 0) >= 0.9
    shares = []
    for n in (3_000, 12_000):
        centroids = neighbours.fitted(neighbours.usable(df.where(F.col("vec_id") < n), "vec_id", "embedding"), n)[16]
        graph = neighbours.Graph(centroids)
        units = x[:n:50] / np.linalg.norm(x[:n:50], axis=1, keepdims=True)
        shares.append(np.mean([(far <= neighbours.LIST_RATIO * far[0]).sum() / len(centroids) for _, far in (graph.search(q, neighbours.LIST_RATIO) for q in units)]))
    assert shares[1] < shares[0] < 0.3


def test_pieces(spark, docs):
    model = pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = pieces.decode(pieces.encode(docs, model), model).collect()
    assert len(found) == len(ROWS)
    for r in found:
        text = r["text"] or ""
        assert r["ids"] == library.encode(text) and r["decoded"] == library.decode(r["ids"])
        spans = list(zip(r["begins"], r["ends"], strict=True))
        assert all(a[1] == b[0] or a == b for a, b in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][0], spans[-1][1]) == (0, len(text.encode())))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normaliser_with_map(rule):
    """The compiled character maps that the library brings, against the library's own normalisation."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    proto = pieces.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    spec.add_dummy_prefix = spec.escape_whitespaces = spec.remove_extra_whitespaces = True
    normalise = pieces.Normaliser(spec, False)
    texts = ["ﬁx  the\tＡＢＣ １２３ ", " ① ㍿ x　y ", "é ﷺ", "a\u200bb \xadc", "", "   ", "ガ ｶﾞ", "STRASSE Straße ǅ", "𝄞 ▁ é\u0301\u0323", "plain words"]
    rng = np.random.default_rng(5)
    texts += ["".join(map(chr, rng.choice([*range(32, 127), *range(0xC0, 0x250), *range(0x3040, 0x3100), *range(0xFF00, 0xFF70), 0x20, 0x3000], 60))) for _ in range(200)]
    for text in texts:
        out, begin, end = normalise(text.encode())
        assert out.decode() == library.normalize(text)
        assert np.all(np.diff(begin) >= 0) and np.all(begin <= end) and np.all(end <= len(text.encode()))
    out, begin, end = normalise("\t ﬁx\t \ta ".encode())
    if rule == "nmt_nfkc":
        assert out.decode() == "▁fix▁a" and (begin[3], end[3], begin[4], end[4]) == (2, 5, 2, 5)


def test_spans_as_running_sums():
    encoder = pieces.Encoder(pieces.default_model())
    for text in ["two  words", " lead", "tail  ", "ünï 𝄞\n\ttabs", "a" * 300, "\x00"]:
        ids = np.array(encoder.library.encode(text), np.int32)
        assert encoder.fixed and all(np.array_equal(a, b) for a, b in zip(encoder.spans(text, ids), encoder.projected(text, text.encode(), ids), strict=True))


def test_mixing(docs):
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(words(t))
    assert len(found) == len(ROWS)
    for s in sizes:
        mine = [r for r in found if r["source"] == s]
        assert all(r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] for r in mine)
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
    assert math.isclose(sum({r["source"]: r["target"] for r in found}.values()), 1.5 * sum(sizes.values()))
    cut = mixing.mixed_documents(docs)
    assert cut.columns == docs.columns and cut.where(mixing.word_count("text") == 0).isEmpty()
    written = {r["source"]: r["n"] for r in cut.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()}
    for s in sizes:
        assert written.get(s, 0) == sum(r["taken"] for r in found if r["source"] == s)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_of_repeated_rows(spark):
    """Rows alike in id, source and size are cut one by one: the words written are the target's."""
    rows = [(1, "one two three four five", "a", k) for k in range(9)] + [(2, "six seven eight nine ten", "a", 9), (None, "no id at all", "a", 10), (None, "no id either", None, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int")
    mix = mixing.mix(df).collect()
    written = mixing.mixed_documents(df).withColumn("n", mixing.word_count("text")).collect()
    assert sum(r["n"] for r in written) == sum(r["taken"] for r in mix) == sum({r["source"]: math.floor(r["target"]) for r in mix}.values())
    assert max(Counter(r["mark"] for r in written).values()) <= 2


def test_language_model(docs):
    rows = [np.array(x) for x in ([0, 1, 2, 1], [2, 0, 0], [1])]
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T
    for row, found in zip(rows, hmm.forward(rows, start, move, emit), strict=True):
        paths = np.array(np.meshgrid(*[[0, 1]] * len(row))).reshape(len(row), -1).T
        total = sum(start[p[0]] * emit[row[0], p[0]] * np.prod([move[p[t - 1], p[t]] * emit[row[t], p[t]] for t in range(1, len(row))]) for p in paths)
        assert math.isclose(math.log(total), found)
    first, moves, at = hmm.expected(rows, start, move, emit)
    assert math.isclose(first.sum(), 3) and math.isclose(moves.sum(), 5) and np.allclose(at.sum(1), [3, 3, 2])
    better = hmm.forward(rows, first / 3, moves / moves.sum(1)[:, None], at / at.sum(0))
    assert better.sum() >= hmm.forward(rows, start, move, emit).sum()

    scored = hmm.language_model_scores(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, *_ in ROWS if not held(i) for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((str(i), held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), b""]), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b""]), 6)) for i, t, *_ in ROWS)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scored) == wanted
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in scored)


def test_every_round_sees_all_training_documents(spark, monkeypatch):
    df, seen = spark.range(6_000).selectExpr("id as doc_id", "concat_ws(' ', 'word', id % 7, id) as text"), []

    def summed(*args):
        total = summed_before(*args)
        seen.append(total[hmm.STATES + hmm.STATES**2 :].sum())
        return total

    summed_before = hmm.summed
    monkeypatch.setattr(hmm, "summed", summed)
    trained = hmm.language_model_scores(df).first()["train_tokens"]
    assert len(seen) == hmm.HELD_ROUNDS + hmm.FREE_ROUNDS and np.allclose(seen, trained, rtol=1e-4)


def test_counts_in_short_floats():
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 50, n) for n in (400, 90, 90, 7, 1)]
    start, move, emit = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(50), 4).T
    for a, b in zip(hmm.expected(rows, start, move, emit), hmm.expected(rows, start, move, (emit / emit.max(1)[:, None]).astype(np.float32)), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)


def test_rows_in_blocks_of_steps(monkeypatch):
    rng = np.random.default_rng(7)
    rows = [rng.integers(0, 30, n) for n in (900, 301, 300, 40, 3, 1)]
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(30), 3).T
    whole = hmm.forward(rows, start, move, emit), *hmm.expected(rows, start, move, emit)
    monkeypatch.setattr(hmm, "_BLOCK_TOKENS", 50)
    assert len(hmm.blocks(rows)) > 9
    for a, b in zip(whole, (hmm.forward(rows, start, move, emit), *hmm.expected(rows, start, move, emit)), strict=True):
        assert np.allclose(a, b)


def test_counts_with_the_state_held():
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 30, n) for n in (50, 20, 20, 3, 1)]
    start, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(30), 3).T
    first, moves, at = hmm.expected(rows, start, np.eye(3), emit)
    held = hmm.expected_held(rows, start, emit)
    assert np.allclose(first, held[0]) and np.allclose(at, held[1]) and np.allclose(moves, np.diag(np.diag(moves)))


def test_scores_are_the_sum_over_all_paths(spark, monkeypatch):
    """The query's score of every short text against all state paths with the trained model's own shares."""
    monkeypatch.setattr(hmm, "STATES", 2)
    models = []
    made = hmm.Model.__init__
    monkeypatch.setattr(hmm.Model, "__init__", lambda self, *a: (made(self, *a), models.append(self))[0])
    texts = [(i, f"the cat {('sat', 'ran', 'slept')[i % 3]} extraordinarily{i % 4}") for i in range(40)] + [(40, "the unheard cat"), (41, None)]
    found = {r["doc_id"]: r for r in hmm.language_model_scores(spark.createDataFrame(texts, "doc_id long, text string"), F.col("doc_id") >= 38).collect()}
    model, counts = models[-1], Counter(w for i, t in texts if i < 38 for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    bottom = n + 0.1 * (v + 1)
    of_class = Counter()
    for w, c in counts.items():
        of_class[hmm.word_class(w)] += (c + 0.1) / (n + 0.1 * v)
    for i, t in texts:
        shares = [model.emit[hmm.word_class(w)] * (counts[w] + 0.1) / bottom / (of_class[hmm.word_class(w)] * (1 - 0.1 / bottom)) if counts[w] else np.full(2, 0.1 / bottom) for w in [*words(t), b""]]
        paths = np.array(np.meshgrid(*[[0, 1]] * len(shares))).reshape(len(shares), -1).T
        total = sum(model.start[p[0]] * shares[0][p[0]] * np.prod([model.move[p[k - 1], p[k]] * shares[k][p[k]] for k in range(1, len(p))]) for p in paths)
        assert math.isclose(math.log10(total), found[i]["score"], rel_tol=1e-9)


def test_held_out_texts_score_above_the_unigram_model(spark):
    scored = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > 0.95 * scored[1]


def test_learner():
    leader = ftrl.Leader(4, 1, 0.5, 0.01, 0.01)
    for k in range(400):
        leader.learn(np.array([k % 2]), np.array([1.0]), k % 2)
    w = leader.weights()[:, 0]
    assert w[0] < -1 < 1 < w[1] and w[2] == 0


def test_training_does_not_depend_on_partitions(spark):
    """The shards' states averaged by pass, against the same done in plain loops; however rows are dealt."""
    rng = np.random.default_rng(10)
    rows = [(sorted({*rng.integers(0, 20, 4).tolist()}), int(rng.integers(2)), int(rng.integers(1000))) for _ in range(200)]
    table = spark.createDataFrame([(i, [1.0] * len(i), y, k) for i, y, k in rows], "ids array<int>, values array<float>, label int, key long")
    one = ftrl.train(table.coalesce(1), ftrl.Leader(20, 1, 0.5, 0.01, 0.01), 3).weights()
    assert np.array_equal(one, ftrl.train(table.repartition(7), ftrl.Leader(20, 1, 0.5, 0.01, 0.01), 3).weights())
    shards = Counter()
    dealt = table.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(ftrl.SHARDS))).withColumn("tie", F.xxhash64("ids", "values")).orderBy("shard", "key", "label", "tie").collect()
    leader = ftrl.Leader(20, 1, 0.5, 0.01, 0.01)
    for _ in range(3):
        states = {}
        for r in dealt:
            if r["shard"] not in states:
                states[r["shard"]] = mine = ftrl.Leader(20, 1, 0.5, 0.01, 0.01)
                mine.z, mine.n = leader.z.copy(), leader.n.copy()
            states[r["shard"]].learn(np.array(r["ids"]), np.array(r["values"]), r["label"])
        shards.update(states.keys())
        leader.average(sum(s.state() for s in states.values()))
    assert len(shards) == ftrl.SHARDS and np.allclose(one, leader.weights())


def test_temperature():
    """Of logits that claim too much, the temperature that makes the labels likeliest, by trying many."""
    rng = np.random.default_rng(11)
    labels = rng.integers(3, size=400)
    raw = 8.0 * (np.eye(3)[np.where(rng.random(400) < 0.8, labels, rng.integers(3, size=400))])
    loss = lambda t: -sum(z[y] / t - np.log(np.exp(z / t).sum()) for z, y in zip(raw, labels, strict=True))
    grid = np.linspace(0.2, 20, 400)
    assert abs(loss(language.temperature(raw, labels)) - min(map(loss, grid))) < 0.5 and language.temperature(raw, labels) > 1.5
    assert language.temperature(raw[:0], labels[:0]) == 1.0


def test_scores_of_languages_by_hand(spark):
    """Predictions of the query against the fitted weights applied feature by feature."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    names, weights, intercept, heat = language.fit(df, F.lit(True))
    found = {r["doc_id"]: r for r in language.predict_languages(df, F.lit(True)).collect()}
    for r in df.limit(20).collect():
        counts = Counter(int(f) for order in language.runs(r["text"]) for f in order)
        z = (intercept + sum(n * weights[f].astype(float) for f, n in counts.items()) / sum(counts.values())) / heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert found[r["doc_id"]]["lang_pred"] == names[int(p.argmax())] and abs(found[r["doc_id"]]["score"] - p.max()) < 1e-4


def test_language_and_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.93


def test_languages_of_odd_texts(docs):
    found = {r["doc_id"]: r for r in language.predict_languages(docs, F.lit(True)).collect()}
    assert found[4]["lang_pred"] == found[5]["lang_pred"] == found[9]["lang_pred"] == "und" and found[1]["lang_pred"] in ("en", "fr", "de")
    scored = quality.quality_scores(docs, docs.selectExpr("doc_id", "1 as quality"), F.lit(True)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)


def brute(rows, k):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_near_duplicates(spark, docs, monkeypatch):
    wanted = brute({r[:2] for r in ROWS if r[0] is not None}, 4)
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(ROWS) and all(tuple(r)[1:] == wanted[r["doc_id"]] for r in found if r["doc_id"] is not None)
    # A large group of near copies at all distances, through the lists compared block by block.
    monkeypatch.setattr(neardup, "SHORT_LIST", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.002 * i else f"x{rng.integers(30)}" for w in base)) for i in range(40)]
    got = {r["doc_id"]: tuple(r)[1:] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4)


def test_near_duplicates_of_repeated_ids(spark):
    near, other = NEAR.replace("n150 ", "other "), " ".join(f"o{i}" for i in range(100))
    rows = [(1, NEAR), (5, near), (5, other), (5, other), (9, other + " more"), (7, "a single text"), (7, "quite another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert found == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 5, False)]
    left = sorted(tuple(r) for r in neardup.without_near_duplicates(df).collect())
    assert left == sorted([(1, NEAR), (5, other), (7, "a single text"), (7, "quite another text")])


def test_html():
    page = """<html><head><title>t</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; all</h1><script>var t="</p>";</script><p>One
      two <b>bold</b>.<p>Short.</p><div class="comments"><p>me too</p></div></article><div class="ad">buy</div><footer>f</footer></body></html>"""
    assert html.main_text(page) == "Head & all\n\nOne two bold.\n\nShort."
    body = "".join(f"<p>{'a long sentence of the text ' * 3}{k}</p>" for k in range(4))
    found = html.main_text(f"<ul><li><a href=a>one</a><li><a href=b>two</a></ul>{body}<p><a href=c>more links to follow from here, a long line</a></p>")
    assert found.count("\n\n") == 3 and "one" not in found and "follow" not in found
    for tag in ('<a href="/hidden-valley">', '<a href="/x?id=nav">', '<span title="a hidden truth">', '<span data-state="hidden" data-id="nav">'):
        assert html.main_text(f"<article><p>A {tag}word</p><svg class=x /><p>More</p></article>").startswith("A word\n\nMore")
    assert html.main_text('<article><p>One <span hidden>gone </span>two</p><nav><p>menu of the page</p></nav><p>End.</p></article>') == "One two\n\nEnd."
    assert html.main_text("") == "" == html.main_text("<nav>only a menu, and quite a long one at that, of more than sixty letters</nav>")
    assert html.main_text("<footer>the end of all pages</footer><article>Hi.</article>") == "Hi."
    assert html.surges([3, 50, 50, 2, 0, 0, 0, 0, 0, 0, 3, 70], [[*range(12)]]) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]
    assert html.surges([50, 50, 50, 50], html.runs([(0, False), (1, True), (1, True), (0, False)])) == [1, 2]


def brute_main_text(page):
    """The article's blocks by a plain parser of the pages' markup."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|ul|li|div|br)\b[^>]*>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_html_of_every_page(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()}
    found = QUERIES["op9_html_extraction"](spark, "/root/testdata/sf0.1").collect()
    assert len(found) == len(pages) and all(r["text"] == brute_main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in found)
    # Without an article mark the windows still find nearly the same text.
    unmarked = [re.sub(r"<(/?)article", r"<\1div", p) for p in pages.values()]
    same = sum(html.main_text(u) == brute_main_text(p) for u, p in zip(unmarked, pages.values(), strict=True))
    assert same >= 0.99 * len(pages)


@pytest.mark.parametrize("surges", [lambda w, k, surge=0: [*range(len(w))], lambda w, k, surge=60: [i for i, x in enumerate(w) if x >= surge], lambda w, k, surge=60: html_surges(w, [[*range(len(w))]], surge=surge)])
def test_html_by_windows_alone(spark, monkeypatch, surges):
    """Marked or not, pages are wrong without the windows: if every line of some weight stays, if each line decides by
    itself, or if windows reach over all kinds of lines."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    wanted = [brute_main_text(p) for p in pages]
    monkeypatch.setattr(html, "surges", surges)
    for given in (pages, [re.sub(r"<(/?)article", r"<\1div", p) for p in pages]):
        assert sum(html.main_text(p) == w for p, w in zip(given, wanted, strict=True)) < 0.5 * len(pages)


html_surges = html.surges


def test_html_windows_decide_where_markup_does_not(spark):
    """Menus of plain words, named by nothing, on pages without an article mark: markup leaves them, the windows don't."""
    plain = lambda m: re.sub(r"</?a\b[^>]*>", "", m[0]).replace("nav>", "div>")
    right = by_markup = 0
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        lines = html.lines_of(given := re.sub(r"<(/?)article", r"<\1div", re.sub(r"<nav>.*?</nav>", plain, page, flags=re.S)))
        right += html.main_text(given) == brute_main_text(page)
        by_markup += "\n\n".join(line[0] for line, (_, lowered) in zip(lines, html.weights(lines)[1], strict=True) if not lowered) == brute_main_text(page)
    assert right >= 0.99 * len(pages) and by_markup == 0


def test_html_leaves_no_short_text_out():
    """Text that markup doesn't rule out stays beside longer text, however short and wherever it stands; what it rules out goes, however long."""
    text = "A long sentence of the main text, with so many words that it surges by itself."
    for given, wanted in (
        (f"<article><p>{text}</p></article><p>Between.</p><article>Hi.</article>", [text, "Hi."]),
        (f"<article>Hi.</article><article class='post comments-open'><p>{text}</p></article><article class='big comment'>Me too.</article>", ["Hi.", text]),
        (f"<h1>Title</h1><nav><a href=x>menu</a></nav><p>{text}</p>", ["Title", text]),
        (f"<div><p>{text}</p><aside>See also</aside><p>The <b>end</b>.</p><ul><li>plain</ul></div><form>Send</form><ul><li>menu<li>words</ul>", [text, "The end.", "plain"]),
        (f"<div>menu words</div><nav>menu</nav><main><div>Short.</div><form>Send</form><div>{text}</div><nav>menu</nav><div>End.</div></main><nav>menu</nav><div>more words</div>", ["Short.", text, "End."]),
        (f"<p>One.</p><footer>{'menu ' * 400_000}</footer><p>Two.</p>", ["One.", "Two."]),
        (f"<footer>{'menu ' * 400_000}</footer>", []),
        (f"<p>Hi.</p><nav>menu</nav><div>{text}</div>", ["Hi.", text]),
    ):
        assert html.main_text(given) == "\n\n".join(wanted)


def brute_lines(rows, least):
    lines = {i: [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")] for i, t in rows}
    first, gone = {}, {i: set() for i in lines}
    runs = [(i, s, e) for i in sorted(lines) for s in range(len(lines[i])) for e in range(s + 1, len(lines[i]) + 1)]
    for i, s, e in runs:
        run = tuple(lines[i][s:e])
        if sum(len(x.split()) for x in run) >= least and first.setdefault(run, (i, s)) != (i, s):
            gone[i].update(range(s, e))
    return {i: [x for k, x in enumerate(lines[i]) if k not in gone[i]] for i in lines}


def test_lines(spark, docs):
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(f"line {rng.integers(3)} words"[: rng.integers(4, 13)] + " " * rng.integers(2) for _ in range(rng.integers(1, 9)))) for i in range(12)]
    found = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words=3).collect()
    wanted = brute_lines(rows, 3)
    assert all([x for x in r["text"].split("\n") if x.strip()] == wanted[r["doc_id"]] for r in found) and any(r["n_removed"] for r in found)
    odd = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in linedup.dedup_lines(docs).collect()}
    assert {(4, 0, 0), (10, 3, 1), (6, 1, 0)} <= odd
    assert linedup.dedup_lines(docs.where("false")).count() == 0


def brute_mix(rows):
    """The mix of (id, text, source) by filling sources in turns: (id, text) for each epoch of a document."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target = {}
    while True:
        open_sources = [s for s in names if s not in target]
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / max(1, sum(weight[s] for s in open_sources))
        full = [s for s in open_sources if level * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_sources}
            break
        target |= {s: 2 * sizes[s] for s in full}
    out = []
    for s in names:
        key = lambda i, t: int(hashlib.md5(f"17|{i}|{hashlib.md5(t.encode()).hexdigest() if t is not None else ''}".encode()).hexdigest()[:15], 16)
        mine = sorted((key(i, t), i, t) for i, t, of in rows if of == s)
        left, ahead = math.floor(target[s]), 0
        epochs, rest = divmod(left, sizes[s]) if sizes[s] else (0, 0)
        for _, i, t in mine:
            n = len(words(t))
            part = max(0, min(n, rest - ahead))
            ahead += n
            out += [(i, t)] * epochs if n else []
            if part:
                out.append((i, t if part == n else "".join(re.findall(r"[ \t-\r]*[^ \t-\r]+", t)[:part])))
    return out


def test_pipeline_by_hand(spark, tmp_path):
    """Every row of run() on a small table, with the first stage's own predictions as given."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").collect()
    rows = [r for r in given if len((r["text"] or "").split("\n")) <= 25][:120]
    repeated = "\n".join(" ".join(f"again{k}{i}" for i in range(30)) for k in range(3))
    rows += [(9000 + k, f"{NEAR} {k} only here\n{repeated}\nlast {k}", "en", f"s{k % 3}", 1) for k in range(4)]
    rows += [(9100, "  \n", "en", None, 2), (9101, None, "en", "s1", None), (9102, rows[0][1], "en", None, 3), (9103, repeated, "en", "s1", 4)]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).collect()
    assert len(first) > 100
    kept = {r["doc_id"]: (r["text"], r["source"]) for r in first}
    lines = brute_lines([(i, t) for i, (t, _) in kept.items()], 50)
    cut = {}
    for i, (t, source) in kept.items():
        mine = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        if len(lines[i]) == len(mine):
            cut[i] = (t, source)
        elif lines[i]:
            cut[i] = ("\n".join(lines[i]), source)
    groups = brute([(i, t) for i, (t, _) in cut.items()], 5)
    single = [(i, t, source) for i, (t, source) in cut.items() if groups[i][2]]
    assert len(kept) > len(cut) > len(single)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    squeezed = lambda t: re.sub(r"\n[ \t\r\v\f\n]*\n", "\n", t)  # noqa: E731  (blank lines stay in cut texts)
    wanted = Counter((i, squeezed(t)) for i, t in brute_mix(single))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], squeezed(r["text"])) for r in found) == wanted
    assert all(r["ids"] == library.encode(r["text"]) for r in found)


def test_pipeline(spark, docs):
    once = [r["ids"] for r in corpus_pipeline.run(spark, DATA).orderBy("doc_id", "n_chars").collect()]
    assert once and all(once)
    part = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, part, DATA).columns == part.columns
    last = corpus_pipeline.STAGES[-1][1](spark, part, DATA)
    assert last.columns == [*part.columns, "ids", "begins", "ends"] and last.count() == len(ROWS)


def test_log_mels_by_hand():
    """Every band's log energy of every window from a plain Fourier sum."""
    x = np.random.default_rng(13).normal(size=600).astype(np.float32)
    found = audio.log_mels(x, 8000)
    bank, t = audio.mel_bank(8000), np.arange(audio.WINDOW)
    assert found.shape == (1 + (600 - audio.WINDOW) // audio.STEP, audio.MELS)
    for k in (0, 3, len(found) - 1):
        part = x[k * audio.STEP : k * audio.STEP + audio.WINDOW] * np.hanning(audio.WINDOW)
        power = [abs((part * np.exp(-2j * np.pi * f * t / audio.LENGTH)).sum()) ** 2 for f in range(audio.LENGTH // 2 + 1)]
        assert np.allclose(found[k], np.log(power @ bank + 1e-6), rtol=1e-3, atol=1e-3)


def test_stored_tensors(spark, docs):
    """The stored column is an array of fixed-shape tensors, whose values are the clip's frames."""
    for r in audio.audio_features(audio.store_clips(docs.select("doc_id", "text"))).collect():
        samples, _ = audio.from_wav(r["media"])
        mels = audio.log_mels(audio.resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128), 8000)
        stored = audio.tensors(r["mels"])
        assert stored.schema.field("mel").type == audio.pa.fixed_shape_tensor(audio.pa.float16(), (audio.FRAMES, audio.MELS))
        assert list(zip(stored["begin"].to_pylist(), stored["end"].to_pylist(), strict=True)) == [tuple(s) for s in r["spans"]]
        frames = stored["mel"].to_numpy_ndarray().reshape(-1, audio.MELS)
        assert np.allclose(frames[: len(mels)], mels, rtol=2e-3, atol=2e-3) and not frames[len(mels) :].any()


def test_digests(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_audio_features"](spark, DATA).collect()}
    for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        data = t.encode() + b"\0" * (-len(t.encode()) % 64)
        assert (rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
