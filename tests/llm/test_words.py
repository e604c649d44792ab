"""Spelling variants, word BPE and alignment against brute force and the libraries."""

import bisect
import hashlib
import io
import itertools
import json
import random
import re
import threading
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serialis.llm import alignment, audio, ftrl, hmm, language, lexicon, mixing, neardup, neighbours, pieces, quality, spelling
from serialis.llm.common import saved, settled
from serialis.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a▁b", "x\x00y <|endoftext|> <s> </s> 𝄞 中文 ", "  \n\n\t " + " " * 300 + " 　  é", "a" * 3000 + " ½²Ⅷ ́", "😀" * 200 + "ﷺ", "Hello <|endoftext|>World<|startoftext|><|endoftext|",
    "é é ñ Ａ ΣΑΣ ﬁ العربية हिन्दी", "don't I'LL we've 12345 a1b2 x's", "\x1c\x1d a\x1eb", "İıſK", " x y\u0085z　w", ("ab" * 40 + "é") * 30, "".join(map(chr, range(0x300))), " ".join(map(chr, range(0x300))),
]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_and_forms(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(250)}
    base = "".join(rng.choice("abcdefß") for _ in range(spelling.LONG))
    words |= {base, base + "x", base + "xy", "x" + base, base[:9] + "q" + base[10:], base[:9] + "r" + base[10:], base[:20] + base[21:], "a" * 47, "a" * 48, "a" * 49, "a" * 300, "a" * 301}
    counted = {w: rng.choice([2, 3, 20, 30, 300, 300, 4000]) for w in words}
    found = spelling.variants(spark.createDataFrame(list(counted.items()), "word string, n long").repartition(3)).collect()
    wanted = {}
    for w, n in counted.items():
        others = sorted((-counted[x], x.encode(), x) for x in words if near(w, x))
        form = others[0][2] if others and -others[0][0] >= 10 * n else None
        wanted[w] = (form, n, len(others), counted[form] if form else None)
    root = lambda w: root(wanted[w][0]) if wanted[w][0] else w
    assert {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"]) for r in found} == wanted
    assert {r["word"]: r["root"] for r in found} == {w: root(w) for w in words}
    assert any(wanted[w][0] and root(w) != wanted[w][0] for w in words)


def test_words_of_a_corpus(spark):
    rows = [(k, " ".join(random.Random(k).choice(["Wörterbuch", "words", "Straßen", "ÀÉÎÕÜß×÷", "lettERS", "gardening"]) + random.Random(k).choice([", ", "1", "_"]) for _ in range(40))) for k in range(60)]
    rows += [(1, "gardening Gardening"), (None, "gardening"), (3, None), (4, ""), (5, "a" * 100_000)]
    wanted = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split(" "):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if run and not (h := zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())) % 31:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                wanted[run] += 1
    found = spelling.corpus_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), every=31)
    assert {r["word"]: r["n"] for r in found.collect()} == {w: n for w, n in wanted.items() if n >= 2}
    assert any(w not in ("wörterbuch", "straßen", "gardening", "lettersx") and n >= 2 for w, n in wanted.items())
    assert spelling.variants(found.where("false")).count() == 0


def test_automaton_is_minimal_and_ranks_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))).encode() for _ in range(400)})
    made = lexicon.Automaton.compiled(words, [np.array([k, k + 1]) for k in range(len(words))])
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(made.final) - 1 == len(endings) and len(made.keys) < sum(map(len, words)) / 3
    asked = words + [w + b"a" for w in words] + [b"z", b""]
    flat, lengths = np.frombuffer(b"".join(asked), np.uint8), np.array(list(map(len, asked)))
    place = {w: k for k, w in enumerate(words)}
    assert made.ranks(flat, np.cumsum(lengths) - lengths, lengths).tolist() == [place.get(w, -1) for w in asked]
    assert (made.ids[made.offsets[3]], made.ids[made.offsets[3] + 1]) == (3, 4)


def test_merges_of_long_words():
    text = lexicon.default_tokenizer()
    merges, library = lexicon.Merges(json.loads(text)["model"]), Tokenizer.from_str(text)
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 900):
        word = "".join(rng.choice("aeinorst") for _ in range(n))
        wanted = library.encode(word, add_special_tokens=False).ids
        assert merges.by_heap(word.encode()).tolist() == merges([word.encode()])[0].tolist() == wanted
        assert merges.side_by_side(np.frombuffer(word.encode(), np.uint8), np.array([n]))[0].tolist() == wanted


@pytest.mark.parametrize("known", [0, 1])
def test_word_bpe(spark, known):
    text = lexicon.default_tokenizer()
    library = Tokenizer.from_str(text)
    rng = random.Random(8)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(150)) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    words = lexicon.frequent_words(df.union(df).union(df).union(df).coalesce(1), text) if known else []
    assert bool(words) == bool(known)
    name = lexicon.compiled(spark, words, text)
    found = lexicon.decode(lexicon.encode(df, text, name), text).collect()
    assert len(found) == len(texts) and found[0].asDict().keys() == {"doc_id", "text", "ids", "decoded"}
    for r in found:
        wanted = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == wanted and r["decoded"] == library.decode(wanted, skip_special_tokens=False)


def test_most_frequent_words(spark):
    df = spark.createDataFrame([("common " * 500 + "usual " * 200 + "rare " * 20,)], "text string")
    assert lexicon.frequent_words(df, lexicon.default_tokenizer(), most=2) == [b"common", b"usual"]
    assert lexicon.frequent_words(df.where("false"), lexicon.default_tokenizer()) == []


def test_word_bpe_digests(spark):
    library = Tokenizer.from_str(lexicon.default_tokenizer())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_word_bpe"](spark, DATA).collect()}
    assert len(found) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert found[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def grouped(texts):
    """(ids of A, ids of B, groups) of each text, by the library's tokens and the set of common ends."""
    tokenizer, model = alignment.default_tokenizers()
    a, b = Tokenizer.from_str(tokenizer), sentencepiece.SentencePieceProcessor(model_proto=model)
    a.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(lexicon.BYTE_LETTERS)}
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            yield [], [], []
            continue
        ends_a, ends_b = ([*itertools.accumulate(map(len, x))] for x in (bytes_a, bytes_b))
        cuts, groups = sorted({*ends_a} & {*ends_b}), defaultdict(lambda: ([], []))
        for side, ends, ids in ((0, ends_a, ids_a), (1, ends_b, ids_b)):
            for end, k in zip(ends, ids, strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(k)
        yield ids_a, ids_b, [groups[k] for k in range(len(cuts))]


def test_alignment(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000 + k // 2, t) for k, t in enumerate(ODD)] + [(None, "no id"), docs[0]]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, pair string").repartition(3)
    tokens = [*grouped(t for _, t in docs)]
    counts, best, wanted = Counter(), Counter(), []
    for _, _, groups in tokens:
        counts.update({(p, q) for x, y in groups for p in x for q in y})
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    for (doc_id, _), (a, b, groups) in zip(docs, tokens, strict=True):
        linked = [(p, q) for x, y in groups for p in x for q in y]
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        wanted.append((str(doc_id), len(a), len(b), len(groups), len(linked), sum(counts[x] == best[x[0]] for x in linked), sum(counts[x] for x in linked), hashlib.sha256(written.encode()).hexdigest() if a else ""))
    found = alignment.alignment_counts(df, *alignment.default_tokenizers()).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in found) == sorted(wanted)
    assert alignment.alignment_counts(df.where("false"), *alignment.default_tokenizers()).count() == 0


def test_groups_of_ends():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60, 400):
        for share in (0.2, 0.6, 0.97):
            a, b = (np.flatnonzero(np.append(rng.random(n) < share, True)).astype(np.int32) + 1 for _ in "ab")
            if share > 0.9:
                b = np.union1d(a, b[:1]).astype(np.int32)
            common = np.intersect1d(a, b)
            begins = alignment.aligned(a, b)
            for ends, found in zip((a, b), begins, strict=True):
                assert found.tolist() == [0, *(np.searchsorted(ends, common[:-1]) + 1)]


def test_links_of_a_large_group():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 90).astype(np.int32), rng.integers(0, 9, 80).astype(np.int32)
    pairs, times = alignment.links(a, b, np.array([0, 1]), np.array([0, 2]), 10)
    wanted = Counter(int(x) * 10 + int(y) for x, y in [*itertools.product(a[:1], b[:2]), *itertools.product(a[1:], b[2:])])
    total = Counter()
    for p, t in zip(pairs.tolist(), times.tolist(), strict=True):
        total[p] += t
    assert total == wanted and len(pairs) < 90 * 80


def test_byte_tokens_are_the_librarys():
    """Every assigned code point in three surroundings."""
    tokenizer, _ = alignment.default_tokenizers()
    library, mine = Tokenizer.from_str(tokenizer), alignment.ByteTokens(tokenizer)
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xAC00, 7), *range(0xF900, 0x11000), *range(0x1F000, 0x1FB00)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{c}1{c} {c} " for c in points[k : k + 50]) for k in range(0, len(points), 50)]
    for text, ids in zip(texts, mine(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def hot(n):
    """(doc_id, text, lang): one id holds a third of the rows, with a text each; one whole row is another third."""
    return [(7, f"words of one document {k} {k * k}", "en") for k in range(n)] + [(8, "the same again", "fr")] * n + [(100 + k, f"ein anderer Text {k}", "de") for k in range(n)]


def test_samples_keep_their_bounds(spark, monkeypatch):
    df = spark.createDataFrame(hot(3000), "doc_id long, text string, lang string").repartition(4).cache()
    drawn = {}
    for module in (language, quality):
        monkeypatch.setattr(module, "SAMPLE", 600)
        monkeypatch.setattr(module, "train", lambda rows, leader, passes, name=module.__name__: drawn.setdefault(name, rows) and leader)
    language.fit(df, F.lit(True))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.quality_scores(df, labels, F.lit(True))
    for rows in drawn.values():
        shards = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(ftrl.SHARDS))).count().collect()
        assert sum(r["count"] for r in shards) < 800 and max(r["count"] for r in shards) < 0.5 * 800
    assert len(drawn) == 2 and drawn["serialis.llm.language"].count() > 200


def test_sample_of_vectors_keeps_its_bound(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(7 if k % 3 == 0 else k, rng.normal(size=4).tolist()) for k in range(6000)], "vec_id long, embedding array<double>")
    seen = []
    monkeypatch.setattr(neighbours, "SAMPLE", 500)
    monkeypatch.setattr(neighbours, "_by_length", lambda sample, n, f=neighbours._by_length: (seen.append(len(sample)), f(sample, n))[1])
    neighbours.fitted(neighbours.usable(rows, "vec_id", "embedding"), 6000)
    assert 350 < seen[0] < 650


def test_key_ranges_of_a_repeated_id(spark):
    df = spark.createDataFrame([(7 if k % 3 == 0 else k, f"word {k}", "a") for k in range(3000)], "doc_id long, text string, source string")
    ranges = mixing.mix(df).groupBy(F.floor(F.col("key") / F.lit(2.0**60) * 55)).count().collect()
    assert max(r["count"] for r in ranges) < 4 * 3000 / 55


def test_two_runs_at_a_time(spark):
    """Neither drops what the other has written."""
    made = []

    def run(k):
        spent = []
        first = settled(lambda: saved(spark.range(50).withColumn("k", F.lit(k))), spent)
        second = settled(lambda: saved(first.where("id > 9")).union(saved(first.where("id < 5"))), spent)
        made.append((k, second.count(), second.select("k").distinct().first()[0]))

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [(k, 45, k) for k in range(3)]


def documents_of(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def test_piece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.default_model())
    found = {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op3_sentencepiece"](spark, DATA).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    wanted = {}
    for k, text in documents_of(spark, DATA).items():
        ids = library.encode(text)
        wanted[k] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert found == wanted


def test_media_digests(spark):
    """The stored form is a WAV file as the standard library writes it, and the feature is told from its tensors."""
    rows = {r["doc_id"]: r for r in QUERIES["op1_audio_features"](spark, DATA).collect()}
    for k, text in documents_of(spark, DATA).items():
        data = text.encode()
        data += b"\0" * (-len(data) % 64 if data else 64)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(audio.RATE), w.writeframes(data)
        media = file.getvalue()
        _, tensors, spans, loud = audio.features(media)
        told = f"{len(spans)} tensors, {len(loud)} segments, {sum(b - a for a, b in loud):.3f} s, {hashlib.md5(tensors).hexdigest()}"
        assert (rows[k]["media_bytes"], rows[k]["media_sha256"], rows[k]["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), told)


def test_quality_scores_word_by_word(spark):
    """Scores are the weights' mean over a text's words, shapes and pairs, told apart one by one."""
    rng = np.random.default_rng(5)
    weights, intercept = rng.normal(size=quality.FEATURES).astype(np.float32), 0.25
    texts = ["", "one", "Same same SAME 12-3", "A b!! c,, dd 2024", "é ü " * 40, " ".join(f"w{k % 7}" for k in range(300))]
    mask = quality.FEATURES - 1

    def score(text):
        words = text.encode().split()
        if not words:
            return 1 / (1 + np.exp(-intercept))
        kinds = lambda w: bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in w)
        codes = [(xxhash.xxh32_intdigest(w.lower()), xxhash.xxh32_intdigest(re.sub(rb"(.)\1+", rb"\1\1", kinds(w), flags=re.S), 1)) for w in words]
        ids = [c & mask for pair in codes for c in pair]
        for (a, b), (c, d) in itertools.pairwise(codes):
            mixed = [((x * 0x9E3779B97F4A7C15 + y) * 0xBF58476D1CE4E5B9 & 2**64 - 1) >> 20 for x, y in ((a, c), (b, d))]
            ids += [(1 if a == c else mixed[0]) & mask, mixed[1] & mask]
        z = intercept + quality.SCALE * float(np.mean([weights[i] for i in ids], dtype=np.float32))
        return 1 / (1 + np.exp(-z))

    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(2)
    found = df.mapInArrow(quality._scorer("text", weights, intercept), "k long, text string, score double").collect()
    assert all(abs(r["score"] - score(r["text"])) < 1e-5 for r in found) and len(found) == len(texts)


def test_held_out_likelihood(spark):
    """On documents that the language model has not learned from it is better than single words with smoothed counts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = hmm.language_model_scores(rows).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    per_token, base = scored[0] / scored[2], scored[1] / scored[2]
    assert per_token > base + 0.2 and per_token > -4.6


def test_long_lists_of_unlinked_and_long_texts(spark, monkeypatch):
    """Many candidates that aren't linked, and long texts: blocks of few shingles give the same as one block."""
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.0012 * i else f"x{rng.integers(50)}" for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join([*base * 20, *(f"l{i}{k}" for k in range(1500 + 40 * i))])) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def shingled(text):
        words = text.split()
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}

    sets = {i: shingled(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in itertools.combinations(sets, 2):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[i] = root[j] = min(root[i], root[j])
    for shingles in (500_000, 2_000):
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
        found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
        assert found == root
    assert len(set(root.values())) > 4


def test_alignment_in_bounded_rows(spark, monkeypatch):
    """No row between the steps grows with a chunk or a text, and texts in many pieces keep their sums."""
    tokenizer, model = alignment.default_tokenizers()
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k} {'abcdefgh'[k % 8]}{k * 7919}" for k in rng.integers(0, 3000, n)) for n in (3000, 0, 1, 40, 900)] * 3 + [None, "\x00 odd"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    wanted = sorted(tuple(r) for r in alignment.alignment_counts(docs, tokenizer, model).collect())
    tables = []
    monkeypatch.setattr(alignment, "saved", lambda df, write=alignment.saved: tables.append(write(df)) or tables[-1])
    for piece in (1024, 5):
        monkeypatch.setattr(alignment, "PIECE", piece, raising=False)
        assert sorted(tuple(r) for r in alignment.alignment_counts(docs, tokenizer, model).collect()) == wanted
        for table in tables:
            sizes = [F.max(F.size(f.name)) for f in table.schema if f.dataType.typeName() == "array"]
            assert not sizes or max(n for n in table.agg(*sizes).first() if n is not None) <= piece
        tables.clear()
