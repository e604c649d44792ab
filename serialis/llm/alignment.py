"""Alignment of two tokenisations of the same bytes, by runs along a diagonal.

Both tokenisations of a text end tokens at byte offsets. While they agree one to one, the two arrays of
ends are equal at the present shift between their indexes; stretches of 1, 2, 4, ... ends are compared
as memory until one differs, and halving finds the place. There the side that is behind takes tokens
until both end together, which makes an irregular group, and the shift is what that leaves. Groups
are the smallest stretches of bytes at whose ends both end tokens.

Corpus-wide counts of linked ids go by chunks of documents: a chunk hands on each of its distinct pairs once,
with the number of its documents that hold it, and gets the corpus's count back once. What it hands on lies in
rows of bounded size: Spark's writers and readers hold hundreds or thousands of rows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import documents, list_array, saved, slices, with_text
from serialis.llm.lexicon import BYTE_LETTERS

#: Bytes of text of a chunk, at least; a longer text is a chunk of its own.
CHUNK = 4_000_000
#: Pairs in a row of a chunk, at most; a text or a chunk with more has several rows.
PIECE = 1024
#: Links of a group up to which they are listed one by one; beyond, distinct ids are counted first.
_LISTED = 4096
#: How byte-level tokenizers of this kind split a text before merging (a fixed value).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """A byte-level BPE tokenizer from its JSON. Special tokens' strings are ordinary text."""

    def __init__(self, tokenizer: str):
        parsed, of = json.loads(tokenizer), {c: b for b, c in enumerate(BYTE_LETTERS)}
        before = parsed["pre_tokenizer"]
        if before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or parsed["normalizer"]:
            raise ValueError("a byte-level tokenizer is needed that keeps texts as they are")
        added = {t["content"] for t in parsed["added_tokens"]}
        vocab = {bytes(map(of.__getitem__, t)): k for t, k in parsed["model"]["vocab"].items() if t not in added}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes[k] = token
        self.lengths = np.array([len(t) for t in self.bytes], np.int32)
        self.library = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=vocab, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.library.encode_to_numpy(t, disallowed_special=()).astype(np.int32) for t in texts]


class PieceTokens:
    """A SentencePiece model, which puts a space in front itself."""

    def __init__(self, model: bytes):
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [library.id_to_piece(k) for k in range(library.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if library.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.lengths = np.array([len(t) for t in self.bytes], np.int32)
        self._objects = np.array(self.bytes, object)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self._objects[ids].tolist())


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins_a, begins_b): the indexes of the first token of every group, of int32 ends whose last are equal."""
    raw_a, raw_b, a, b = ends_a.tobytes(), ends_b.tobytes(), ends_a.tolist(), ends_b.tolist()
    inner_a: list[int] = []
    inner_b: list[int] = []
    i = j = 0
    while i < len(a):
        if a[i] == b[j]:
            i, j, size = i + 1, j + 1, 8  # bytes of the next stretch: two ends
            while i < len(a) and raw_a[4 * i : 4 * i + size] == raw_b[4 * j : 4 * j + size]:
                i, j, size = i + (size >> 2), j + (size >> 2), size << 1
            while size > 4:
                size >>= 1
                if raw_a[4 * i : 4 * i + size] == raw_b[4 * j : 4 * j + size]:
                    i, j = i + (size >> 2), j + (size >> 2)
            if i >= len(a):
                break
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
                inner_a.append(i)
            else:
                j += 1
                y = b[j]
                inner_b.append(j)
        i, j = i + 1, j + 1
    return _others(len(a), inner_a), _others(len(b), inner_b)


def _others(n: int, inner: list[int]) -> np.ndarray:
    first = np.ones(n, bool)
    first[inner] = False
    return np.flatnonzero(first)


class Aligner:
    """Both tokenizers, and the groups of texts."""

    def __init__(self, tokenizer: str, model: bytes):
        self.a, self.b = ByteTokens(tokenizer), PieceTokens(model)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of A, ids of B, first tokens of the groups in A and in B) of each text; all are empty if the
        text is, or if either side's tokens don't spell a space and the text."""
        none = np.zeros(0, np.int32)
        for text, a, b in zip(texts, self.a([f" {t}" for t in texts]), self.b(texts), strict=True):
            ends_a, ends_b, raw = np.cumsum(self.a.lengths[a], dtype=np.int32), np.cumsum(self.b.lengths[b], dtype=np.int32), text.encode()
            if not text or not len(b) or ends_a[-1] != len(raw) + 1 or ends_b[-1] != len(raw) + 1 or self.b.joined(b) != b" " + raw:
                yield none, none, none, none
            else:
                yield a, b, *aligned(ends_a, ends_b)


class Digester:
    """Groups as text: decimal ids of A, a bar, decimal ids of B, semicolons between groups."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.names = np.array([f"{mark}{k}" for mark, n in ((",", n_a), (";", n_a), (",", n_b), ("|", n_b)) for k in range(n)], object)

    def __call__(self, a: np.ndarray, b: np.ndarray, begins_a: np.ndarray, begins_b: np.ndarray) -> str:
        if not len(a):
            return ""
        per_a, per_b = np.diff(begins_a, append=len(a)), np.diff(begins_b, append=len(b))
        names_a, names_b = a.astype(np.int64), b.astype(np.int64) + 2 * self.n_a
        names_a[begins_a] += self.n_a
        names_b[begins_b] += self.n_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(begins_b, per_a)] = names_a
        order[np.arange(len(b)) + np.repeat(begins_a + per_a, per_b)] = names_b
        return sha256("".join(self.names[order].tolist())[1:].encode()).hexdigest()


def links(a: np.ndarray, b: np.ndarray, begins_a: np.ndarray, begins_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, how many links): a pair of ids is a * n_b + b. A pair may come more than once."""
    per_a, per_b = np.diff(begins_a, append=len(a)), np.diff(begins_b, append=len(b))
    total = per_a * per_b
    one = total == 1
    found, times = [a[begins_a[one]].astype(np.int64) * n_b + b[begins_b[one]]], [np.ones(int(one.sum()), np.int64)]
    few = (total > 1) & (total <= _LISTED)
    if few.any():
        sizes, widths = total[few], np.repeat(per_b[few], total[few])
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found.append(a[np.repeat(begins_a[few], sizes) + step // widths].astype(np.int64) * n_b + b[np.repeat(begins_b[few], sizes) + step % widths])
        times.append(np.ones(len(step), np.int64))
    for k in np.flatnonzero(total > _LISTED):
        (x, times_x), (y, times_y) = (np.unique(ids[i : i + n], return_counts=True) for ids, i, n in ((a, begins_a[k], per_a[k]), (b, begins_b[k], per_b[k])))
        found.append((x.astype(np.int64)[:, None] * n_b + y).ravel())
        times.append((times_x[:, None] * times_y).ravel())
    return np.concatenate(found), np.concatenate(times)


def align(df: DataFrame, tokenizer: str, model: bytes, text_col: str = "text") -> DataFrame:
    """df with `a_ids`, `b_ids` and, for every group of bytes at whose ends both end a token, the index of its
    first token on either side, `a_begins` and `b_begins`.

    A is a byte-level BPE tokenizer (JSON) over a space and the text, B a SentencePiece model over the text.
    Null or empty texts, and those which either side doesn't spell byte by byte, have empty arrays.
    Columns of df of these names give way; others pass through, repeated rows and nulls included. An empty
    table gives no rows."""
    names = ["a_ids", "b_ids", "a_begins", "b_begins"]
    sent, name, kinds = with_text(df, text_col, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, model)
        for batch in slices(batches):
            rows = list(aligner([x or "" for x in batch.column(name).to_pylist()]))
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(list_array([r[k] for r in rows], pa.int32()) for k in range(4))], [*kept, *names])

    return sent.mapInArrow(run, kinds + ", ".join(f"{n} array<int>" for n in names))


#: A row has a text and some of its pairs (from `row` to `times`), or some of the chunk's pairs (from `place` on).
_CHUNKS = "chunk long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<int>, times array<int>, place int, pairs array<long>, held array<int>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def pieces(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, begin) of pieces of at most so many values, of lists of these sizes that lie one after the other; an empty list is one piece."""
    per = np.maximum(1, -(-sizes // most))
    of = np.repeat(np.arange(len(sizes)), per)
    return of, (np.cumsum(sizes) - sizes)[of] + (np.arange(len(of)) - (np.cumsum(per) - per)[of]) * most


def _lists(begins: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype(), copy=False)))


def _chunker(tokenizer: str, model: bytes):
    """Texts in chunks: what each has by itself, its distinct pairs as places in those of the chunk, and for each of
    the chunk's pairs how many of its texts hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer, model)
        n_a, n_b = len(aligner.a.bytes), len(aligner.b.bytes)
        digest, number = Digester(n_a, n_b), TaskContext.get().partitionId() << 32
        facts: list[tuple] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = dict(c.split() for c in _CHUNKS.split(", "))
            return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), *(columns[c] if c in columns else pa.nulls(n, _KINDS[k]) for c, k in kinds.items() if c != "chunk")], [*kinds])

        def chunk() -> Iterator[pa.RecordBatch]:
            keys, times = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs, held = np.unique(keys, return_counts=True)
            of, begins = pieces(np.array([len(x) for x, _ in found]), PIECE)
            own = dict(zip(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"], zip(*facts, strict=True), strict=True))
            own = {n: pa.array(x, pa.string() if n == "groups_sha256" else pa.int64()).take(pa.array(of)) for n, x in own.items()}
            places = np.searchsorted(pairs, keys)
            yield rows(len(of), row=pa.array(of.astype(np.int32)), **own, pair=_lists(begins, places, pa.int32()), times=_lists(begins, times, pa.int32()))
            _, begins = pieces(np.array([len(pairs)]), PIECE)
            yield rows(len(begins), place=pa.array(begins.astype(np.int32)), pairs=_lists(begins, pairs, pa.int64()), held=_lists(begins, held, pa.int32()))

        for batch in slices(batches, 50):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc_id, text, (a, b, begins_a, begins_b) in zip(batch.column(0).to_pylist(), texts, aligner(texts), strict=True):
                keys, times = links(a, b, begins_a, begins_b, n_b)
                order = np.argsort(keys)
                keys, times = keys[order], times[order]
                first = np.flatnonzero(np.diff(keys, prepend=-1))
                facts.append((doc_id, len(a), len(b), len(begins_a), int(times.sum()), digest(a, b, begins_a, begins_b)))
                found.append((keys[first], np.add.reduceat(times, first) if len(first) else times))
                size += len(text)
                if size >= CHUNK:
                    yield from slices(chunk(), 1000)
                    number, size, facts, found = number + 1, 0, [], []
        if facts:
            yield from slices(chunk(), 1000)

    return run


_COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(key: tuple, texts: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a chunk, with the counts of its pairs."""
    number, best = np.zeros(max(counts.num_rows, 1), np.int64), np.zeros(max(counts.num_rows, 1), bool)
    place = counts.column("place").to_numpy()
    number[place], best[place] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
    pair, times = (texts.column(n).combine_chunks() for n in ("pair", "times"))
    ends = np.concatenate([[0], np.cumsum(pair.value_lengths().to_numpy(), dtype=np.int64)])
    pair, times = pair.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    of = texts.column("row").to_numpy()
    _, first = np.unique(of, return_index=True)
    sums = []
    for x in (best, number):
        sums.append(np.zeros(len(first), np.int64))
        np.add.at(sums[-1], of, np.diff(np.concatenate([[0], np.cumsum(times * x[pair])])[ends]))
    facts = texts.take(pa.array(first))
    return pa.table([*(facts.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), facts.column("groups_sha256")], [c.split()[0] for c in _COUNTED.split(", ")])


def alignment_counts(df: DataFrame, tokenizer: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Links are all pairs of tokens of A and B in one group. A pair of ids counts the documents that link it,
    over all of df; n_best are the links whose count is the highest of their id of A, count_sum the counts'
    sum. Rows that repeat an id are documents of their own. Null or empty texts, and those which a
    tokenizer doesn't spell byte by byte, have zeros and an empty digest. An empty table gives no rows.
    Other columns are ignored.
    """
    n_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    chunks = saved(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_chunker(tokenizer, model), _CHUNKS))
    listed = chunks.where("pairs IS NOT NULL")
    held = listed.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count"))
    counts = saved(held.withColumn("a", F.floor(F.col("pair") / n_b)))
    # One row per id of A: as many as A has ids, whatever the corpus.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    judged = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = listed.select("chunk", F.col("place").alias("begin"), F.posexplode("pairs").alias("nth", "pair"))
    told = asked.join(judged, "pair").select("chunk", (F.col("begin") + F.col("nth")).alias("place"), "count", "best")
    own = chunks.where("row IS NOT NULL").drop("place", "pairs", "held").withColumnRenamed("chunk", "of")
    return own.groupBy("of").cogroup(told.groupBy("chunk")).applyInArrow(_looked_up, _COUNTED)


def default_tokenizers() -> tuple[str, bytes]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(documents(spark, sf_dir), *default_tokenizers())
