"""A hidden Markov language model over words, trained by Baum-Welch across partitions.

Every word belongs to one of CLASSES classes, found from the word alone. A hidden state emits a
class, and the class its word by corpus counts: P(word | state) = P(class | state) * P(word) /
P(class), with P(word) the smoothed share of the word among all training tokens. So what a state
learns is of bounded size, while the word counts cover, and grow with, the whole corpus. Words that
training never saw are one symbol with the same small share in every state.

The texts are read once, into chunks: the tokens as numbers of a chunk-local word list, which lies
in the order of the words' classes. Ranges of classes of all lists are brought together, where
every word gets its count in the whole corpus, and the counts return by chunk. Baum-Welch runs over
the chunks, forward and backward by task, with the expected counts summed over the tasks; every
round covers every training document. The first HELD_ROUNDS hold the state fixed within a document
(the moves are the identity, under which the forward and backward pass are one product of a
document's emissions), the further FREE_ROUNDS learn moves, too.
"""

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialis.llm.common import documents, fold, saved, summed

STATES = 8
CLASSES = 1 << 15
#: Rounds, each over all training documents: with the state held in a document, and with free moves.
HELD_ROUNDS, FREE_ROUNDS = 4, 4
#: Weight of the corpus share of a class when a state's share is estimated.
PRIOR = 20.0
ADD = 0.1
#: Tokens of a chunk, steps' tokens that a task works on at a time, words of a range of classes.
_CHUNK_TOKENS, _BLOCK_TOKENS, _RANGE_WORDS = 1_500_000, 500_000, 500_000
_UNSEEN = CLASSES


def word_class(word: bytes) -> int:
    """Short words have a class of their own (but for hash collisions), longer ones share it with those
    of equal beginning and end. The end token is the empty word."""
    return crc32(word if len(word) <= 5 else word[:2] + b"~" + word[-3:]) % CLASSES


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """Each text's words, A-Z in lower case, and the end token, the empty word. Null is empty."""
    clean = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(clean, ""), clean, pc.binary_join_element_wise(clean, "", " ")))


_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, n_words long, words binary, lengths binary, classes binary, counts binary"


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, held_out, text) in chunks of about _CHUNK_TOKENS: all token numbers in a row, and
    the chunk's word list, in the order of the classes, with training counts."""
    number = TaskContext.get().partitionId() << 32
    doc_ids, held, sizes, tokens = [], [], [], []

    def chunk() -> pa.RecordBatch:
        out, size = np.concatenate(held), np.concatenate(sizes)
        coded = pa.concat_arrays(tokens).dictionary_encode()
        ids, words = coded.indices.to_numpy(), coded.dictionary
        classes = np.fromiter(map(word_class, words.cast(pa.binary()).to_pylist()), np.int64, len(words))
        order = np.argsort(classes, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        ids, words = place[ids], words.take(pa.array(order))
        counts = np.bincount(ids[np.repeat(~out, size)], minlength=len(words))
        lengths = pc.binary_length(words).to_numpy()
        columns = (
            pa.array([number]), pa.array([np.concatenate(doc_ids).tolist()], pa.list_(pa.int64())), pa.array([out.tolist()], pa.list_(pa.bool_())), pa.array([size.tolist()], pa.list_(pa.int32())),
            pa.array([pack(ids)]), pa.array([len(words)]), pa.array([zstandard.compress(b"".join(words.cast(pa.binary()).to_pylist()), 1)]), pa.array([pack(lengths)]), pa.array([pack(classes[order])]), pa.array([pack(counts)]),
        )
        return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in _CHUNK.split(", ")])

    size = 0
    for whole in batches:
        for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
            found = tokens_of(batch.column(2))
            doc_ids.append(np.array(batch.column(0).to_pylist(), object))
            held.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            sizes.append(pc.list_value_length(found).to_numpy())
            tokens.append(found.flatten())
            size += len(tokens[-1])
            if size >= _CHUNK_TOKENS:
                yield chunk()
                number, size = number + 1, 0
                doc_ids, held, sizes, tokens = [], [], [], []
    if size:
        yield chunk()


_POST = "range int, chunk long, words binary, lengths binary, classes binary, counts binary"


def _poster(ranges: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word list (chunk, words, lengths, classes, counts) of each chunk, cut at the class ranges."""
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, words, *rest = (batch.column(c)[k].as_py() for c in range(5))
                lengths, classes, counts = map(unpack, rest)
                words, ends = zstandard.decompress(words), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                cuts = np.searchsorted(classes, np.arange(ranges + 1) * CLASSES // ranges)
                rows = [(r, chunk, words[ends[i] : ends[j]], lengths[i:j].tobytes(), classes[i:j].tobytes(), counts[i:j].tobytes()) for r, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 4))], [c.split()[0] for c in _POST.split(", ")])

    return post


def _count(posts: pa.Table) -> pa.Table:
    """Of one class range of all chunks: each chunk's words' counts in the whole corpus, low and high
    half; and, in a row without chunk, the classes' tokens and distinct words in training."""
    posts = posts.combine_chunks()
    chunks = posts["chunk"].to_pylist()
    texts, (lengths, classes, counts) = posts["words"].to_pylist(), ([np.frombuffer(x, "<u4") for x in posts[c].to_pylist()] for c in ("lengths", "classes", "counts"))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    words = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))]).dictionary_encode().indices.to_numpy()
    total = np.bincount(words, np.concatenate(counts).astype(np.float64)).astype(np.int64)
    of_class = np.zeros(len(total), np.int64)
    of_class[words] = np.concatenate(classes)
    known = total > 0
    seen = np.unique(of_class[known])
    sums = np.bincount(of_class[known], total[known]).astype(np.int64), np.bincount(of_class[known])
    cuts = np.cumsum([len(x) for x in lengths])[:-1]
    found = [(c, pack(x & 0xFFFFFFFF), pack(x >> 32)) for c, x in zip(chunks, np.split(total[words], cuts), strict=True)]
    n = len(found)
    none = [None] * n
    return pa.table({
        "chunk": pa.array([*(f[0] for f in found), None], pa.int64()), "range": pa.array([posts["range"][0].as_py()] * (n + 1), pa.int32()), "low": pa.array([*(f[1] for f in found), None], pa.binary()), "high": pa.array([*(f[2] for f in found), None], pa.binary()),
        "classes": pa.array([*none, seen.tolist()], pa.list_(pa.int32())), "tokens": pa.array([*none, sums[0][seen].tolist()], pa.list_(pa.int64())), "words": pa.array([*none, sums[1][seen].tolist()], pa.list_(pa.int64())),
    })


def by_step(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by falling length as (active, begins, symbols): the symbols step by step, those of step t
    from begins[t] on for the first active[t] rows."""
    lengths = np.array([len(r) for r in rows])
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    begins = np.concatenate([[0], np.cumsum(active)])
    steps = np.arange(begins[-1]) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    symbols = np.empty(begins[-1], np.int64)
    symbols[begins[steps] + np.repeat(np.arange(len(rows)), lengths)] = np.concatenate(rows)
    return active, begins, symbols


def blocks(rows: list[np.ndarray]) -> list[tuple[int, int]]:
    """Ranges of steps of about 2 * _BLOCK_TOKENS tokens, so that work on long rows is of bounded size."""
    lengths = np.array([len(r) for r in rows])
    total = np.concatenate([[0], np.cumsum(np.searchsorted(-lengths, -np.arange(lengths[0]), side="left"))])
    cuts = [0]
    while cuts[-1] < lengths[0]:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, total[cuts[-1]] + 2 * _BLOCK_TOKENS, side="right")) - 1))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _cut(rows: list[np.ndarray], begin: int, end: int) -> list[np.ndarray]:
    return [r[begin:end] for r in rows if len(r) > begin]


def _forward(active, begins, ahead, start, back, enter):
    """Scaled forward shares (a row per state, in the order of `ahead`, the emissions) and the scales."""
    shares, scales = np.empty_like(ahead), np.empty(ahead.shape[1], ahead.dtype)
    spans = [slice(i, j) for i, j in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    for t, now in enumerate(spans):
        joint = shares[:, now]
        if t or enter is not None:
            before = shares[:, spans[t - 1]] if t else enter
            np.matmul(back, before[:, : joint.shape[1]], out=joint)
            joint *= ahead[:, now]
        else:
            np.multiply(ahead[:, now], start[:, None], out=joint)
        joint /= np.add.reduce(joint, 0, out=scales[now])
    return shares, scales, spans


def forward(rows: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each row (rows by falling length), scaled at every token. emit has a
    row per symbol and a column per state."""
    out, enter = np.zeros(len(rows)), None
    emissions, back = np.ascontiguousarray(emit.T), np.ascontiguousarray(move.T)
    for span in blocks(rows):
        active, begins, symbols = by_step(_cut(rows, *span))
        shares, scales, _ = _forward(active, begins, np.take(emissions, symbols, axis=1), start, back, enter)
        out[: active[0]] += np.bincount(np.arange(len(symbols)) - np.repeat(begins[:-1], active), np.log(scales), active[0])
        enter = shares[:, begins[-2] :].copy()
    return out


def expected(rows: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of rows by falling length: of first states, moves and emissions. A factor of
    a symbol's row in emit makes no difference. Tokens lie step by step, with a row per state, so that
    all work of a step runs along its tokens; the work is done in emit's type. Of rows in several
    blocks of steps, the forward shares at the blocks' ends are kept and the rest is found anew."""
    emissions, start = np.ascontiguousarray(emit.T), start.astype(emit.dtype)
    move, back = np.ascontiguousarray(move, emit.dtype), np.ascontiguousarray(move.T, emit.dtype)
    spans, enters = blocks(rows), [None]
    for span in spans[:-1]:
        active, begins, symbols = by_step(_cut(rows, *span))
        enters.append(_forward(active, begins, np.take(emissions, symbols, axis=1), start, back, enters[-1])[0][:, begins[-2] :].copy())
    first, moves, at = np.zeros(len(move)), np.zeros(move.shape), np.zeros(emit.shape)
    later = None
    for span, enter in zip(reversed(spans), reversed(enters), strict=True):
        active, begins, symbols = by_step(_cut(rows, *span))
        ahead = np.take(emissions, symbols, axis=1)
        shares, scales, steps = _forward(active, begins, ahead, start, back, enter)
        ahead /= scales
        rest = np.ones_like(ahead)
        if later is not None:
            # The rows that go on after this block.
            n, last = later.shape[1], steps[-1].start
            moves += shares[:, last : last + n] @ later.T
            np.matmul(move, later, out=rest[:, last : last + n])
        for t in range(len(steps) - 1, 0, -1):
            now, before = ahead[:, steps[t]], steps[t - 1].start
            now *= rest[:, steps[t]]
            np.matmul(move, now, out=rest[:, before : before + now.shape[1]])
        later = ahead[:, steps[0]] * rest[:, steps[0]]
        if len(steps) > 1:
            before = np.arange(begins[1], begins[-1]) - np.repeat(active[:-1], active[1:])
            moves += np.take(shares, before, axis=1) @ ahead[:, begins[1] :].T
        shares *= rest
        shares /= shares.sum(0)
        if enter is None:
            first += shares[:, steps[0]].sum(1, dtype=np.float64)
        at += np.stack([np.bincount(symbols, of, len(emit)) for of in shares], axis=1)
    return first, moves * move, at


def expected_held(rows: list[np.ndarray], start: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch counts of first states and emissions where a row never leaves its state."""
    lengths = np.array([len(r) for r in rows])
    symbols, begins = np.concatenate(rows), np.cumsum(lengths) - lengths
    logs = np.ascontiguousarray(np.log(emit).T)
    joint = np.log(start)[:, None] + np.stack([np.add.reduceat(of[symbols], begins, dtype=np.float64) for of in logs])
    shares = np.exp(joint - joint.max(0))
    shares /= shares.sum(0)
    return shares.sum(1), np.stack([np.bincount(symbols, np.repeat(of, lengths), len(emit)) for of in shares], axis=1)


class Model:
    """Shares of first states, moves and classes; `prior` is each class's share of the corpus."""

    def __init__(self, prior: np.ndarray, unseen: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.prior, self.unseen = prior, unseen
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        self.set_emissions(prior[:, None] * rng.gamma(2.0, 1.0, (CLASSES, STATES)) * 1e4)

    def set_emissions(self, counts: np.ndarray) -> None:
        share = (counts + PRIOR * self.prior[:, None]) / (counts.sum(0) + PRIOR)
        self.emit = np.vstack([share * (1 - self.unseen), np.full((1, STATES), self.unseen)])

    def update(self, counts: np.ndarray, moved: bool) -> None:
        start, moves, emissions = np.split(counts, [STATES, STATES + STATES**2])
        self.start = (start + 0.1) / (start + 0.1).sum()
        if moved:
            moves = moves.reshape(STATES, STATES) + 0.1
            self.move = moves / moves.sum(1)[:, None]
        self.set_emissions(emissions.reshape(CLASSES + 1, STATES)[:CLASSES])


def _rows(sizes: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
    return np.split(symbols, np.cumsum(sizes)[:-1])


def batches_of(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Row numbers by falling length, in batches of about _BLOCK_TOKENS tokens."""
    batch, size = [], 0
    for k in sorted(range(len(rows)), key=lambda k: -len(rows[k])):
        batch.append(k)
        size += len(rows[k])
        if size >= _BLOCK_TOKENS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _counter(model: Model, held: bool):
    start, move = model.start, model.move
    emit = (model.emit / np.maximum(model.emit.max(1), 1e-300)[:, None]).astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Of chunks (held, sizes, ids, classes): the expected counts of the training documents."""
        for batch in batches:
            for k in range(batch.num_rows):
                out, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (0, 1))
                symbols = unpack(batch.column(3)[k].as_py()).astype(np.uint16)[unpack(batch.column(2)[k].as_py())]
                rows = [r for r, o in zip(_rows(sizes, symbols), out, strict=True) if not o]
                if not rows:
                    continue
                if held:
                    first, at = expected_held(rows, start, emit)
                    yield np.concatenate([first, np.zeros(STATES**2), at.ravel()])
                    continue
                for some in batches_of(rows):
                    first, moves, at = expected([rows[k] for k in some], start, move, emit)
                    yield np.concatenate([first, moves.ravel(), at.ravel()])

    return count


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(model: Model, class_share: np.ndarray, total: int, distinct: int):
    start, move, emit = model.start, model.move, model.emit
    bottom = total + ADD * (distinct + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk (chunk, doc_ids, held, sizes, ids, classes) with its words' counts (chunk, range, low, high)."""
        ranges = right.sort_by("range")
        counts = np.concatenate([unpack(lo).astype(np.int64) + (unpack(hi).astype(np.int64) << 32) for lo, hi in zip(ranges["low"].to_pylist(), ranges["high"].to_pylist(), strict=True)])
        chunk = {c: left[c][0] for c in ("doc_ids", "held", "sizes", "ids", "classes")}
        classes, ids = unpack(chunk["classes"].as_py()), unpack(chunk["ids"].as_py())
        base = np.log10((counts + ADD) / bottom)
        symbol = np.where(counts > 0, classes, _UNSEEN)
        # P(word) / P(class); for unseen words the symbol's share is their probability.
        inside = np.where(counts > 0, base - np.log10(class_share[classes] * (1 - ADD / bottom)), 0.0)
        sizes = chunk["sizes"].values.to_numpy()
        begins = np.cumsum(sizes) - sizes
        rows = _rows(sizes, symbol[ids])
        found = np.zeros(len(rows))
        for some in batches_of(rows):
            found[some] = forward([rows[k] for k in some], start, move, emit) / np.log(10)
        return pa.table({
            "doc_id": chunk["doc_ids"].values, "held_out": chunk["held"].values, "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(np.add.reduceat((counts > 0)[ids], begins, dtype=np.int64)),
            "train_tokens": pa.array(np.full(len(sizes), total)), "base_score": pa.array(np.add.reduceat(base[ids], begins)), "score": pa.array(np.add.reduceat(inside[ids], begins) + found),
        })

    return score


def language_model_scores(df: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from the rows that `held_out` (a Column; by default a tenth, by the id) leaves.
    score is the model's log10 probability of the text and its end token, base_score that of a
    smoothed unigram model. Null or empty texts are the end token alone. Null and repeated ids are
    kept as they are. Without training rows every word is unseen. An empty table gives no rows.
    Other columns are ignored. Texts of any length: the work on a document goes by blocks of its
    tokens, of which only the token numbers are held whole.
    """
    spark = df.sparkSession
    out = fold(id_col, 10) == 0 if held_out is None else held_out
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    chunks = saved(texts.mapInArrow(_chunker, _CHUNK))
    listed = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = min(CLASSES, 1 + listed // _RANGE_WORDS)
    posts = chunks.select("chunk", "words", "lengths", "classes", "counts").mapInArrow(_poster(ranges), _POST)
    known = saved(posts.groupBy("range").applyInArrow(_count, "chunk long, range int, low binary, high binary, classes array<int>, tokens array<long>, words array<long>"))
    by_class = known.where("chunk is null").select(F.explode(F.arrays_zip("classes", "tokens", "words")).alias("c")).select("c.*").toPandas()
    total, distinct = int(by_class["tokens"].sum()), int(by_class["words"].sum())
    share = np.full(CLASSES, 1e-300)
    share[by_class["classes"].astype(int)] = (by_class["tokens"] + ADD * by_class["words"]) / (total + ADD * distinct)
    model = Model(share, ADD / (total + ADD * (distinct + 1)))

    # The tasks of a round each give one sum, so that there are few of them for the cores.
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    training = chunks.select("held", "sizes", "ids", "classes").coalesce(tasks)
    for held in [True] * HELD_ROUNDS + [False] * FREE_ROUNDS:
        model.update(summed(training, _counter(model, held), STATES + STATES**2 + (CLASSES + 1) * STATES), not held)

    counted = known.where("chunk is not null").select("chunk", "range", "low", "high")
    score = _scorer(model, share, total, distinct)
    return chunks.select("chunk", "doc_ids", "held", "sizes", "ids", "classes").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(score, _SCORES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir))
