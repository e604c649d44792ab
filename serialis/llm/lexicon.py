"""BPE encoding and decoding by a minimal acyclic transducer of the frequent words.

Words of the whole corpus are counted, and the frequent ones compiled into a minimal automaton: states
with the same continuations are one, so words share endings as well as beginnings. Its edges carry
numbers whose sum along a word is the word's rank in the sorted lexicon, which names its ids. The
compiled arrays are one file, which Spark ships to every executor and all its tasks map into memory.
Words that the automaton refuses are merged exactly, pair by pair. The lexicon decides the speed only:
whatever it holds, the ids are those of the merges.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialis.llm.common import documents, list_array, saved, slices, with_text
from serialis.sources.io import scratch

#: Most words of the lexicon; those that a task sees less often than LEAST times between two reports aren't put forward.
LEXICON, LEAST, _HELD = 100_000, 4, 400_000
#: Words of up to so many bytes are merged side by side, longer ones by a heap.
_SHORT = 64
_NONE = np.iinfo(np.int32).max
#: Text below this code point is in normal form C, and is lower-cased and split here; other texts go through the library.
_SIMPLE = 0x250
_letters, _numbers = ("".join(map(re.escape, filter(lambda c: unicodedata.category(c)[0] == k, map(chr, range(_SIMPLE))))) for k in "LN")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_letters}]+|[{_numbers}]|[^\s{_letters}{_numbers}]+")
_ODD = re.compile("[^\x00-\x1b -ɏ]")
#: Bytes as the letters that stand for them in a byte-level vocabulary: printable ones for themselves, others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = [chr(b) if b in _PRINTABLE else chr(0x100 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)]


class Automaton:
    """Arrays of a compiled lexicon. `keys` has state * 256 + byte of every edge, in order; beside it are
    the edge's target and number. `final` says which states end words; `offsets` and `ids` are the words' outputs."""

    PARTS = ("keys", "target", "number", "final", "offsets", "ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @staticmethod
    def compiled(words: list[bytes], ids: list[np.ndarray]) -> Automaton:
        """The minimal automaton of sorted distinct words: the ending of the last word is frozen, state by
        state from its end, as soon as the next one leaves it."""
        frozen: dict[tuple, int] = {}
        edges: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []

        def freeze(final: bool, out: list[tuple[int, int]]) -> int:
            key = (final, *out)
            if key not in frozen:
                frozen[key] = len(edges)
                edges.append(tuple(out))
                finals.append(final)
            return frozen[key]

        path: list[list] = [[False, []]]  # (ends a word, edges so far) along the last word
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                state = freeze(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        close(0)
        root = freeze(*path[0])
        below = np.zeros(len(edges), np.int64)
        keys, target, number = [], [], []
        for state, out in enumerate(edges):  # targets are frozen before the states that lead to them
            passed = int(finals[state])
            for byte, to in out:
                keys.append(state * 256 + byte), target.append(to), number.append(passed)
                passed += below[to]
            below[state] = passed
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        parts = [np.array(keys, np.int64), np.array(target, np.int32), np.array(number, np.int32), np.array([*finals, root], np.int32), np.cumsum([0, *map(len, ids)]), flat]
        return Automaton(dict(zip(Automaton.PARTS, parts, strict=True)))

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, p)) for p in self.PARTS]
        head = json.dumps([[p, x.dtype.str, len(x)] for p, x in zip(self.PARTS, parts, strict=True)]).encode()
        head += b" " * (-(len(head) + 4) % 8)
        return struct.pack("<I", len(head)) + head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)

    @staticmethod
    def mapped(path: str) -> Automaton:
        """The automaton of a file, mapped into memory."""
        with open(path, "rb") as f:
            size = struct.unpack("<I", f.read(4))[0]
            head, at, parts = json.loads(f.read(size)), 4 + size, {}
        for name, kind, n in head:
            parts[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += -(-n * np.dtype(kind).itemsize // 8) * 8
        return Automaton(parts)

    def ranks(self, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word (its bytes are flat[begin : begin + length]) in the lexicon, -1 if it has none.
        All words take a step at a time."""
        state, rank = np.full(len(begins), self.final[-1], np.int64), np.zeros(len(begins), np.int64)
        going = np.flatnonzero(lengths > 0)
        for k in range(int(lengths.max(initial=0)) if len(self.keys) else 0):
            going = going[lengths[going] > k]
            if not len(going):
                break
            key = state[going] * 256 + flat[begins[going] + k]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            state[going[~there]] = -1
            going, edge = going[there], edge[there]
            state[going], rank[going] = self.target[edge], rank[going] + self.number[edge]
        ends = (state >= 0) & (lengths > 0) & (len(self.keys) > 0)
        ends[ends] = self.final[:-1][state[ends]] > 0
        return np.where(ends, rank, -1)


class Merges:
    """Exact merging: of a word's adjacent pairs the first merge in the model's order goes first, at the
    leftmost place that has it, until no pair has one."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.plain, self.last = (np.array([vocab[c + e] for c in BYTE_LETTERS], np.int32) for e in ("", end))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order.astype(np.int32)
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]

    def found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order of merges, result) of pairs; without a merge the place is _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE), self.to[at]

    def side_by_side(self, flat: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The ids of non-empty words, whose bytes follow each other. All words do a merge at a time."""
        ids: list[np.ndarray] = [None] * len(lengths)
        names, sizes = np.arange(len(lengths)), lengths.astype(np.int64)
        symbols = self.plain[flat]
        symbols[np.cumsum(sizes) - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        place, to = self.found(symbols, np.append(symbols[1:], 0)) if len(symbols) else (symbols, symbols)
        place[np.cumsum(sizes) - 1] = _NONE
        while len(names):
            begins = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(place, begins)
            owner = np.repeat(np.arange(len(names)), sizes)
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    ids[names[k]] = symbols[begins[k] : begins[k] + sizes[k]].copy()
                kept = ~done[owner]
                symbols, place, to, names, sizes, best = symbols[kept], place[kept], to[kept], names[~done], sizes[~done], best[~done]
                owner = np.repeat(np.arange(len(names)), sizes)
            at = np.flatnonzero(place == best[owner])
            if not len(at):
                continue
            at = at[np.diff(owner[at], prepend=-1) != 0]
            symbols[at] = to[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            sizes = sizes - 1
            symbols, place, to, at = symbols[kept], place[kept], to[kept], at - np.arange(len(at))
            changed = np.zeros(len(symbols), bool)
            changed[at], changed[at[at > 0] - 1] = True, True
            ends = np.cumsum(sizes) - 1
            changed[ends], place[ends] = False, _NONE
            again = np.flatnonzero(changed)
            place[again], to[again] = self.found(symbols[again], symbols[again + 1])
        return ids

    def by_heap(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs wait in a heap, symbols are a linked list."""
        raw = np.frombuffer(word, np.uint8)
        symbols = [*self.plain[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        place, to = (x.tolist() for x in self.found(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)))
        waiting = [(p, i, t, symbols[i], symbols[i + 1]) for i, (p, t) in enumerate(zip(place, to, strict=True)) if p != _NONE]
        heapq.heapify(waiting)
        while waiting:
            _, i, t, left, right = heapq.heappop(waiting)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = t, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            near = [(a, b) for a, b in ((before[i], i), (i, after[i])) if a >= 0 and b >= 0]
            place, to = self.found(np.array([symbols[a] for a, _ in near], np.int64), np.array([symbols[b] for _, b in near], np.int64))
            for (a, b), p, t in zip(near, place.tolist(), to.tolist(), strict=True):
                if p != _NONE:
                    heapq.heappush(waiting, (p, a, t, symbols[a], symbols[b]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def __call__(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= _SHORT]
        flat = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        for k, ids in zip(short, self.side_by_side(flat, np.array([len(words[k]) for k in short], np.int64)), strict=True):
            out[k] = ids
        for k, w in enumerate(words):
            if out[k] is None:
                out[k] = self.by_heap(w)
        return out


class Splitter:
    """Texts as units that are encoded one by one: runs without white space as text, words that the library
    has split off as bytes, special tokens as their id."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.special = {t["content"]: t["id"] for t in json.loads(tokenizer)["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.special else None
        self.bytes = {c: b for b, c in enumerate(BYTE_LETTERS)}

    def __call__(self, text: str) -> list[str | bytes | int]:
        if any(s in text for s in self.special):
            return [u for part in self.cut.split(text) for u in ([self.special[part]] if part in self.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str | bytes]:
        if not _ODD.search(text):
            return text.lower().split()
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, piece)) for piece, _ in pieces]


def words_of(unit: str | bytes) -> list[bytes]:
    return [w.encode() for w in _WORDS.findall(unit)] if isinstance(unit, str) else [unit]


def gathered(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat one after the other."""
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return flat[steps + np.repeat(begins - (ends - lengths), lengths)]


class _Units(dict):
    """Numbers of units, given as they are met."""

    def __missing__(self, unit: str | bytes | int) -> int:
        number = self[unit] = len(self)
        return number


class Encoder:
    """A byte-level BPE model with word ends, its lexicon in front. Ids of texts come from a table of the
    units met so far, which begins anew when it holds more than _HELD."""

    def __init__(self, tokenizer: str, automaton: Automaton):
        self.split, self.automaton = Splitter(tokenizer), automaton
        self.merges = Merges(json.loads(tokenizer)["model"])
        self._forget()

    def _forget(self) -> None:
        self.units, self.ids, self.begins, self.sizes = _Units(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, begin, length) for distinct words."""
        flat, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        ranks = self.automaton.ranks(flat, np.cumsum(lengths) - lengths, lengths)
        known, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        merged = self.merges([words[k] for k in unseen])
        begins, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[known] = self.automaton.offsets[ranks[known] + 1] - self.automaton.offsets[ranks[known]]
        sizes[unseen] = [len(x) for x in merged]
        seen = gathered(self.automaton.ids, self.automaton.offsets[ranks[known]], sizes[known])
        begins[known] = np.cumsum(sizes[known]) - sizes[known]
        begins[unseen] = len(seen) + np.cumsum(sizes[unseen]) - sizes[unseen]
        return np.concatenate([seen, *merged]).astype(np.int32), begins, sizes

    def _learn(self, units: list[str | bytes | int]) -> None:
        """Add new units to the table."""
        words = _Units()
        parts = [[] if isinstance(u, int) else [words[w] for w in words_of(u)] for u in units]
        ids, begins, sizes = self.words(list(words))
        for k, u in enumerate(units):
            if isinstance(u, int):
                parts[k] = [len(begins)]
                ids, begins, sizes = np.append(ids, np.int32(u)), np.append(begins, len(ids)), np.append(sizes, 1)
        of_unit = np.array([w for p in parts for w in p], np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes[of_unit])])
        per_unit = np.diff(upto[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)])
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(per_unit) - per_unit])
        self.ids = np.concatenate([self.ids, gathered(ids, begins[of_unit], sizes[of_unit])])
        self.sizes = np.concatenate([self.sizes, per_unit])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has)."""
        if len(self.units) > _HELD:
            self._forget()
        met, number = len(self.units), self.units.__getitem__
        rows = [np.fromiter(map(number, units), np.int64, len(units)) for units in map(self.split, texts)]
        self._learn(list(islice(self.units, met, None)))
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        sizes = self.sizes[flat]
        upto, ends = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return gathered(self.ids, self.begins[flat], sizes), np.diff(upto[ends])


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def frequent_words(df: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON) -> list[bytes]:
    """Frequent words of all texts, sorted; at most so many. Each task counts its words and puts forward those
    that it sees LEAST times; of the sums a histogram by size gives the least count that leaves few enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = Splitter(tokenizer), Counter()

        def report() -> pa.RecordBatch:
            words: Counter[bytes] = Counter()
            for unit, n in total.items():
                if n >= LEAST and not isinstance(unit, int):
                    for w in words_of(unit):
                        words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in _strings(batch.column(0)):
                total.update(split(text))
            if len(total) > _HELD:
                yield report()
                total.clear()
        yield report()

    counted = saved(df.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(8 * F.log2("n"))
    least, left = 1 << 30, most
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    return sorted(bytes(r["word"]) for r in counted.where(level >= least).select("word").collect())


def compiled(spark: SparkSession, words: Iterable[bytes], tokenizer: str) -> str:
    """Compile a lexicon to a file in the shared folder and have Spark ship it to every executor; its name there."""
    words = sorted({w for w in words if w})
    ids = Merges(json.loads(tokenizer)["model"])(words)
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark)).getParent().suffix(f"/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(Automaton.compiled(words, ids).dump()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _opened(name: str) -> Automaton:
    return Automaton.mapped(SparkFiles.get(name))


def encode(df: DataFrame, tokenizer: str, lexicon: str, text_col: str = "text") -> DataFrame:
    """df with `ids`, as the library gives them without special tokens added; strings of special tokens in a
    text are special. `tokenizer` is the JSON of a byte-level BPE model with word ends, `lexicon` a name that
    `compiled` gave. Null or empty texts have no ids. A column `ids` gives way, others pass through,
    repeated rows and nulls included. An empty table gives no rows."""
    sent, name, kinds = with_text(df, text_col, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, _opened(lexicon))
        for batch in slices(batches):
            ids, sizes = encoder(_strings(batch.column(name)))
            kept = [n for n in batch.schema.names if n != "__text"]
            rows = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), list_array(rows, pa.int32())], [*kept, "ids"])

    return sent.mapInArrow(run, f"{kinds}ids array<int>")


def token_names(tokenizer: str) -> np.ndarray:
    """Every id's token, behind a space."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(tokenizer).get_vocab(with_added_tokens=True)
    names = np.array([""] * (max(vocab.values()) + 1), object)
    for token, k in vocab.items():
        names[k] = sys.intern(f" {token}")
    return names


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """df with `decoded`: the tokens of `ids` with a space between, as the library joins them for a model without
    a decoder, special tokens kept. Null ids: empty."""
    kept = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(tokenizer)
        for batch in slices(batches):
            texts = ["" if x.as_py() is None else "".join(names[np.array(x.as_py(), np.int64)])[1:] for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema) + "decoded string")


def default_tokenizer() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op12_word_bpe(spark, sf_dir: str) -> DataFrame:
    """Encoding, decoding and the digests follow each other within a task, so that ids don't cross to the JVM and back."""
    docs, tokenizer = documents(spark, sf_dir).select("doc_id", "text"), default_tokenizer()
    lexicon = compiled(spark, frequent_words(docs, tokenizer), tokenizer)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder(tokenizer, _opened(lexicon)), token_names(tokenizer)
        for batch in slices(batches):
            ids, sizes = encoder(_strings(batch.column("text")))
            ends = np.cumsum(sizes)
            rows = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            id_sums = [sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]
            text_sums = [sha256("".join(names[x].tolist())[1:].encode()).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
