"""SentencePiece encoding with byte offsets into the source text, and decoding.

The text is normalised here by longest-prefix matches in the model's compiled character map,
which records for every byte of the normalised text the source bytes it came from. The library
cuts the text into pieces; the pieces' lengths give each one's place in the normalised text, and
the record projects it to a span of source bytes. Spans of a text follow each other in order; a
piece of white space that the normaliser put in front has an empty span.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from serialis.llm.common import documents, list_array, with_text

_SPACE = "▁".encode()


class CharMap:
    """The compiled map: a double-array trie of sources, whose values are offsets of zero-ended
    replacements behind it."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist(), blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(width, replacement) of the longest source that the text has at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = self._child(0)
        for k in range(at, len(text)):
            node ^= text[k]
            if not text[k] or node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            has_value = units[node] >> 8 & 1
            node = self._child(node)
            if has_value:
                begin = units[node] & 0x7FFFFFFF
                found = k + 1 - at, begin
        return found and (found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])])

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class Normaliser:
    """The model's normalisation, with source spans. Without a map, and without trimming, it runs in
    whole-text array operations; else character by character, trying the longest source first."""

    def __init__(self, spec: sentencepiece_model_pb2.NormalizerSpec, suffix: bool):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.trims, self.escapes = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = _SPACE if self.escapes else b" "
        self.before, self.after = spec.add_dummy_prefix and not suffix, spec.add_dummy_prefix and suffix

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised text, begin, end): the source span of each of its bytes."""
        if not self.map and not self.trims:
            raw = np.frombuffer(text, np.uint8)
            lengths = np.where(raw == 0x20, len(self.space), 1)
            begin = np.repeat(np.arange(len(raw)), lengths)
            out, end = text.replace(b" ", self.space), begin + 1
        else:
            out, begin, end = self._by_prefix(text)
        n = len(self.space)
        if out and self.before:
            out, begin, end = self.space + out, np.concatenate([np.zeros(n, int), begin]), np.concatenate([np.zeros(n, int), end])
        if out and self.after:
            out, begin, end = out + self.space, np.concatenate([begin, np.full(n, len(text))]), np.concatenate([end, np.full(n, len(text))])
        return out, begin, end

    def _by_prefix(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        cuts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(text):
            if found := self.map and self.map.longest(text, at):
                width, to = found
            else:
                width = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
                to = text[at : at + width]
            # The library never keeps a replacement's leading space behind another space.
            if self.trims:
                while to.startswith(b" ") and (not cuts or cuts[-1][0].endswith(b" ")):
                    to = to[1:]
            if to:
                cuts.append((to, at, at + width))
            at += width
        while self.trims and cuts and cuts[-1][0].endswith(b" "):
            to, b, e = cuts.pop()
            if to := to.rstrip(b" "):
                cuts.append((to, b, e))
        pieces = [(to.replace(b" ", self.space), b, e) for to, b, e in cuts]
        lengths = [len(p[0]) for p in pieces]
        return b"".join(p[0] for p in pieces), np.repeat([p[1] for p in pieces], lengths).astype(int), np.repeat([p[2] for p in pieces], lengths).astype(int)


class Encoder:
    """A model with what its pieces' spans need. Where the normaliser has no map and only turns spaces
    into the space sign, each piece has a fixed number of source bytes, and spans are their running
    sums; texts that hold the sign itself, or unknown pieces, are projected byte by byte."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        texts = [p.piece.encode() for p in proto.pieces]
        self.lengths = np.array([1 if p.type == kind.BYTE else len(t) for p, t in zip(proto.pieces, texts, strict=True)])
        self.unknown = self.library.unk_id()
        escaped = (len(self.normalise.space) - 1) * np.array([t.count(_SPACE) if self.normalise.escapes else 0 for t in texts])
        self.source_lengths = (self.lengths - escaped).astype(np.int32)
        plain = not self.normalise.map and not self.normalise.trims and not self.normalise.after
        self.fixed = plain and (not self.normalise.escapes or _SPACE in texts)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends in bytes of the UTF-8 text, a pair for each id."""
        if not len(ids):
            return ids, ids
        raw = text.encode()
        if self.fixed and _SPACE not in raw and not (ids == self.unknown).any():
            ends = np.cumsum(self.source_lengths[ids], dtype=np.int32)
            ends -= np.int32(self.normalise.before)
            begins = np.concatenate([ends[:1] * 0, ends[:-1]])
            self._check(ends[-1], len(raw))
            return begins, ends
        return self.projected(text, raw, ids)

    def projected(self, text: str, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        normal, begin, end = self.normalise(raw)
        lengths = self.lengths[ids]
        if (ids == self.unknown).any():
            lengths = np.array([len(p.surface.replace(" ", self.normalise.space.decode()).encode()) if p.id == self.unknown else self.lengths[p.id] for p in self.library.encode(text, out_type="immutable_proto").pieces])
        stops = np.cumsum(lengths)
        self._check(stops[-1], len(normal))
        return begin[stops - lengths], end[stops - 1]

    @staticmethod
    def _check(covered: int, size: int) -> None:
        if covered != size:
            raise ValueError(f"pieces of {covered} bytes for a text of {size}")


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of numbers of a column; null is empty."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _encoder(model: bytes, text_col: str = "__text"):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                texts = _strings(batch.column(text_col))
                ids = [np.array(x, np.int32) for x in encoder.library.encode(texts, num_threads=1)]
                spans = [encoder.spans(t, x) for t, x in zip(texts, ids, strict=True)]
                kept = [n for n in batch.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in kept), list_array(ids, pa.int32()), list_array([s[0] for s in spans], pa.int32()), list_array([s[1] for s in spans], pa.int32())], [*kept, "ids", "begins", "ends"]
                )

    return encode


def _decoder(model: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for whole in batches:
            for batch in (whole.slice(k, 200) for k in range(0, whole.num_rows, 200)):
                texts = [library.decode(x.tolist()) for x in _lists(batch.column("ids"))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return decode


def _kinds(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """df with `ids`, `begins` and `ends`: each piece's id and span of UTF-8 bytes of the source.

    `model` is the bytes of a SentencePiece model; no begin or end ids are added. Null or empty
    texts have no pieces. Columns of df that have one of these names give way; others pass through,
    repeated rows and nulls included. An empty table gives no rows.
    """
    sent, name, kinds = with_text(df, text_col, "ids", "begins", "ends")
    return sent.mapInArrow(_encoder(model, name), f"{kinds}ids array<int>, begins array<int>, ends array<int>")


def decode(df: DataFrame, model: bytes) -> DataFrame:
    """df with `decoded`, the text of `ids`; null ids: empty."""
    kept = df.drop("decoded")
    return kept.mapInArrow(_decoder(model), _kinds(kept) + ", decoded string")


def encoded_documents(df: DataFrame, model: bytes | None = None) -> DataFrame:
    """The documents with their ids and spans."""
    return encode(df, model or default_model())


def _digester(size: int):
    names = np.array([f",{k}" for k in range(size)], object)
    sha = lambda texts: pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, ids, begins, ends, decoded) as the contract's digests."""
        for batch in batches:
            ids, begins, ends = (_lists(batch.column(n)) for n in ("ids", "begins", "ends"))
            covered = [int(e[-1] - b[0]) if len(b) else 0 for b, e in zip(begins, ends, strict=True)]
            columns = [batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), sha("".join(names[x])[1:] for x in ids), sha(batch.column("decoded").to_pylist()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    return digest


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encoding, decoding and the digests follow each other on the same batches within a task, so that
    ids and spans don't cross to the JVM and back between them."""
    texts = documents(spark, sf_dir).select("doc_id", F.col("text").alias("__text"))
    model = default_model()
    encode, decode, digest = _encoder(model), _decoder(model), _digester(sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size())
    return texts.mapInArrow(lambda batches: digest(decode(encode(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
