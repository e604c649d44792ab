"""Audio features of media columns: resampling, log-mel frames and energy segments.

A clip is a mono WAV file of unsigned 8-bit samples, kept whole in a binary column. Reading one
parses its chunks again. Samples are resampled by a polyphase filter (each output phase is a dot
product with its own part of a low-pass kernel), cut into overlapping windows, and reduced to
log-mel energies. Frames are stored as Arrow fixed-shape tensors of FRAMES x MELS half floats, the
last one padded, each with its time span: a binary column holds each clip's as an Arrow stream of
one batch (begin, end, mel), which any Arrow reader opens without further knowledge. Loud segments begin where a frame's energy passes a high threshold and end where it falls
below a lower one.
"""

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import documents, utf8

RATE, UP, DOWN = 16_000, 1, 2
#: Window and step in samples of the resampled rate, transform length, bands, frames in a tensor.
WINDOW, STEP, LENGTH, MELS, FRAMES = 200, 80, 256, 40, 32
#: A segment begins above ON and ends below OFF, in decibels over the clip's median frame.
ON, OFF = 2.0, 0.5
BLOCK = 64

#: Kernels and banks that a process has made. A plain table travels with the functions that use it, which a
#: function wrapped by functools.cache does not: executors would look for this package.
_made: dict[tuple, np.ndarray] = {}


def once(make: Callable[..., np.ndarray], *args: int) -> np.ndarray:
    """make(*args), made once in a process."""
    key = (make.__name__, *args)
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + bytes(n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples as stored, rate) of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def kernel(up: int, down: int, half: int = 12) -> np.ndarray:
    """A windowed-sinc low-pass at the lower of the two rates; row p holds the taps of output phase p."""
    reach = _reach(up, down, half) * up
    x = np.arange(-reach, reach + 1)
    h = np.sinc(x / max(up, down)) * np.hamming(len(x))
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return (h / h.sum() * up).reshape(-1, up).T[:, ::-1].astype(np.float32)


def _reach(up: int, down: int, half: int = 12) -> int:
    """Inputs that the kernel reaches to either side."""
    return -(-half * max(up, down) // up)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate: sample n is phase n * down % up of the kernel over the inputs
    around n * down / up; beyond the ends lies silence."""
    h = once(kernel, up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    full = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(full, taps)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        # Outputs first, first + up, ... share a phase and move `down` inputs on each time.
        phase, start = first * down % up, first * down // up
        rows = windows[start + _reach(up, down) + 1 :: down][: len(range(first, n, up))]
        out[first::up] = rows @ h[phase]
    return out


def mel_bank(rate: int) -> np.ndarray:
    """Triangular filters evenly spaced in mels, a column per band."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    hertz = np.arange(LENGTH // 2 + 1) * rate / LENGTH
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    up, down = (hertz[:, None] - low) / (mid - low), (high - hertz[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mels(x: np.ndarray, rate: int) -> np.ndarray:
    """Log energies of MELS bands, a row for every overlapping window; a short clip is one window.
    Long clips are transformed some windows at a time."""
    x = np.concatenate([x, np.zeros(max(0, WINDOW - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STEP]
    taper, bank = np.hanning(WINDOW).astype(np.float32), once(mel_bank, rate)
    out = np.empty((len(frames), MELS), np.float32)
    for k in range(0, len(frames), 2048):
        power = np.abs(np.fft.rfft(frames[k : k + 2048] * taper, LENGTH)).astype(np.float32) ** 2
        out[k : k + 2048] = np.log(power @ bank + np.float32(1e-6))
    return out


def segments(energy: np.ndarray, on: float = ON, off: float = OFF) -> list[tuple[int, int]]:
    """[first, last + 1) frames of each loud stretch, with hysteresis: from a frame above `on` until one
    below `off`, both relative to the median."""
    level = energy - np.median(energy)
    marks = np.where(level > on, 1, np.where(level < off, -1, 0))
    change = np.flatnonzero(marks)
    state = np.zeros(len(marks), bool)
    if len(change):
        # Every frame takes the last mark at or before it; before the first mark it is quiet.
        last = np.searchsorted(change, np.arange(len(marks)), side="right") - 1
        state = (last >= 0) & (marks[change[np.maximum(last, 0)]] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_TENSORS = pa.schema([("begin", pa.float64()), ("end", pa.float64()), ("mel", pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS)))])


def tensor_spans(count: int, rate: int = RATE * UP // DOWN) -> list[tuple[float, float]]:
    """The time span in seconds of each tensor of a clip."""
    return [(k * FRAMES * STEP / rate, (((k + 1) * FRAMES - 1) * STEP + WINDOW) / rate) for k in range(count)]


def to_tensors(mels: np.ndarray, rate: int) -> bytes:
    """Frames as an Arrow stream of tensors with their spans."""
    count = -(-len(mels) // FRAMES)
    filled = np.zeros((count * FRAMES, MELS), np.float16)
    filled[: len(mels)] = mels
    begin, end = np.array(tensor_spans(count, rate)).T
    mel = pa.ExtensionArray.from_storage(_TENSORS.field("mel").type, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), FRAMES * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(begin), pa.array(end), mel], schema=_TENSORS))
    return sink.getvalue().to_pybytes()


def tensors(stream: bytes) -> pa.RecordBatch:
    """A stored clip's tensors: (begin, end, mel), mel being an Arrow fixed-shape tensor array."""
    return pa.ipc.open_stream(stream).read_next_batch()


def features(media: bytes) -> tuple[bytes, bytes, list[tuple[float, float]], list[tuple[float, float]]]:
    """(samples, tensors, their spans, loud segments in seconds) of a stored clip."""
    samples, rate = from_wav(media)
    rate = rate * UP // DOWN
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    mels = log_mels(x, rate)
    energy = 10 / np.log(10) * np.log(np.exp(mels).sum(1))
    loud = [(a * STEP / rate, ((b - 1) * STEP + WINDOW) / rate) for a, b in segments(energy)]
    return samples, to_tensors(mels, rate), tensor_spans(-(-len(mels) // FRAMES), rate), loud


_SPAN = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))


#: Rows that a task turns at a time, so that it holds few clips and their frames.
_ROWS = 200


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, _ROWS) for k in range(0, whole.num_rows, _ROWS)):
            texts = utf8(batch.column("__text"))
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(map(len, texts), pa.int64()), pa.array([to_wav(padded(t)) for t in texts], pa.binary())], [*kept, "n_bytes", "media"])


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, _ROWS) for k in range(0, whole.num_rows, _ROWS)):
            found = [(None,) * 4 if m is None else features(m) for m in batch.column("media").to_pylist()]
            spans, loud = ([x and [{"begin": a, "end": b} for a, b in x] for x in (f[c] for f in found)] for c in (2, 3))
            new = pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()), pa.array(spans, _SPAN), pa.array(loud, _SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "samples", "mels", "spans", "segments"])


def _kinds(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in without)


def store_clips(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with `n_bytes` and `media`: the text's UTF-8 bytes, padded with bytes 0 up
    to a positive multiple of BLOCK, as the samples of a WAV file. Null counts as empty. Columns
    with these names give way, others pass through, repeated rows too. An empty table gives no rows."""
    kept = df.drop("n_bytes", "media").withColumn("__text", F.col(text_col)).drop(text_col)
    return kept.mapInArrow(_store, _kinds(kept, "__text") + "n_bytes long, media binary")


def audio_features(df: DataFrame) -> DataFrame:
    """df with `samples` (as read back), `mels`, `spans` and `segments` of each clip in `media`: see the
    module. Null media have null features; clips of any length, silent ones too, have at least one
    tensor. Columns of df with these names give way, others pass through, repeated rows too."""
    kept = df.drop("samples", "mels", "spans", "segments")
    span = "array<struct<begin double, end double>>"
    return kept.mapInArrow(_analyse, _kinds(kept) + f"samples binary, mels binary, spans {span}, segments {span}")


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    found = audio_features(store_clips(documents(spark, sf_dir).select("doc_id", "text")))
    loud = F.aggregate("segments", F.lit(0.0), lambda total, x: total + x["end"] - x["begin"])
    told = F.format_string("%d tensors, %d segments, %.3f s, %s", F.size("spans"), F.size("segments"), loud, F.md5("mels"))
    return found.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), told.alias("feature"), F.size("spans").cast("long").alias("n_tensors"),
    )
