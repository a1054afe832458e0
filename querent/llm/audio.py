"""Audio columns: 8-bit mono WAVE bytes, and features of what the stored bytes hold.

A payload is stored losslessly, one byte a sample, behind a 44-byte RIFF header. Features of the samples read back:
polyphase resampling by UP/DOWN, log-mel energies of overlapped frames, and segments of activity by two energy
thresholds (hysteresis). Log-mel windows are fixed-shape tensors (WINDOW frames by MELS bands, the last one padded with
silence) with their time spans. They are built as an Arrow fixed-shape tensor array; Spark's column holds its values as
arrays of WINDOW * MELS floats, and tensor_array() gives the Arrow tensors back.

Long recordings are worked through in blocks that carry what filter and frames overlap, so beyond the media and the
features themselves memory is bounded. Null media gives null features. Null text is stored as the empty payload (192
spaces). Repeated rows give equal results, further columns are not looked at, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 24
FRAME, HOP, MELS, WINDOW = 300, 120, 40, 16
UNIT, HEADER = 192, 44
#: Decibels over the quietest tenth at which activity starts and ends, and the least length of a segment in frames.
START_DB, END_DB, LEAST = 6.0, 3.0, 3
#: Frames worked on at once.
BLOCK = 4096
FLOOR = 1e-10
#: Bytes of features that are sent on at once.
SENT = 8 << 20
TENSORS = "array<struct<start_s: double, end_s: double, mel: array<float>>>"


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), padded with spaces to a positive multiple of UNIT."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(data)
    short = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(data, F.encode(F.expr(f"repeat(' ', {UNIT})"), "UTF-8").substr(F.lit(1), short))


def _little(n: Column) -> Column:
    """A number as four bytes, lowest first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[digits.substr(k, 2) for k in (7, 5, 3, 1)]))


def wave(samples: Column, rate: int = RATE) -> Column:
    """8-bit mono WAVE bytes of a binary column of samples."""
    n = F.octet_length(samples)
    form = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    pad = F.when(n % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    return F.concat(F.lit(b"RIFF"), _little(n + n % 2 + 36), F.lit(b"WAVE"), F.lit(form), _little(n), samples, pad)


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and its media."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    n = F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), wave(payload(text)).alias("media"))


def samples_of(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of 8-bit mono WAVE bytes, by walking their chunks."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not RIFF/WAVE")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        if name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def _phases() -> tuple[int, np.ndarray]:
    """The windowed-sinc low-pass in polyphase form: a column of taps for each of the UP outputs of a period, over the input
    samples from the first place (counted from the period's own first sample) on."""
    half = TAPS * max(UP, DOWN) // 2
    t = np.arange(-half, half + 1)
    cut = 1 / max(UP, DOWN)
    taps = np.sinc(t * cut) * cut * np.hanning(len(t) + 2)[1:-1] * UP
    first, last = -(half // UP), ((UP - 1) * DOWN + half) // UP
    at = np.arange(UP)[None, :] * DOWN + half - UP * np.arange(first, last + 1)[:, None]
    there = (at >= 0) & (at < len(taps))
    return first, np.where(there, taps[np.clip(at, 0, len(taps) - 1)], 0.0)


def resampled(held: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples first .. first+count at UP/DOWN of the rate; what lies outside the input (8-bit samples) is silence."""
    place, phases = _phases()
    q, end = first // UP, -(-(first + count) // UP)
    low, width = q * DOWN + place, len(phases)
    part = np.zeros((end - q - 1) * DOWN + width)
    a, b = max(0, low), min(len(held), low + len(part))
    if b > a:
        part[a - low : b - low] = (held[a:b].astype(np.float64) - 128) / 128
    # UP outputs for each period of DOWN inputs
    periods = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(part, width)[::DOWN])
    return (periods @ phases).reshape(-1)[first - q * UP :][:count]


@cache
def _window() -> np.ndarray:
    return np.hanning(FRAME)


@cache
def _mel() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, for the frames' spectra."""
    size = 1 << (FRAME - 1).bit_length()
    top = RATE * UP / DOWN / 2
    hertz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    bins = np.arange(size // 2 + 1) * (top * 2 / size)
    up = (bins[:, None] - hertz[:-2]) / (hertz[1:-1] - hertz[:-2])
    down = (hertz[2:] - bins[:, None]) / (hertz[2:] - hertz[1:-1])
    return np.maximum(0, np.minimum(up, down))


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies in hundredths of a decibel (frames by MELS) and the energy of each frame in decibels."""
    samples = np.frombuffer(data, np.uint8)
    total = -(-len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    size, window = 1 << (FRAME - 1).bit_length(), _window()
    mels, energy = [], []
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        wanted = (n - 1) * HOP + FRAME
        have = min(wanted, total - at * HOP)
        sound = np.zeros(wanted)
        sound[:have] = resampled(samples, at * HOP, have)
        cut = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
        spectrum = np.fft.rfft(cut * window, size)
        power = spectrum.real**2 + spectrum.imag**2
        mels.append(np.round(1000 * np.log10(power @ _mel() + FLOOR)).astype(np.int16))
        energy.append(10 * np.log10((cut * cut).mean(axis=1) + FLOOR))
    return np.concatenate(mels), np.round(np.concatenate(energy), 2)


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans of activity: from where the energy passes the upper threshold until it falls under the lower one."""
    base = float(np.quantile(energy, 0.1))
    above, below = energy >= base + START_DB, energy < base + END_DB
    # the state of a frame is that of the last frame that passed a threshold
    mark = np.where(above, 1, np.where(below, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    second = HOP * DOWN / (UP * RATE)
    return [(a * second, b * second) for a, b in edge.reshape(-1, 2).tolist() if b - a >= LEAST]


def spans(frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in seconds of each window of a recording of so many frames."""
    second = HOP * DOWN / (UP * RATE)
    starts = np.arange(-(-frames // WINDOW)) * WINDOW * second
    return starts, np.minimum(starts + WINDOW * second, (frames - 1) * second + FRAME * DOWN / (UP * RATE))


def tensors(mels: np.ndarray) -> pa.FixedShapeTensorArray:
    """Windows of the log-mel energies as fixed-shape tensors of WINDOW by MELS."""
    n = -(-len(mels) // WINDOW)
    filled = np.full((n * WINDOW, MELS), int(np.log10(FLOOR) * 1000), np.float32)
    filled[: len(mels)] = mels
    filled /= np.float32(100)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, WINDOW, MELS))


def tensor_array(column: pa.Array) -> pa.FixedShapeTensorArray:
    """The tensors of an Arrow column `tensors` as it is read from Spark or Parquet, of all its rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    values = pa.concat_arrays([pa.array([], pa.float32()), *(x.flatten().field("mel").flatten() for x in parts)])
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, WINDOW * MELS))


def _tensor_column(rows: list[pa.FixedShapeTensorArray | None], frames: list[int]) -> pa.Array:
    """Rows of windows with their time spans, in the form of Spark's column."""
    there = [x for x in rows if x is not None]
    sizes = [0 if x is None else len(x) for x in rows]
    values = pa.concat_arrays([x.storage.flatten() for x in there]) if there else pa.array([], pa.float32())
    mel = pa.ListArray.from_arrays(pa.array(np.arange(sum(sizes) + 1) * WINDOW * MELS, pa.int32()), values)
    edges = [spans(n) for n in frames if n]
    starts, ends = (np.concatenate([np.empty(0), *(e[k] for e in edges)]) for k in (0, 1))
    window = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), mel], ["start_s", "end_s", "mel"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), window, mask=pa.array([x is None for x in rows]))


_PLAIN = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
    "segments": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])),
}


def audio_features(media: DataFrame) -> DataFrame:
    """Adds to rows with doc_id, n_bytes and media what the stored bytes hold, their features and their tensors."""

    def run(batches):
        for batch in batches:
            ids, lengths, rows, windows, frames, held_bytes = [], [], [], [], [], 0

            def made(ids, lengths, rows, windows, frames):
                plain = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLAIN.values(), strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *plain, _tensor_column(windows, frames)], ["doc_id", "n_bytes", *_PLAIN, "tensors"])

            for doc_id, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                ids.append(doc_id)
                lengths.append(n)
                if data.is_valid:
                    data = data.as_py()
                    _, held = samples_of(data)
                    mels, energy = features(held)
                    active = segments(energy)
                    windows.append(tensors(mels))
                    frames.append(len(mels))
                    digest = hashlib.sha256(windows[-1].storage.flatten().to_numpy().astype("<f4").tobytes()).hexdigest()[:32]
                    mark = f"{len(mels)}x{MELS}:{digest}:{','.join(f'{a:.3f}-{b:.3f}' for a, b in active)}"
                    rows.append((len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-16:]), len(data), hashlib.sha256(data).hexdigest(), mark, [{"start_s": a, "end_s": b} for a, b in active]))
                    held_bytes += mels.size * 4
                else:
                    windows.append(None)
                    frames.append(0)
                    rows.append((None,) * len(_PLAIN))
                if held_bytes > SENT:
                    yield made(ids, lengths, rows, windows, frames)
                    ids, lengths, rows, windows, frames, held_bytes = [], [], [], [], [], 0
            if rows:
                yield made(ids, lengths, rows, windows, frames)

    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, segments array<struct<start_s: double, end_s: double>>, tensors {TENSORS}"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def audio_digests(docs: DataFrame) -> DataFrame:
    """Stores the media of all documents in the shared folder, reads them back and gives digests, features and tensors."""
    return audio_features(stored(stored_media(docs), "media", "zstd"))
