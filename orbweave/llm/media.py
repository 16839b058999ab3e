"""Media columns: texts kept as 8-bit audio, and features of the audio.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the unsigned 8-bit samples of a mono
WAV file. The files are a binary column of a Parquet table in the shared folder. Reading them back gives the payload
and, after polyphase resampling from 16 to 12 kHz, overlapped log-mel filterbanks and active segments: a segment
holds the frames above a low energy threshold around one above a high threshold (hysteresis). The last frame is
filled up with zeros, so every sample counts. Filterbanks are cut into windows of fixed shape, stored as Arrow
fixed-shape tensors of 16-bit floats with the time span of each window and the active frames; the feature is derived
from the stored tensors.

Null and empty texts give 64 zero bytes. A null doc_id stays null. Equal texts give equal values, wherever they stand.
Very long texts are one file; resampling and framing run over blocks of it. Extra columns are not carried. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbweave.plans.shared import materialize

RATE, UP, DOWN, TAPS = 16_000, 3, 4, 12
FRAME, HOP, MELS = 256, 128, 20
WINDOW = 16  # frames in a tensor
HIGH_DB, LOW_DB = 0.5, -0.5  # against the file's mean frame energy
ALIGN = 64
BLOCK_FRAMES = 4096
#: Seconds from frame to frame.
STEP = HOP * DOWN / (RATE * UP)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> bytes:
    """The samples; chunks other than ``data`` are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def pad(raw: bytes, align: int = ALIGN) -> bytes:
    return raw + bytes(max(align, -(-len(raw) // align) * align) - len(raw))


def _low_pass() -> np.ndarray:
    """Windowed-sinc filter of UP * TAPS taps; row p holds phase p."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    return (h * UP / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.linspace(0, rate / 2, FRAME // 2 + 1)[:, None]
    low, mid, high = edge[:-2], edge[1:-1], edge[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


PHASES, BANK, HANN = _low_pass(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase: output n takes phase (n * DOWN) % UP of the filter at input (n * DOWN) // UP."""
    x = np.concatenate([np.zeros(TAPS - 1, np.float32), x])
    n = (len(x) - TAPS + 1) * UP // DOWN
    out = np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    for k in range(UP):
        first, count = k * DOWN // UP, len(range(k, n, UP))
        rows = view[first : first + count * DOWN : DOWN][:count]
        out[k::UP] = rows @ PHASES[k * DOWN % UP][::-1]
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and the energy in dB, a row for each frame."""
    whole = max(0, -(-(len(y) - FRAME) // HOP)) * HOP + FRAME
    y = np.concatenate([y, np.zeros(whole - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, power = [], []
    for at in range(0, len(frames), BLOCK_FRAMES):
        part = np.abs(np.fft.rfft(frames[at : at + BLOCK_FRAMES] * HANN)).astype(np.float32) ** 2
        mels.append(np.log10(part @ BANK + np.float32(1e-6)) * 10)
        power.append(np.log10(part.sum(1) + np.float32(1e-6)) * 10)
    return np.concatenate(mels), np.concatenate(power)


def segments(db: np.ndarray) -> np.ndarray:
    """First and last frame (exclusive) of each active segment."""
    level = db - db.mean()
    low, high = level > LOW_DB, level > HIGH_DB
    edge = np.diff(np.concatenate([[0], low.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    seen = np.concatenate([[0], np.cumsum(high)])
    keep = seen[end] > seen[start]
    return np.stack([start[keep], end[keep]], 1)


def analyse(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and segments of a payload."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, db = log_mel(resample(x))
    return mel, segments(db)


def tensors(mel: np.ndarray, active: np.ndarray) -> pa.RecordBatch:
    """Windows of WINDOW frames as fixed-shape tensors (the last padded with zeros), with spans in seconds and 1 for each active frame."""
    n = -(-len(mel) // WINDOW)
    full = np.zeros((n * WINDOW, MELS), np.float16)
    full[: len(mel)] = mel
    on = np.zeros(n * WINDOW, np.uint8)
    for a, b in active:
        on[a:b] = 1
    start = np.arange(n) * WINDOW
    return pa.RecordBatch.from_arrays([
        pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, WINDOW, MELS)), pa.FixedShapeTensorArray.from_numpy_ndarray(on.reshape(n, WINDOW)),
        pa.array(start * STEP), pa.array(np.minimum(start + WINDOW, len(mel)) * STEP),
    ], ["log_mel", "active", "start_s", "end_s"])


def frames_of(stored: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and segments of stored tensors."""
    n = round(stored.column("end_s")[-1].as_py() / STEP)
    mel = stored.column("log_mel").to_numpy_ndarray().reshape(-1, MELS)[:n].astype(np.float32)
    edge = np.diff(np.concatenate([[0], stored.column("active").to_numpy_ndarray().reshape(-1)[:n].astype(np.int8), [0]]))
    return mel, np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def describe(mel: np.ndarray, active: np.ndarray) -> str:
    """Frames, active segments, active frames, then the mean and the deviation of each mel band in half decibels."""
    stats = np.concatenate([mel.mean(0), mel.std(0)])
    return f"{len(mel)}:{len(active)}:{int((active[:, 1] - active[:, 0]).sum())}:" + ",".join(str(int(v)) for v in np.rint(stats * 2))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a WAV file, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array((to_wav(pad(r)) for r in raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
FEATURES = STORED + ", feature string"


def store_tensors(media: DataFrame) -> DataFrame:
    """The columns of STORED for each file, read back, and ``log_mel``: an Arrow IPC stream of its tensors and their time spans, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for stored in batch.column("media"):
                file = stored.as_buffer().to_pybytes()
                payload = from_wav(file)
                row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(file), hashlib.sha256(file).hexdigest(), to_ipc(tensors(*analyse(payload)))]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [x.split()[0] for x in STORED.split(", ")] + ["log_mel"])

    return materialize(media.mapInArrow(run, STORED + ", log_mel binary"), "tensors")


def media_features(media: DataFrame, with_tensors: bool = False) -> DataFrame:
    """The columns of FEATURES for each stored file; ``with_tensors`` keeps ``log_mel``."""
    names = [x.split()[0] for x in FEATURES.split(", ")] + ["log_mel"] * with_tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(*frames_of(pa.ipc.open_stream(x.as_buffer()).read_next_batch())) for x in batch.column("log_mel")]
            batch = batch.append_column("feature", pa.array(found, pa.string()))
            yield batch.select(names)

    return store_tensors(media).mapInArrow(run, FEATURES + ", log_mel binary" * with_tensors)


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
