"""Telephony audio columns: mu-law and A-law tables, ADPCM blocks, resampled PCM.

A byte stream is kept as 8-bit mu-law samples in a RIFF file and read back from
there. Companded samples expand by 256-entry tables made from the G.711 rule;
IMA ADPCM blocks of a whole batch are decoded side by side, one numpy step per
nibble position. PCM is resampled from 8 to 16 kHz and kept as 16-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNIT = 192
RATE = 8000
MULAW_TAG = 7
# Fixed values of IMA ADPCM: how a nibble moves the step index, and the rule of the step sizes.
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658,
    724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int64) ^ 0x55
    high, low = (a >> 4) & 7, (a & 0x0F) << 4
    size = np.where(high == 0, low + 8, low + 0x108 << np.maximum(high - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def riff(samples: bytes, tag: int = MULAW_TAG, rate: int = RATE, bits: int = 8) -> bytes:
    width = bits // 8
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * width, width, bits, 0)
    fact = struct.pack("<I", len(samples) // width)
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", samples)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_samples(media: bytes) -> tuple[int, int, memoryview]:
    """(format tag, rate, bytes of the samples) of a RIFF file."""
    view, at, tag, rate = memoryview(media), 12, 0, 0
    while at < len(view):
        name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", view, at + 8)
        elif name == b"data":
            return tag, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """PCM (blocks x samples) of IMA ADPCM blocks (blocks x bytes): a 4-byte head, then nibbles, low one first."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(blocks[:, 2].astype(np.int64), 88)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value = head
    for k in range(body.shape[1]):
        for half, nibble in enumerate((body[:, k] & 15, body[:, k] >> 4)):
            step = STEPS[index]
            move = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
            index = np.clip(index + INDEX_MOVE[nibble], 0, 88)
            out[:, 1 + 2 * k + half] = value
    return out


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the samples: every other one between four neighbours by (-1, 9, 9, -1) / 16, ends held."""
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and with blanks up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def features(samples: np.ndarray, pcm16: np.ndarray) -> str:
    mu, a = MULAW[samples].astype(np.int64), ALAW[samples].astype(np.int64)
    turns = int(np.count_nonzero(np.diff(np.signbit(mu))))
    return f"samples={len(mu)};peak={int(np.abs(mu).max())};power={int(mu @ mu) // len(mu)};turns={turns};alaw_power={int(a @ a) // len(a)};pcm_crc={zlib.crc32(pcm16.tobytes())}"


FULL = "doc_id long, n_bytes long, media binary, pcm binary, feature string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # about a megabyte of text at a time: the blocks of many texts are decoded together
            sizes = batch.column(1).fill_null("").cast(pa.large_string())
            at = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
                yield _some(batch.slice(i, j - i), digest)
                i = j

    return run


def _some(batch: pa.RecordBatch, digest: bool) -> pa.RecordBatch:
    stored = []
    for text in batch.column(1).to_pylist():
        n, payload = payload_of(text)
        stored.append((n, riff(payload)))
    back = [riff_samples(m)[2] for _, m in stored]
    blocks = np.concatenate([np.frombuffer(b, np.uint8) for b in back]).reshape(-1, UNIT)
    level = np.abs(adpcm_blocks(blocks).astype(np.int64)).sum(axis=1)
    ends = np.cumsum([len(b) // UNIT for b in back])
    level = np.add.reduceat(level, np.r_[0, ends[:-1]])
    out = []
    for (n, media), raw, total in zip(stored, back, level.tolist()):
        samples = np.frombuffer(raw, np.uint8)
        pcm = double_rate(MULAW[samples])
        feature = f"{features(samples, pcm)};adpcm_level={total}"
        if digest:
            out.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        else:
            out.append((n, media, riff(pcm.tobytes(), 1, 2 * RATE, 16), feature))
    shape = (DIGEST if digest else FULL).split(", ")[1:]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in shape]
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], ["doc_id", *(x.split()[0] for x in shape)])


def telephony(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, pcm, feature): a text's bytes as a mu-law file, and its PCM at 16 kHz.

    Texts are padded with blanks to a positive multiple of UNIT bytes, so null
    and empty texts give UNIT blanks; n_bytes is without them. feature tells of
    the samples read back from the file: count, peak, mean power by either law,
    changes of sign, a checksum of the PCM, and the summed level of the bytes as
    ADPCM blocks of UNIT. Each row alone decides its values. Ids may be null or
    repeat; empty tables give empty ones; other columns aren't read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_rows(False), FULL)


def telephony_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """telephony() with digests in place of the files, made from the bytes read back."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_rows(True), DIGEST)
