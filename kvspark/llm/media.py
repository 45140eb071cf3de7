"""Telephony audio: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

mu-law and A-law samples are expanded by 256-entry tables that are made from the
companding rules; ADPCM blocks are decoded with numpy across blocks: the loop
runs over the sample position within a block, each step handles all blocks.
Containers are RIFF/WAVE (format tags 1, 6, 7, 17).

Defined results: a null payload counts as empty; bytes that are no such mono WAVE
file, stereo ones too, give null audio columns, and so does ADPCM whose short last
block holds no header; a longer one is decoded; an empty table gives an empty result; repeated
rows are decoded each; extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspark.llm._common import by_rows, columns_as

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE, TARGET, FRAME = 8000, 16000, 192
#: So many ADPCM blocks are decoded at once.
BLOCKS = 1 << 14


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law expansion: sign, 3 bits of exponent, 4 of mantissa, all inverted."""
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law expansion: even bits inverted, the first segment is linear."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


#: Fixed values of the IMA ADPCM standard: step sizes and index changes.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
     107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
     876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
     5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
     27086, 29794, 32767], dtype=np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def adpcm_blocks(raw: np.ndarray) -> np.ndarray:
    """The samples of blocks of mono IMA ADPCM (a row each: predictor (int16), step index, a spare byte, codes)."""
    n, block = raw.shape
    out = np.empty((n, 1 + 2 * (block - 4)), dtype=np.int16)
    for at in range(0, n, BLOCKS):
        part = raw[at : at + BLOCKS]
        value = np.ascontiguousarray(part[:, :2]).view("<i2")[:, 0].astype(np.int32)
        index = np.minimum(part[:, 2], 88).astype(np.int32)
        codes = np.stack([part[:, 4:].T & 15, part[:, 4:].T >> 4], axis=1).reshape(-1, len(part))
        rows = np.empty((out.shape[1], len(part)), dtype=np.int16)
        rows[0] = value
        for i, code in enumerate(codes):
            step = IMA_STEPS[index]
            change = (step >> 3) + step * ((code >> 2) & 1) + (step >> 1) * ((code >> 1) & 1) + (step >> 2) * (code & 1)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
            rows[i + 1] = value
        out[at : at + BLOCKS] = rows.T
    return out


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """The samples of the whole blocks."""
    n = len(data) // block
    return adpcm_blocks(np.frombuffer(data, dtype=np.uint8, count=n * block).reshape(n, block)).reshape(-1)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation at exact integer positions; the last sample is held."""
    if rate == target or len(pcm) == 0:
        return pcm
    n = len(pcm) * target // rate
    place = np.arange(n, dtype=np.int64) * rate
    left, part = place // target, place % target
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (target - part) + wide[right] * part) // target).astype(np.int16)


def wrap(data: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono RIFF/WAVE file around samples that are stored as they are."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * block, block, bits, 0)
    odd = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data))
    body += b"data" + struct.pack("<I", len(data)) + data + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(stored: bytes) -> tuple[int, int, int, int, bytes]:
    """(format tag, rate, block size, bits, data) of a mono RIFF/WAVE file; ValueError otherwise."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, head, data = 12, None, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt " and size >= 16:
            head = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            data = stored[at + 8 : at + 8 + size]
            if len(data) < size:
                raise ValueError("data cut short")
        at += 8 + size + (size & 1)
    if head is None or data is None or head[1] != 1:
        raise ValueError("no mono format or no data")
    return head[0], head[2], head[4], head[5], data


class Decoder:
    """Holds the tables."""

    def __init__(self) -> None:
        self.tables = {MULAW: mulaw_table(), ALAW: alaw_table()}

    def pcm(self, tag: int, block: int, bits: int, data: bytes) -> np.ndarray:
        if tag in self.tables:
            return self.tables[tag][np.frombuffer(data, dtype=np.uint8)]
        if tag == ADPCM and block > 4:
            whole = len(data) // block * block
            tail = data[whole:]
            if 0 < len(tail) < 4:
                raise ValueError("last block without a header")
            parts = [decode_adpcm(data[:whole], block), decode_adpcm(tail, len(tail)) if tail else []]
            return np.concatenate(parts).astype(np.int16)
        if tag == PCM and bits == 16:
            return np.frombuffer(data[: len(data) & ~1], dtype="<i2")
        if tag == PCM and bits == 8:
            return ((np.frombuffer(data, dtype=np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
        raise ValueError(f"format {tag}, {bits} bits")


def decode_media(df: DataFrame, key: str, media: str, target: int = TARGET) -> DataFrame:
    """Decode a column of WAVE files: key, rate, samples (long), pcm (16-bit little-endian at ``target`` Hz)."""
    few = columns_as(df, key=key, media=media)
    decoder = Decoder()

    def make(batch: pa.RecordBatch) -> list:
        rows = []
        for stored in batch.column("media").to_pylist():
            try:
                tag, rate, block, bits, data = unwrap(stored or b"")
                pcm = resample(decoder.pcm(tag, block, bits, data), rate, target)
                rows.append((rate, len(pcm), pcm.astype("<i2").tobytes()))
            except ValueError:
                rows.append((None, None, None))
        return list(zip(*rows, strict=True))

    run = by_rows(make, ["rate", "samples", "pcm"], [pa.int32(), pa.int64(), pa.binary()], ("key",), weigh="media")
    return few.mapInArrow(run, f"key {few.schema['key'].dataType.simpleString()}, rate int, samples long, pcm binary")


def features(kind: str, pcm: np.ndarray) -> str:
    """Level, peak and zero crossings of the samples."""
    x = pcm.astype(np.float64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{kind};s={len(pcm) / RATE:.3f};peak={int(np.abs(x).max())};rms={np.sqrt(np.mean(x * x)):.2f};zc={crossings}"


def telephony_media(docs: DataFrame) -> DataFrame:
    """Each whole text as telephony audio: doc_id, n_bytes, media (its WAVE file of mu-law samples),
    payload (the samples, read back from it), pcm (the mu-law samples, expanded and resampled to
    ``TARGET`` Hz, 16 bits) and feature.

    The payload's bytes are decoded in three ways, of which ``feature`` tells: as mu-law
    and A-law samples by their tables, and as ADPCM blocks of ``FRAME`` bytes, all blocks
    of a batch at once.
    """
    few = columns_as(docs, doc_id="doc_id", text="text")
    decoder = Decoder()

    def make(batch: pa.RecordBatch) -> list:
        raws = [(t or "").encode() for t in batch.column("text").to_pylist()]
        stored = [wrap(raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))) for raw in raws]
        read = [unwrap(s) for s in stored]
        payloads = [r[-1] for r in read]
        every = adpcm_blocks(np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME))
        stops = np.cumsum([len(p) // FRAME for p in payloads]).tolist()
        pcms, told = [], []
        for payload, (tag, rate, block, bits, _), stop in zip(payloads, read, stops, strict=True):
            mulaw, alaw = decoder.pcm(tag, block, bits, payload), decoder.pcm(ALAW, block, bits, payload)
            adpcm = every[stop - len(payload) // FRAME : stop].reshape(-1)
            pcms.append(resample(mulaw, rate, TARGET).astype("<i2").tobytes())
            told.append("|".join(features(k, x) for k, x in (("mulaw", mulaw), ("alaw", alaw), ("adpcm", adpcm))))
        return [list(map(len, raws)), stored, payloads, pcms, told]

    names, types = ["n_bytes", "media", "payload", "pcm", "feature"], [pa.int64(), *[pa.binary()] * 3, pa.string()]
    shape = "doc_id long, n_bytes long, media binary, payload binary, pcm binary, feature string"
    return few.mapInArrow(by_rows(make, names, types, ("doc_id",), limit=1 << 20), shape)


def telephony_digest(docs: DataFrame) -> DataFrame:
    """``telephony_media`` with checksums in place of the bytes; ``feature`` tells of the PCM too."""
    size = lambda c: F.octet_length(c).cast("long")
    pcm = F.concat(F.lit(f"|pcm{TARGET}="), (size("pcm") / 2).cast("long"), F.lit(";crc="), F.crc32("pcm"))
    return telephony_media(docs).select(
        "doc_id", "n_bytes", size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), size("media").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat("feature", pcm).alias("feature"),
    )
