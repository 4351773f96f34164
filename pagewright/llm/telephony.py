"""Telephony audio columns: mu-law, A-law and ADPCM in WAV form, expanded and resampled to 16-bit PCM."""

from __future__ import annotations

import math
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, pick

#: WAV format tags; bytes of an ADPCM block's header and codes; what a payload is padded to.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}
HEADER, CODES, UNIT = 4, 64, 64
RATE, TARGET_RATE, TAPS = 8000, 16000, 8

#: The step sizes and index moves of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


@cache
def mulaw_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """The 16-bit sample of each A-law code."""
    a = np.arange(256) ^ 0x55
    part, low = a >> 4 & 7, (a & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 1 + two a code byte) of mono IMA ADPCM blocks (n, HEADER + code bytes), all blocks side by side.

    A header has the first sample (16 bits), the step index and a byte of 0. The low four bits of a byte come first.
    """
    steps, moves = np.array(STEPS, np.int32), np.array(MOVES * 2, np.int32)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, HEADER:].T)
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * len(codes)):
        code = (codes[k // 2] >> 4 * (k % 2) & 15).astype(np.int32)
        step = steps[index]
        move = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + moves[code], 0, 88)
        out[k + 1] = value
    return out.T


def wav(tag: int, rate: int, data: bytes, bits: int, align: int) -> bytes:
    """A mono WAV file."""
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * align, align, bits)
    if tag == ADPCM:
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * align // (2 * (align - HEADER) + 1), align, bits, 2, 2 * (align - HEADER) + 1)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and data of a mono WAV file; ValueError if it's none."""
    view = memoryview(media)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(view):
        (n,) = struct.unpack_from("<I", view, at + 4)
        if view[at : at + 4] == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif view[at : at + 4] == b"data" and form:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data in the WAV file")


def store(payload: bytes, tag: int, rate: int = RATE) -> bytes:
    """The payload's bytes as mu-law or A-law samples, or as ADPCM codes in blocks that start from silence."""
    if tag != ADPCM:
        return wav(tag, rate, payload, 8, 1)
    codes = np.frombuffer(payload, np.uint8).reshape(-1, CODES)
    return wav(tag, rate, np.pad(codes, ((0, 0), (HEADER, 0))).tobytes(), 4, HEADER + CODES)


def stored_payload(tag: int, align: int, data: memoryview) -> bytes:
    """What store() was given, from the file's data."""
    return bytes(data) if tag != ADPCM else np.frombuffer(data, np.uint8).reshape(-1, align)[:, HEADER:].tobytes()


def expand(files: list[tuple[int, int, memoryview]]) -> list[np.ndarray]:
    """16-bit samples of (tag, block size, data) each; ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray | None] = [None] * len(files)
    by_align: dict[int, list[int]] = {}
    for k, (tag, align, data) in enumerate(files):
        if tag == ADPCM:
            by_align.setdefault(align, []).append(k)
        elif tag in (MULAW, ALAW):
            out[k] = (mulaw_table() if tag == MULAW else alaw_table())[np.frombuffer(data, np.uint8)]
        elif tag == PCM:
            out[k] = np.frombuffer(data, "<i2")
        else:
            raise ValueError(f"format {tag} isn't telephony audio")
    for align, ks in by_align.items():
        blocks = [np.frombuffer(files[k][2], np.uint8).reshape(-1, align) for k in ks]
        samples = decode_adpcm(np.concatenate(blocks))
        at = 0
        for k, b in zip(ks, blocks, strict=True):
            out[k] = samples[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A low-pass filter of windowed sines: a row for each of `up` phases, to be convolved with `taps` samples on each side."""
    width = max(up, down)
    x = np.arange(2 * taps)[None, :] - taps + np.arange(up)[:, None] / up
    h = np.sinc(x * up / width) * np.cos(np.pi * x / (2 * taps + 2)) ** 2
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(pcm: np.ndarray, rate: int, target: int = TARGET_RATE, taps: int = TAPS) -> np.ndarray:
    """16-bit samples at the target rate, by a polyphase filter; silence before and after."""
    if rate == target or not len(pcm):
        return pcm.astype(np.int16)
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    phases, n = _phases(up, down, taps), len(pcm)
    part = 1 << 18  # so that the floats of a long recording are never all there
    padded = np.pad(pcm, (taps - 1, taps))
    if down > 1:
        # Sample m of the result is phase m * down mod up at place m * down // up; others aren't made.
        out = np.empty(-(-n * up // down), np.int16)
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
        for first in range(min(up, len(out))):
            for at in range(first, len(out), part * up):
                place = np.arange(at, min(len(out), at + part * up), up) * down // up
                out[at : at + part * up : up] = np.clip(np.rint(around[place].astype(np.float32) @ phases[first * down % up][::-1]), -32768, 32767)
        return out
    out = np.empty(n * up, np.int16)
    for at in range(0, n, part):
        m = min(part, n - at)
        x = padded[at : at + m + 2 * taps - 1].astype(np.float32)
        for p in range(up):
            out[at * up + p : (at + m) * up : up] = np.clip(np.rint(np.convolve(x, phases[p], "valid")), -32768, 32767)
    return out


def feature(tag: int, rate: int, pcm: np.ndarray) -> str:
    """Format, rate and length, with loudness, peak and zero crossings of the samples, all as integers."""
    power = sum(int(np.dot(p := pcm[k : k + (1 << 18)].astype(np.float64), p)) for k in range(0, len(pcm), 1 << 18))
    low = pcm < 0
    return f"{NAMES[tag]}:{rate}:{len(pcm)}:{math.isqrt(power // max(1, len(pcm)))}:{int(max(abs(int(pcm.min(initial=0))), int(pcm.max(initial=0))))}:{int(np.count_nonzero(low[1:] != low[:-1]))}"


def payload_of(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def store_texts(docs: DataFrame, id_column: str = "doc_id", target_rate: int = TARGET_RATE, with_files: bool = False) -> DataFrame:
    """Stores each whole text as telephony audio and reads it back; columns as in SCHEMA, with_files also media (the stored
    WAV file) and pcm (a WAV file of the samples at target_rate).

    The payload's bytes are, without loss, mu-law samples, A-law samples or ADPCM codes, by crc32 of the payload mod 3. All
    that is returned of the payload comes from the stored bytes. The samples, expanded and resampled, are stored as a PCM file
    (its size and digest: pcm_bytes, pcm_sha256), which feature() describes as it's read back.

    Null text: as empty, a payload of 64 bytes 0. Repeated rows are stored each; equal texts have equal values. Other columns
    are left out. A worker holds some MB of texts and their samples at a time, or one text.
    """

    def make():
        from hashlib import sha256

        def each(batch: pa.RecordBatch) -> dict:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [store(p := payload_of(t), (MULAW, ALAW, ADPCM)[zlib.crc32(p) % 3]) for t in texts]
            read = [read_wav(m) for m in media]
            back = [stored_payload(tag, align, data) for tag, _, align, data in read]
            made = [resample(pcm, rate, target_rate) for pcm, (_, rate, _, _) in zip(expand([(t, a, d) for t, _, a, d in read]), read, strict=True)]
            stored = [wav(PCM, target_rate, s.astype("<i2").tobytes(), 16, 2) for s in made]
            sounds = [np.frombuffer(read_wav(s)[3], "<i2") for s in stored]
            out = {
                "doc_id": batch.column(id_column), "n_bytes": [len(t) for t in texts], "payload_bytes": [len(b) for b in back], "payload_sha256": [sha256(b).hexdigest() for b in back],
                "tail_crc32": [zlib.crc32(b[-UNIT:]) for b in back], "media_bytes": [len(m) for m in media], "media_sha256": [sha256(m).hexdigest() for m in media],
                "feature": [feature(r[0], target_rate, s) for r, s in zip(read, sounds, strict=True)],
                "pcm_bytes": [len(s) for s in stored], "pcm_sha256": [sha256(s).hexdigest() for s in stored],
            }
            return out | ({"media": media, "pcm": stored} if with_files else {})

        return each

    return map_batches(pick(docs, id_column, "text"), make, SCHEMA + (", media binary, pcm binary" if with_files else ""), "text", most=2 << 20)


def resample_column(files: DataFrame, media_column: str = "media", target_rate: int = TARGET_RATE, id_column: str = "doc_id") -> DataFrame:
    """id_column, pcm (16-bit WAV at target_rate) and error for each telephony file in media_column. Null media: null pcm; a
    file that can't be read: null pcm and the reason."""

    def make():
        def one(media: bytes | None) -> tuple[bytes | None, str | None]:
            if media is None:
                return None, None
            try:
                tag, rate, align, data = read_wav(media)
                return wav(PCM, target_rate, resample(expand([(tag, align, data)])[0], rate, target_rate).astype("<i2").tobytes(), 16, 2), None
            except (ValueError, struct.error) as e:
                return None, str(e)

        def each(batch: pa.RecordBatch) -> dict:
            done = [one(m) for m in batch.column("media").to_pylist()]
            return {id_column: batch.column("id").cast(pa.int64()), "pcm": [p for p, _ in done], "error": [e for _, e in done]}

        return each

    return map_batches(pick(files, id_column, media_column).toDF("id", "media"), make, f"`{id_column}` long, pcm binary, error string", "media", most=2 << 20)
