"""Quality rules: counts of words, symbols and repeats, and bands of zstandard compression ratios."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, pick

#: From so many bytes on, the least and the greatest ratio of raw to compressed bytes that prose of that length has, with
#: a margin. Short texts hardly compress; long ones compress better.
BANDS = [(0, 0.0, 1.8), (64, 0.5, 1.9), (128, 0.9, 2.3), (256, 1.1, 2.5), (512, 1.2, 2.6), (1024, 1.3, 2.8), (2048, 1.4, 2.9), (4096, 1.5, 3.1), (16384, 1.6, 3.6)]
#: Fixed chunks of so many bytes, their band (a shorter rest has the band of its length), and the share of chunks that may
#: be outside.
CHUNK, CHUNK_BAND, OUTSIDE = 2048, (1.3, 3.0), 0.25
LEVEL, GRAM = 3, 5
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, chunks_outside long"


def repeated_words(words: list[bytes], gram: int = GRAM) -> int:
    """How many of the words are in windows of `gram` words that the text has twice or more."""
    n = len(words) - gram + 1
    if n < 2:
        return 0
    grams = list(zip(*[words[k : n + k] for k in range(gram)]))
    if len(set(grams)) == n:
        return 0
    first: dict[tuple, int] = {}
    twice = set()
    for k, g in enumerate(grams):
        at = first.setdefault(g, k)
        if at != k:
            twice.add(at)
            twice.add(k)
    covered, upto = 0, 0
    for k in sorted(twice):
        covered += k + gram - max(k, upto)
        upto = k + gram
    return covered


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(SPACE))
        seen.add(line)
    return n


def in_band(n_bytes: int, ratio: float, bands: list[tuple[int, float, float]] = BANDS) -> bool:
    _, low, high = bands[bisect_right(bands, n_bytes, key=lambda b: b[0]) - 1]
    return low <= ratio <= high


def judge_quality(docs: DataFrame, id_column: str = "doc_id", bands: list[tuple[int, float, float]] = BANDS, chunk: int = CHUNK, chunk_band: tuple[float, float] = CHUNK_BAND, outside: float = OUTSIDE) -> DataFrame:
    """Counts, ratios and the verdict for each text, read whole; columns as in SCHEMA.

    base_failed: under 10 words, or over a fifth of the words in 5-word windows that the text has twice. kept: the base
    passed, the whole document's zstandard ratio is in the band of its length, and at most a share `outside` of its chunks
    of `chunk` bytes has a ratio out of chunk_band, or, of the shorter last one, out of the band of its length: repetitive texts are above the bands, incompressible ones below.

    Null or empty text: no words, ratio 0, base_failed. Repeated rows are judged each. Other columns are left out. A worker
    holds some MB of texts at a time, or one text.
    """

    def make():
        import zstandard

        zstd = zstandard.ZstdCompressor(level=LEVEL)
        pressed = lambda data: len(data) / len(zstd.compress(data))

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                words = data.split()
                n, repeats = len(words), repeated_words(words)
                failed = n < 10 or 100 * repeats > 20 * n
                ratio = pressed(data) if data else 0.0
                cut = [data[k : k + chunk] for k in range(0, len(data), chunk)]
                parts = [pressed(x) for x in cut] if len(cut) > 1 else [ratio] * len(cut)
                odd = sum(not (chunk_band[0] <= r <= chunk_band[1] if len(x) == chunk else in_band(len(x), r, bands)) for x, r in zip(cut, parts, strict=True))
                for c, v in (
                    ("n_words", n), ("word_chars", len(text or "") - len(data) + len(data.translate(None, SPACE))), ("n_symbols", len(data) - len(data.translate(None, SYMBOLS))),
                    ("n_dup_lines", duplicate_lines(data)), ("n_repeat_words", repeats), ("base_failed", failed),
                    ("kept", not failed and in_band(len(data), ratio, bands) and odd <= outside * len(parts)), ("ratio", ratio), ("n_chunks", len(parts)), ("chunks_outside", odd),
                ):
                    out[c].append(v)
            return out | {"doc_id": batch.column(id_column)}

        return each

    return map_batches(pick(docs, id_column, "text"), make, SCHEMA, "text")
