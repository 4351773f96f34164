"""Fill-in-the-middle: an index of distinct texts with Elias-Fano lists of their unit boundaries, and seeded cuts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pick, written

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first; what the seeds are made of.
PLAIN, SUFFIX_FIRST, SEED = 10, 20, "1"
#: Bytes whose boundaries are found at a time.
PART = 1 << 20

INDEX = "text_sha256 string, n_bytes long, n_units long, copies long, bounds binary"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def low_bits(n_units: int, n_bytes: int) -> int:
    """Bits of each of the n_units + 1 boundaries up to n_bytes that are stored as they are."""
    return max(0, (n_bytes // (n_units + 1)).bit_length() - 1)


def boundaries(data: bytes) -> tuple[int, bytes]:
    """The number of code points of UTF-8 data, and the Elias-Fano list of the bytes where they start, with the end.

    Of each boundary v, the i-th, the low bits stand in one string of bits, and v without them sets bit (v >> low) + i of
    another: about two bits and the low ones for each unit. Both strings are stored one after the other, bits low to high.
    """
    raw = np.frombuffer(data, np.uint8)
    n = int(np.count_nonzero((raw & 0xC0) != 0x80))
    low = low_bits(n, len(data))
    upper = np.zeros(n + 1 + (len(data) >> low) + 1, bool)
    rest = np.zeros((n + 1) * low, bool)
    done = 0

    def put(values: np.ndarray) -> None:
        nonlocal done
        upper[(values >> low) + np.arange(done, done + len(values))] = True
        for k in range(low):
            rest[done * low + k : (done + len(values)) * low : low] = (values >> k) & 1
        done += len(values)

    for at in range(0, len(data), PART):
        put(np.flatnonzero((raw[at : at + PART] & 0xC0) != 0x80) + at)
    put(np.array([len(data)]))
    return n, np.packbits(rest, bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


def boundary(bounds: bytes, n_units: int, n_bytes: int, unit: int) -> int:
    """The byte where this unit (0 to n_units, the end) starts: the place of the unit-th set bit, and its low bits."""
    low = low_bits(n_units, n_bytes)
    cut = -(-(n_units + 1) * low // 8)
    upper = np.frombuffer(bounds, np.uint8, offset=cut)
    ends = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    byte = int(np.searchsorted(ends, unit, side="right"))
    before = int(ends[byte - 1]) if byte else 0
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(upper[byte : byte + 1], bitorder="little"))[unit - before])
    value = place - unit
    for k in range(low):
        bit = unit * low + (low - 1 - k)
        value = 2 * value + (bounds[bit >> 3] >> (bit & 7) & 1)
    return value


def seeds(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def form_of(data: bytes, h3: int, h4: int, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> str:
    """Texts that are empty or hold a marker stay plain, so that every output can be taken apart again."""
    if not data or any(m in data for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return "plain"
    return "spm" if h4 % 100 < suffix_first else "psm"


def joined(data: bytes, a: int, b: int, form: str) -> bytes:
    if form == "plain":
        return data
    if form == "psm":
        return b"".join((PREFIX, data[:a], SUFFIX, data[b:], MIDDLE, data[a:b]))
    return b"".join((SUFFIX, data[b:], PREFIX, data[:a], MIDDLE, data[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of. A marker can't begin within the part before it, as that part has no '<' whose
    marker the next one's '<' could complete."""
    if form == "plain":
        return output
    first, second = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    one = output.index(first, 3)
    two = output.index(second, one + 3)
    head, mid, tail = output[3:one], output[one + 3 : two], output[two + 3 :]
    return head + tail + mid if form == "psm" else mid + tail + head


def text_index(docs: DataFrame) -> DataFrame:
    """A row for each distinct text: its digest, bytes, units (code points), copies and boundary list; columns as in INDEX.

    Texts are grouped by themselves, not by a hash, so that only equal ones share a row; copies are combined before the
    shuffle, so that a group of any number of them is a row a task. A null text is the empty one.
    """
    distinct = pick(docs, "text").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            lists = [boundaries(t) for t in texts]
            return {
                "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "n_bytes": [len(t) for t in texts], "n_units": [n for n, _ in lists],
                "copies": batch.column("copies"), "bounds": [b for _, b in lists],
            }

        return each

    return map_batches(distinct, make, INDEX, "text", most=2 << 20)


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, with_output: bool = False) -> DataFrame:
    """Cuts each whole text into prefix, middle and suffix at two seeded units; columns as in SCHEMA, and with_output also
    output (the transformed text).

    The index of distinct texts (text_index) is written once and joined to the documents by digest and length; a document
    reads its two cuts off its text's boundary list. Copies of a text have one list, but cuts of their own, as seeds come of
    the id. Texts meet their lists by sort and merge, so that a task holds a few texts; a group of copies is as large as its
    texts, and is split like any skewed join's.

    Null text: as empty, plain. Null id: seeded as an empty one. Repeated rows have a row each, with equal cuts. Other columns
    are left out.
    """
    index = written(text_index(docs)).withColumnRenamed("n_bytes", "bytes_there").drop("copies")
    own = pick(docs, id_column, "text").withColumnRenamed(id_column, "_id").withColumn("text", F.coalesce("text", F.lit("")))
    own = own.withColumns({"text_sha": F.sha2("text", 256), "n_bytes": F.octet_length("text").cast("long")})
    both = own.join(index.hint("merge"), (own["text_sha"] == index["text_sha256"]) & (own["n_bytes"] == index["bytes_there"]))
    both = both.select("_id", "text", "n_units", "bounds")

    def make():
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]} | {"output": []}
            for doc_id, text, n, bounds in zip(*(batch.column(c).to_pylist() for c in ("_id", "text", "n_units", "bounds")), strict=True):
                data = text.encode()
                h1, h2, h3, h4 = seeds(doc_id, seed)
                form = form_of(data, h3, h4, plain, suffix_first)
                one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = (0, 0) if form == "plain" else (boundary(bounds, n, len(data), u) for u in (one, two))
                made = joined(data, a, b, form)
                cut = (None, None) if form == "plain" else (one, two - one)
                for c, v in (("n", n), ("form", form), ("prefix_chars", cut[0]), ("middle_chars", cut[1]), ("output_sha256", sha(made)), ("restored_sha256", sha(restored(made, form))), ("output", made.decode() if with_output else None)):
                    out[c].append(v)
            return out | {"doc_id": batch.column("_id")}

        return each

    return map_batches(both, make, SCHEMA + (", output string" if with_output else ""), "text", most=2 << 20)


#: What op11 returns, as DuckDB SQL.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
f AS (
  SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
