"""SimHash near-duplicates: fingerprints, and links between them by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, checkpoint, map_batches, pick, written
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it; shingles of words in lower case (A-Z), repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*[words[k : n + k] for k in range(shingle)]))
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    votes, part = np.zeros(64, np.int64), 1 << 14
    for k in range(0, len(hashes), part):
        votes += np.unpackbits(hashes[k : k + part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_column, fp (the fingerprint's bits as a long) and the columns in carry, a row for each row of docs."""
    rows = pick(docs, *dict.fromkeys((id_column, "text", *carry)))
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields) if carry else ""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            return {c: batch.column(c) for c in carry} | {"_id": batch.column(id_column), "_fp": pa.array(fps)}

        return each

    return map_batches(rows, make, "_id long, _fp long" + fields, "text")


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs a < b of different fingerprints in fp (a row each) that differ in at most `distance` (0 to 3) bits.

    Multi-index hashing over two segments of 32 bits: of at most 3 differing bits one segment has at most 1, so that every
    pair meets where one fingerprint's segment is in the ball of 33 values around the other's. A segment's value is shared
    by near fingerprints and few others up to some 2**32 of them; complete distances are verified in the join itself.
    """
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)]
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), h.alias("value")) for k, h in enumerate(half)])).alias("x")).select(F.col("fp").alias("a"), "x.*")
    probes = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), h.alias("value")) for k, h in enumerate(half)])).alias("x")).select("fp", "x.seg", "x.value", F.explode(flips).alias("flip"))
    probes = probes.select(F.col("fp").alias("b"), "seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") < F.col("b"))
    return table.join(probes, (table["seg"] == probes["seg"]) & (table["value"] == probes["value"]) & near).select("a", "b").distinct()


def grouped(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """From _id and _fp a row for each different fingerprint: fp, component (a long), least (its smallest id) and
    component_id (the component's smallest id)."""
    nodes = checkpoint(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least")))
    found = components(near_links(nodes.select("fp"), distance))
    owned = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    return owned.join(ids, "component")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """id_column, fingerprint (16 hex digits) and component_id, a row for each row of docs.

    Fingerprints that differ in at most `distance` bits are linked; component_id is the smallest id reachable. Copies are
    one fingerprint from the start, so a group of copies of any size is one node; only different fingerprints are probed,
    linked and joined into components.

    Null or empty text: fingerprint 0, linked like any other. Null id: kept, and the smallest only where all are null.
    Repeated rows are listed each. Other columns are left out.
    """
    marked = checkpoint(fingerprints(docs, id_column))
    ids = grouped(marked, distance).select("fp", "component_id")
    return marked.join(ids, F.col("_fp") == F.col("fp")).select(F.col("_id").alias(id_column), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_each(docs: DataFrame) -> DataFrame:
    """documents with one row of each group of near-duplicates, that of the smallest doc_id; all columns stay as they are.

    Of repeated rows with that doc_id and fingerprint one stays. Rows without doc_id stay only where a group has no other.
    Null and empty texts are one group; very long ones are hashed whole. Names of other columns may clash.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    names = {at["doc_id"]: "doc_id", at["text"]: "text"}
    # Written with its fingerprints: texts are hashed once.
    marked = written(fingerprints(plain.withColumnsRenamed(names), carry=tuple(names.get(c, c) for c in plain.columns)))
    first = grouped(marked.select("_id", "_fp")).groupBy("component").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("x"))
    key = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c), F.lit(0).cast("long")))
    first = first.select(F.col("x.fp").alias("k0"), *[v.alias(f"k{n + 1}") for n, v in enumerate(key("x.least"))])
    missing, value = key("_id")
    keyed = marked.withColumns({"k0": F.col("_fp"), "k1": missing, "k2": value})
    rest = [c for c in marked.columns if c not in ("_id", "_fp")]
    once = Window.partitionBy("k0", "k1", "k2").orderBy(F.xxhash64(*rest))
    return keyed.join(first, ["k0", "k1", "k2"]).withColumn("k3", F.row_number().over(once)).where("k3 = 1").select(*rest).toDF(*docs.columns)
