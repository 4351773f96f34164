"""Mixing sources to target weights, by packed blocks and index permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, pick

SPACE = r"[\x20\x09-\x0D]*"

#: Words in a block; rows that one window of the packing sorts, about; slots of an output shard; slots made by one row.
BLOCK, BUCKET_ROWS, SHARD_SLOTS, CHUNK = 64, 20_000, 1 << 20, 1 << 12
#: Weights of the sources by their order, repeating; what the mix takes of all words; how often a word is taken at most.
WEIGHTS, TOTAL, EPOCHS = (3, 1, 2), 1.5, 2
SEED, MOST_BROADCAST = 42, 50_000
#: Slots that a task makes, about.
TASK_SLOTS = 1 << 19


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = EPOCHS) -> DataFrame:
    """From source and source_size (a row a source) its index k (code point order, null last) and its target.

    Targets share `total` of all sizes by weight, stop at `most` times the source's size, and what is above is shared
    among the others until none is above: the water level at which the capped and the proportional parts sum to the total.
    """
    by = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("k"), F.lit(len(weights))).cast("int"))
    ranked = sizes.withColumn("k", (F.row_number().over(by) - 1).cast("long")).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), "k")
    every = Window.partitionBy()
    # In order of the level at which they fill up: those before are full, this and the later ones share the rest.
    before = F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1))
    later = F.sum("w").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(total) * F.sum("source_size").over(every) - F.coalesce(before, F.lit(0.0))) / later
    leveled = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return leveled.select("source", "source_size", "k", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def packed(docs: DataFrame, id_column: str, block: int = BLOCK) -> DataFrame:
    """Each row's place in the blocks of its source: k, row key (bucket, at), size and the word offset where it starts.

    Running sums over a source, which may hold most rows, are taken in two steps: within buckets of bounded size, dealt by
    hash of the whole row, and over the buckets' totals.
    """
    own = Window.partitionBy("k", "bucket").orderBy(F.col(id_column).isNull(), id_column, "size", "mark")
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = docs.withColumn("at", F.row_number().over(own)).withColumn("inner", F.coalesce(F.sum("size").over(upto), F.lit(0).cast("long")))
    totals = docs.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    bases = totals.select("k", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    return inside.join(bases, ["k", "bucket"]).withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


def _round(value: Column, *salt: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value, *salt), 2)


def permuted(index: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each salt, index by index.

    Four Feistel rounds over a grid of ceil(sqrt n) columns with at least n cells, walked on from cells that n doesn't have.
    There are fewer such cells than columns, so the walk needs no more steps than that.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def step(x: Column) -> Column:
        left, right = F.pmod(x, a), F.floor(x / a).cast("long")
        for r in (1, 2):
            left = F.pmod(left + F.pmod(_round(right, F.lit(2 * r), *salt), a), a)
            right = F.pmod(right + F.pmod(_round(left, F.lit(2 * r + 1), *salt), b), b)
        return right * a + left

    first = step(index)
    return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, lambda x, _: F.when(x < n, x).otherwise(step(x))))


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Slots of each source in each output shard: k, shard, count, first (the source's slots before).

    sources has k, n_blocks and slots, the slots it should get. In a shard a source gets the whole part of its share; the
    rest of the shard's slots are drawn one by one with the fractions as probabilities: a multinomial draw with residuals,
    whose error in a source's total is a few slots a shard.
    """
    every = Window.partitionBy()
    parts = sources.withColumn("all", F.sum("slots").over(every)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("all") / shard_slots)).cast("long"))
    parts = parts.withColumn("share", F.col("slots") / F.col("shards")).withColumn("whole", F.floor("share").cast("long"))
    parts = parts.withColumn("part", F.col("share") - F.col("whole"))
    parts = parts.withColumn("upto", F.sum("part").over(Window.orderBy("k"))).withColumn("draws", F.round(F.sum("part").over(every)).cast("long"))
    parts = parts.withColumn("upto", F.col("upto") / F.greatest(F.sum("part").over(every), F.lit(1e-9)))
    ends = parts.select("k", "whole", "upto", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    drawn = parts.groupBy().agg(F.max("draws").alias("draws"), F.max("shards").alias("shards")).where("draws > 0")
    drawn = drawn.select("draws", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).select("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("draw"))
    uniform = F.shiftrightunsigned(F.xxhash64("shard", "draw", F.lit(seed)), 11) / F.lit(float(1 << 53))
    # A draw falls to the first source whose upper end isn't below it.
    points = ends.select("shard", F.col("upto").alias("x"), F.lit(1).alias("end"), "k", "whole").unionByName(drawn.select("shard", uniform.alias("x"), F.lit(0).alias("end")), allowMissingColumns=True)
    nearest = F.first("k", ignorenulls=True).over(Window.partitionBy("shard").orderBy("x", "end", F.coalesce("k", F.lit(0))).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    last = F.max("k").over(Window.partitionBy("shard"))
    counts = points.withColumn("to", F.coalesce(nearest, last)).groupBy("shard", F.when(F.col("end") == 1, F.col("k")).otherwise(F.col("to")).alias("k")).agg((F.sum(F.coalesce("whole", F.lit(0))) + F.sum(1 - F.col("end"))).alias("count"))
    before = F.sum("count").over(Window.partitionBy("k").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(before, F.lit(0).cast("long")))


def row_mark(id_column: str, known_by: tuple[str, ...]) -> Column:
    return F.xxhash64(*sorted({id_column, "text", "source", *known_by}))


def mix(docs: DataFrame, id_column: str = "doc_id", block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = EPOCHS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, known_by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Mixes documents so that sources come near their targets: (pieces, takes).

    pieces: a row for each block that a row of docs has words in: id_column, source, size, source_size, target, k, bucket
    and at (the row's key), mark (a hash of id, text, source and the columns known_by), block, from and n (its words there;
    block null for a text without words).
    takes: a row for each (k, block, epoch) that the mix takes, with shard and slot, the first place it's taken to.

    The words of a source, in the order of its packed documents, are cut into blocks of `block` words. Output shards draw
    their slots' sources (shard_counts); slot j of a source is in epoch j / n_blocks and takes the block that the source's
    permutation for that epoch has at j mod n_blocks. An epoch takes a block once, so no word is taken over `most` times.

    Null text: no words. Null source: a source of its own, the last. Repeated rows are packed each. The result depends on
    rows and seed only, not on partitions.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = pick(docs, *dict.fromkeys((id_column, "text", "source", *known_by)))
    sized = sized.select(id_column, "source", words.alias("size"), row_mark(id_column, known_by).alias("mark"))
    sized = checkpoint(sized)  # small, and read twice
    by_source = checkpoint(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    targets = source_targets(by_source.select("source", "source_size"), weights, total, most)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("long")
    targets = targets.join(by_source.select("source", "rows").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = checkpoint(targets.withColumn("n_blocks", n_blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("n_blocks")).otherwise(F.lit(0.0))).withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int")))
    # A row a source of some 100 bytes: sent to all tasks only where they are known to be few.
    n_sources, n_slots = targets.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0.0))).first()
    small = F.broadcast if n_sources <= MOST_BROADCAST else lambda df: df

    # By hash of the row and the size of its source, so that no bucket is larger than about BUCKET_ROWS.
    dealt = sized.withColumnRenamed("source", "s").join(small(targets.select("source", "k", "buckets")), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    dealt = dealt.withColumn("bucket", F.pmod("mark", "buckets").cast("int")).drop("buckets", "source")
    placed = packed(dealt, id_column, block)
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    out = placed.withColumn("block", F.explode_outer(spans))
    low, high = F.greatest(F.col("block") * block, "start"), F.least(F.col("block") * block + block, F.col("start") + F.col("size"))
    out = out.withColumn("from", low - F.col("start")).withColumn("n", F.coalesce(high - low, F.lit(0).cast("long"))).drop("start")
    out = out.join(small(targets.select("k", "source", "source_size", "target")), "k")

    counts = shard_counts(targets.select("k", "n_blocks", "slots"), shard_slots, seed).join(small(targets.select("k", "n_blocks")), "k")
    chunks = counts.where("count > 0").select("k", "n_blocks", "shard", "first", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CHUNK).cast("long"))).alias("c"))
    chunks = chunks.repartition(1 + int(n_slots // TASK_SLOTS), "k", "shard", "c")
    slots = chunks.select("k", "n_blocks", "shard", F.explode(F.sequence(F.col("first") + F.col("c"), F.col("first") + F.least(F.col("c") + CHUNK, "count") - 1)).alias("slot"))
    slots = slots.where(F.col("slot") < F.lit(most) * F.col("n_blocks")).withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks")))
    takes = slots.select("k", permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.col("k"), F.col("epoch"), F.lit(seed)).alias("block"), "epoch", "shard", "slot")
    return out, takes


def taken_words(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """A row for each row of docs: id_column, size, source_size, target, taken. Options as of mix()."""
    pieces, takes = mix(docs, id_column, **options)
    times = takes.groupBy("k", "block").agg(F.count("*").alias("times"))
    # The planner takes what comes of the few sources for small, and would send it to all tasks.
    joined = pieces.join(times.hint("merge"), ["k", "block"], "left")
    rows = joined.groupBy("k", "bucket", "at", id_column, "size", "source_size", "target").agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"))
    return rows.select(id_column, "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, with_place: bool = False, **options) -> DataFrame:
    """The mix as documents: a row for each run of words that an epoch takes of a row of documents, with its columns.

    text is the document's, where all of it is taken, or a part of it that stands there word for word, with its spaces and
    line breaks: blocks that follow one another are one run, others are rows of their own. n_chars is the text's length.
    with_place adds shard and slot, the first place that the mix gives to a block of the run. Texts without words are in no
    block and so in no mix. A word is in as many rows as it's taken times.

    Null text: in no mix. Null source: a source of its own. Repeated rows are taken each; rows that are equal in all columns
    share what they are taken for. Very long texts are split once into words, in the task that holds the row.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    to = {n: c for n, c in zip(names, docs.columns, strict=True) if c in ("doc_id", "text", "source", "n_chars")}
    plain = docs.toDF(*names).withColumnsRenamed(to)
    pieces, takes = mix(plain, "doc_id", known_by=tuple(plain.columns), **options)
    took = pieces.join(takes.select("k", "block", "epoch", F.struct("shard", "slot").alias("place")).hint("merge"), ["k", "block"]).groupBy("k", "bucket", "at", "epoch", "doc_id", "mark", "size")
    parts = F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), "n", "place")))
    took = took.agg(parts.alias("parts")).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "size", F.explode(_runs(F.col("parts"))).alias("run"))
    # Rows that are equal in all columns have one mark; each of their places in the mix needs one of them.
    own = plain.withColumn("mark", row_mark("doc_id", tuple(plain.columns)))
    first = own.withColumn("nth", F.row_number().over(Window.partitionBy("mark").orderBy("doc_id"))).where("nth = 1")
    joined = first.join(took.hint("merge"), (F.col("mark") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    words = F.regexp_extract_all("text", F.lit(SPACE + WORD), F.lit(0))  # each with the space before it
    part = F.array_join(F.slice(words, F.col("run.start").cast("int") + 1, F.col("run.n").cast("int")), "")
    joined = joined.withColumn("text", F.when(F.col("run.n") < F.col("size"), F.regexp_replace(part, "^" + SPACE, "")).otherwise(F.col("text")))
    if "n_chars" in plain.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(dict(plain.dtypes)["n_chars"]))
    place = [F.col("run.place.shard").alias("shard"), F.col("run.place.slot").alias("slot")] if with_place else []
    return joined.select(*plain.columns, *place).toDF(*docs.columns, *(["shard", "slot"] if with_place else []))


def _runs(parts: Column) -> Column:
    """Sorted parts (start, n, place) with those that follow one another made one: its n is their sum, its place the least."""
    none = F.slice(parts, 1, 0)

    def add(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        more = F.struct(last["start"].alias("start"), (last["n"] + p["n"]).alias("n"), F.least(last["place"], p["place"]).alias("place"))
        follows = F.coalesce(last["start"] + last["n"] == p["start"], F.lit(False))
        return F.when(follows, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(parts, none, add)
