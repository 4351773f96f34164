"""Filter interaction audit: all orders of some filters as paths of one trie whose unordered prefixes are shared."""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import map_batches, pick, written

FILTERS = "ABCDE"
UPPER_BYTES, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Least number of words, least percentage of distinct ones, most percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2

SIGNS = "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (whether the document fails that filter), good and toxic: a row for each row of documents.

    A to D look at the text; E asks for the smallest doc_id of an identical text in the whole table, by the texts' SHA-256:
    only groups with two ids and more are joined back. Null text: as empty. Null source: the empty part. A row without
    doc_id never fails E, nor makes others fail. Labels: 1 in any row of the document; none: neither good nor toxic.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("digest", "A", "B", "C", "D")}
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                words = data.split()
                capitals = len(data) - len(data.translate(None, UPPER_BYTES))
                for c, v in (
                    ("digest", hashlib.sha256(data).digest()), ("A", len(words) < LEAST_WORDS), ("B", 100 * len(set(words)) < LEAST_DISTINCT * len(words)),
                    ("C", 100 * capitals > MOST_CAPITALS * len(text or "")), ("D", len(data.translate(None, MARKS)) < len(data)),
                ):
                    out[c].append(v)
            return out | {"doc_id": batch.column("doc_id"), "part": batch.column("part")}

        return each

    rows = pick(docs, "doc_id", "text", "source").withColumn("part", F.coalesce("source", F.lit(""))).drop("source")
    signs = written(map_batches(rows, make, SIGNS, "text"))
    first = signs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    first = written(first, tidy=False)  # a table of its own, so that the join can split a text that very many rows have
    marks = pick(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = written(marks, tidy=False)
    found = signs.join(first.hint("merge"), "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    found = found.join(marks.hint("merge"), "doc_id", "left")
    return found.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def explored(failing: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts at every edge of the trie: part, state (bits of the filters applied before), filter, n (documents of the part
    before the edge), removed, good_lost, toxic_lost. A part that has no document left in a state has no row there.

    Filters are applied depth first, each to the persisted survivors of its parent. What survives a set of filters doesn't
    depend on their order, so a state is entered on the first path that reaches it and remembered for all the others; one
    pass over its survivors fills its cache and counts the removals of all filters that may come next. A state is released
    when all below it is done: at most one path of the trie is held at a time, on disk where memory ends, and rebuilt from
    `failing` where an executor is lost.
    """
    counted: dict[int, DataFrame] = {}

    def edges(survivors: DataFrame, state: int) -> DataFrame:
        left = [f for k, f in enumerate(filters) if not state >> k & 1]
        lost = lambda f, *also: F.count_if(F.expr(" AND ".join(f"`{c}`" for c in (f, *also))))
        sums = [F.struct(F.lit(f).alias("filter"), lost(f).alias("removed"), lost(f, "good").alias("good_lost"), lost(f, "toxic").alias("toxic_lost")) for f in left]
        if not left:
            return survivors.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(state).alias("state"), F.lit(None).cast("string").alias("filter"), "n", *[F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost")])
        return survivors.groupBy("part").agg(F.count("*").alias("n"), F.array(*sums).alias("to")).select("part", F.lit(state).alias("state"), "n", F.inline("to")).select("part", "state", "filter", "n", "removed", "good_lost", "toxic_lost")

    def enter(survivors: DataFrame, state: int) -> None:
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counted[state] = written(edges(held, state), tidy=False)
            for k, f in enumerate(filters):
                below = state | 1 << k
                if below not in counted:
                    enter(held.where(~F.col(f)).drop(f), below)
        finally:
            held.unpersist()

    enter(failing, 0)
    out = None
    for df in counted.values():
        out = df if out is None else out.unionByName(df)
    return out


def filter_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters removes at each step of all 120 orders, a row for each part, order and step.

    part, filter_order, step (1 to 5), kept (after the step), removed (there), redundant (failing the step's filter, removed
    earlier), unique_fails (failing that filter only), good_lost and toxic_lost (removed there, labelled so), shapley (what
    the filter removes, summed over all orders). Redundant and unique failures are read off the trie: what a filter removes
    first, and after all others. Zeros are rows, too. Nulls, repeated rows and labels: see failures(). No rows: no parts.
    """
    spark = docs.sparkSession
    failing = written(failures(docs, labels))
    found = written(explored(failing))
    names = list(FILTERS)
    every = found.where("state = 0").select("part").distinct().select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s in range(32) for k, f in enumerate(names) if not s >> k & 1])).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    whole = every.select("part", "x.*").join(found.where("filter IS NOT NULL"), ["part", "state", "filter"], "left").select("part", "state", "filter", *[zero(c) for c in ("n", "removed", "good_lost", "toxic_lost")])

    own = Window.partitionBy("part", "filter")
    before = F.aggregate(F.array(*[F.lit(1 << k) for k in range(5)]), F.lit(0), lambda a, b: a + F.when(F.col("state").bitwiseAND(b) > 0, 1).otherwise(0))
    orders = _by(before, lambda k: factorial(k) * factorial(4 - k))  # orders that pass through a state to this filter
    whole = whole.withColumns({
        "shapley": F.sum(F.col("removed") * orders).over(own), "all": F.max(F.when(F.col("state") == 0, F.col("removed"))).over(own),
        "unique_fails": F.max(F.when(_by(before, lambda k: k) == 4, F.col("removed"))).over(own),
    })
    steps = spark.createDataFrame([("".join(p), k + 1, sum(1 << names.index(x) for x in p[:k]), f) for p in permutations(names) for k, f in enumerate(p)], "filter_order string, step int, state int, filter string")
    paths = whole.join(F.broadcast(steps), ["state", "filter"])  # 600 rows, always
    return paths.select("part", "filter_order", "step", (F.col("n") - F.col("removed")).alias("kept"), "removed", (F.col("all") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("long").alias("shapley"))


def _by(count: Column, f) -> Column:
    """f of a count from 0 to 4."""
    return F.element_at(F.array(*[F.lit(f(k)) for k in range(5)]), (count + 1).cast("int"))


#: What op13 returns, as DuckDB SQL: documents are classed by the filters they fail, and every order is applied to the classes.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, string_split_regex(trim(text, E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN (trim(text, E' \t\n\x0b\x0c\r') = '' OR len(words) < 200) THEN 'A' ELSE '' END
    || CASE WHEN trim(text, E' \t\n\x0b\x0c\r') <> '' AND 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN m USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS x, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
p AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS alone, before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM c, s),
r AS (
  SELECT part, filter_order, step, x, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant,
    sum(n) FILTER (alone) AS unique_fails, sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost FROM p GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""
