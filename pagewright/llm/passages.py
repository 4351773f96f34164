"""Substring dedup: MinHash banding over paragraphs, exact verification, and clusters of removals by components."""

from __future__ import annotations

from functools import cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, discard, map_batches, pick, written
from .components import components

#: Paragraphs are lines of so many words and more. Words of a shingle, least Jaccard similarity, and the bands: of BANDS
#: bands of ROWS minima each, two lines of similarity 0.8 share one with a probability of 1 - (1 - 0.8 ** 2) ** 5 = 0.994.
LINE, SHINGLE, SIMILAR, BANDS, ROWS = 16, 5, 0.8, 5, 2
#: Equal runs of words amid lines: windows of WINDOW words begin at the least word hash of each AMONG words in a row, so a
#: run of WINDOW + AMONG - 1 = 50 words and more has a window wherever it stands, and no run of less than 34 words has one.
WINDOW, AMONG = 34, 17
#: Lines that are compared with others at once, and the shingles in most lines that are known to be common. Both are for
#: speed only: results don't depend on them.
GROUP, COMMON = 64, 1 << 16
#: Words of a stretch of a document, by which windows meet removed lines.
STRETCH = 64

KEYS = tuple(f"b{k}" for k in range(BANDS))
UNITS = f"_id long, line boolean, start int, n int, content long, check int, {', '.join(f'{k} long' for k in KEYS)}, grams array<int>"
SKETCH = tuple(f"s{k}" for k in range(4))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def salts(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each start and end, by sums over powers of an odd number."""
    power = np.cumprod(np.full(len(values) + 1, _MIX, np.uint64)) * np.uint64(3)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
        inverse = np.uint64(pow(int(_MIX), -1, 1 << 64))
        back = np.cumprod(np.full(len(values) + 1, inverse, np.uint64))
        return mixed((sums[ends] - sums[starts]) * back[starts] + mixed((ends - starts).astype(np.uint64)))


def window_starts(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW, among: int = AMONG) -> np.ndarray:
    """Where windows begin: at the (first) least hash of each `among` words in a row of one document, if `window` words of it
    follow from there. doc has each word's document; the words of a document stand together."""
    n = len(hashes) - among + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, among):
        better = hashes[k : k + n] < least
        least[better] = hashes[k : k + n][better]
        at[better] = np.flatnonzero(better) + k
    found = np.zeros(len(hashes), bool)
    found[at[doc[:n] == doc[among - 1 :]]] = True
    starts = np.flatnonzero(found)
    starts = starts[starts <= len(doc) - window]
    return starts[doc[starts] == doc[starts + window - 1]]


def units(texts: list[str | None], line: int = LINE, window: int = WINDOW, among: int = AMONG) -> dict[str, np.ndarray]:
    """Windows, then lines of `line` words and more, of all texts together: of each the text's place in the list, start and n
    (words, counted from the text's first), content and check (96 bits of hash of its words), and of lines their band keys
    (BANDS, lines) and different shingles in order (grams, of which line k has those from ends[k] to ends[k + 1]).

    Words are in lower case (A-Z).
    """
    from xxhash import xxh64_intdigest

    words: list[bytes] = []
    sizes: list[int] = []
    owner: list[int] = []
    first = [0]
    for k, text in enumerate(texts):
        for x in (text or "").encode().translate(ASCII_LOWER).split(b"\n") if text else ():
            x = x.split()
            words += x
            sizes.append(len(x))
            owner.append(k)
        first.append(len(words))
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    del words
    first = np.array(first)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    again = mixed(hashes ^ salts(1)[0])
    begin = window_starts(hashes, doc, window, among)
    ends = np.cumsum(np.array(sizes, np.int64))
    keep = np.flatnonzero(np.array(sizes, np.int64) >= max(line, SHINGLE))
    low, high = (ends - np.array(sizes, np.int64))[keep], ends[keep]
    starts, stops = np.concatenate([begin, low]), np.concatenate([begin + window, high])
    content, check = runs(hashes, starts, stops), runs(again, starts, stops) >> np.uint64(32)
    # Equal windows that overlap, as in a run of one word, are one.
    w = len(begin)
    same = np.flatnonzero((content[1:w] == content[: max(w - 1, 0)]) & (check[1:w] == check[: max(w - 1, 0)]) & (doc[begin[1:]] == doc[begin[:-1]]) & (np.diff(begin) < window)) + 1
    once = np.delete(np.arange(len(starts)), same)
    after = np.append(once[1:], len(starts))
    stops = np.where(once < w, stops[np.minimum(after, w) - 1] if w else 0, stops[once])
    starts, content, check = starts[once], content[once], check[once]
    owners = np.concatenate([doc[begin], np.array(owner, np.int64)[keep]])[once]
    out = {"text": owners, "n": (stops - starts).astype(np.int32), "windows": w - len(same), "content": content.view(np.int64), "check": check.astype(np.uint32).view(np.int32)}
    out["start"] = (starts - first[out["text"]]).astype(np.int32)
    if not len(keep):
        return out | {"keys": np.zeros((BANDS, 0), np.int64), "grams": np.zeros(0, np.int32), "ends": np.zeros(1, np.int32)}
    grams = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        grams = mixed(grams * _MIX + hashes[k : k + len(grams)])
    count = high - low - SHINGLE + 1
    at = np.concatenate([[0], np.cumsum(count)])
    inside = grams[np.repeat(low - at[:-1], count) + np.arange(at[-1])]
    keys = np.zeros((BANDS, len(keep)), np.uint64)
    for b in range(BANDS):
        keys[b] = b + 1
        for salt in salts(BANDS * ROWS)[b * ROWS : (b + 1) * ROWS]:
            keys[b] = mixed(keys[b] * _MIX + np.minimum.reduceat(mixed(inside ^ salt), at[:-1]))
    # By line, then by the upper 32 bits of the shingle's hash, each once.
    sorted_ = np.sort(np.repeat(np.arange(len(keep), dtype=np.uint64) << np.uint64(32), count) | inside >> np.uint64(32))
    once = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    held = np.bincount((sorted_[once] >> np.uint64(32)).astype(np.int64), minlength=len(keep))
    return out | {"keys": keys.view(np.int64), "grams": sorted_[once].astype(np.uint32).view(np.int32), "ends": np.concatenate([[0], np.cumsum(held)]).astype(np.int32)}


def unit_rows(docs: DataFrame, id_column: str = "doc_id", line: int = LINE, window: int = WINDOW, among: int = AMONG) -> DataFrame:
    """units() of the rows of docs that have an id: a row each, windows without keys and shingles."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            u = units(batch.column("text").to_pylist(), line, window, among)
            n, is_line = len(u["n"]), np.arange(len(u["n"])) >= u["windows"]
            padded = lambda x: pa.array(np.concatenate([np.zeros(u["windows"], x.dtype), x]), mask=~is_line)
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n + 1 - len(u["ends"]), np.int32), u["ends"]])), pa.array(u["grams"]))
            ids = batch.column(id_column).cast(pa.int64()).to_numpy(zero_copy_only=False)[u["text"]]
            return {"_id": pa.array(ids, pa.int64()), "line": pa.array(is_line), **{c: pa.array(u[c]) for c in ("start", "n", "content", "check")}, **{k: padded(u["keys"][b]) for b, k in enumerate(KEYS)}, "grams": grams}

        return each

    known = pick(docs, id_column, "text").where(F.col(id_column).isNotNull() & F.col("text").isNotNull())
    return map_batches(known, make, UNITS, "text", most=1 << 20)


def unique_lines(lines: DataFrame) -> DataFrame:
    """A row for each different line: content, low and high (smallest and largest id), rows (occurrences) and band keys.

    Lines that differ and have one content (a collision of 64 bits, which check tells) are left out.
    """
    every = lines.groupBy("content").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("*").alias("rows"), F.min("check").alias("_least"), F.max("check").alias("_most"), *[F.max(k).alias(k) for k in KEYS])
    return every.where("_least = _most").drop("_least", "_most")


def similar(p: str, q: str, least: float) -> Column:
    n, m, common = F.size(p), F.size(q), F.size(F.array_intersect(p, q))
    return F.when(F.least(n, m) >= least * F.greatest(n, m), common >= least * (n + m - common)).otherwise(False)


def prefixes(sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """content, part, gram, n, SKETCH, before: of each of sets (content, part, grams) its first n - ceil(least * n) + 1
    shingles, in the order of their values with the common ones last: the COMMON shingles that stand in most sets, all that
    is sent to the workers. n is the set's size; of the sketch's 256 bits those of its shingles' values modulo 256 are set;
    before has the shingles that come before this one."""
    held = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1").orderBy(F.desc("sets"), "gram").limit(COMMON)
    sent = sets.sparkSession.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in held.select("gram").collect()], np.int32)))

    def make():
        common = sent.value

        def each(batch: pa.RecordBatch) -> dict:
            grams = batch.column("grams")
            ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
            flat, n = flat[ends[0] : ends[-1]], np.diff(ends)
            at = np.searchsorted(common, flat)
            late = common[np.minimum(at, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), bool)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, late, owner))
            rank = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
            first = order[rank < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)]
            bits = np.zeros((len(n), 256), np.uint8)
            bits[owner, flat & 255] = 1
            sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            of = owner[first]
            # Row k of a set has the k shingles before it.
            place = rank[rank < np.repeat(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, n)]
            ends = np.concatenate([[0], np.cumsum(place)])
            held = flat[first][np.repeat(np.arange(len(place)) - place, place) + np.arange(ends[-1]) - np.repeat(ends[:-1], place)]
            before = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(held))
            return {"content": batch.column("content").take(pa.array(of)), "part": batch.column("part").take(pa.array(of)), "gram": pa.array(flat[first]), "n": pa.array(n[of].astype(np.int32)), **{c: pa.array(sketch[of, k]) for k, c in enumerate(SKETCH)}, "before": before}

        return each

    return map_batches(sets.select("content", "part", "grams"), make, f"content long, part long, gram int, n int, {', '.join(f'{c} long' for c in SKETCH)}, before array<int>", None)


def far_links(sets: DataFrame, least: float = SIMILAR, group: int = GROUP) -> DataFrame:
    """Links a < b between similar contents of different parts in sets (content, part, grams): all of them.

    Two sets of a similarity of at least `least` share one of their first n - ceil(least * n) + 1 shingles in any order that
    holds for all; here common shingles come last. Contents meet at those. At a shingle they are dealt into blocks of about
    `group` by hash, a part with more than `group` of them into blocks of its own, and all blocks but those of one part are
    compared with each other, by sketches of 256 bits that similar sets can't differ much in. What passes, which are links but
    for few, is verified by all shingles.
    """
    at = written(prefixes(sets, least))
    counts = at.groupBy("gram", "part").agg(F.count("*").alias("sets"))
    small = F.when(F.col("sets") <= group, F.col("sets")).otherwise(0)
    shared = counts.groupBy("gram").agg(F.sum(small).alias("pool"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").drop("lo", "hi")
    # own: the part that a block belongs to whole, null for blocks of many parts.
    dealt = at.join(counts, ["gram", "part"]).join(shared, "gram").withColumn("own", F.when(F.col("sets") > group, F.col("part")))
    deal = lambda many: F.pmod(F.xxhash64("content"), F.greatest(F.lit(1), F.ceil(many / group)).cast("long"))
    k = F.when(F.col("own").isNull(), deal(F.col("pool"))).otherwise(deal(F.col("sets")))
    placed = written(dealt.withColumn("block", F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), k)).select("gram", "block", "own", "content", "part", "n", *SKETCH, "before"))
    discard(at)
    blocks = placed.groupBy("gram", "block").agg(F.min("own").alias("own"))
    others = blocks.select(F.col("gram").alias("g2"), F.col("block").alias("block2"), F.col("own").alias("own2"))
    pairs = blocks.join(others, (F.col("gram") == F.col("g2")) & (F.col("block") <= F.col("block2")) & F.coalesce(F.col("own") != F.col("own2"), F.lit(True))).select("gram", "block", "block2")
    left = placed.join(pairs, ["gram", "block"])
    right = placed.select(F.col("gram").alias("g2"), F.col("block").alias("own2"), F.col("content").alias("y"), F.col("part").alias("part_y"), F.col("n").alias("m"), F.col("before").alias("before_y"), *[F.col(c).alias(f"{c}y") for c in SKETCH])
    once = (F.col("block") != F.col("block2")) | (F.col("content") < F.col("y"))
    # A bit that one sketch has and the other hasn't is a shingle that one set has alone, of which similar sets have few.
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}y"))) for c in SKETCH])
    may_be = (differ * (1 + least) <= (F.col("n") + F.col("m")) * (1 - least) + 1e-6) & (F.least("n", "m") >= least * F.greatest("n", "m"))
    # Sets that share an earlier shingle meet there.
    met = left.join(right, (F.col("gram") == F.col("g2")) & (F.col("block2") == F.col("own2")) & (F.col("part") != F.col("part_y")) & once & may_be & ~F.arrays_overlap("before", "before_y"))
    met = met.select(F.least("content", "y").alias("a"), F.greatest("content", "y").alias("b"), F.least("part", "part_y").alias("part_a"), F.greatest("part", "part_y").alias("part_b"))
    grams = lambda c, g: sets.select(F.col("content").alias(c), F.col("grams").alias(g))
    found = written(met.join(grams("a", "p"), "a").join(grams("b", "q"), "b").where(similar("p", "q", least)).select("a", "b", "part_a", "part_b"))
    discard(placed)
    return found


def line_clusters(lines: DataFrame, unique: DataFrame, least: float = SIMILAR, group: int = GROUP) -> DataFrame:
    """content, cluster for contents of lines that are linked to others: the components of all pairs that share a band and
    have a Jaccard similarity of at least `least`; cluster is one of the component's contents.

    lines: content and grams, a row for each occurrence; unique: unique_lines() of them. Equal lines are one content from the
    start. In a band each content is first compared with the band's most frequent one, which joins most groups of copies
    whole, whatever their size. Bands that this leaves in several parts go on to far_links(), which compares all pairs of
    them that can be similar. Shingles are fetched for contents that share a band only.
    """
    banded = unique.select("content", "rows", F.explode(F.array(*KEYS)).alias("band"))
    tops = banded.groupBy("band").agg(F.max("rows").alias("most"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi").select("band", "most")
    members = written(banded.join(tops, "band"))
    hubs = members.where("rows = most").groupBy("band").agg(F.min("content").alias("hub"))
    sets = written(lines.join(members.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.any_value("grams").alias("grams")))
    spokes = members.join(hubs, "band").where("content != hub").select(F.least("content", "hub").alias("a"), F.greatest("content", "hub").alias("b")).distinct()
    grams = lambda c, g: sets.select(F.col("content").alias(c), F.col("grams").alias(g))
    near = spokes.join(grams("a", "p"), "a").join(grams("b", "q"), "b").where(similar("p", "q", least)).select("a", "b")
    parts = components(near)
    of = members.select("content", "band").join(parts.withColumnRenamed("node", "content"), "content", "left").withColumn("part", F.coalesce("component", "content")).drop("component")
    of = written(of)
    parted = of.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band")
    crowded = of.join(parted, "band").select("content", "part").distinct()
    crowded = written(crowded.join(sets, "content"))
    discard(sets, members)
    links = far_links(crowded, least, group)
    discard(crowded)
    over = components(links, "part_a", "part_b").select(F.col("node").alias("part"), F.col("component").alias("whole"))
    found = of.select("content", "part").distinct().join(over, "part", "left")
    found = written(found.select("content", F.coalesce("whole", "part").alias("cluster")))
    discard(of, links)
    return found


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", least: float = SIMILAR, line: int = LINE, window: int = WINDOW, among: int = AMONG, group: int = GROUP) -> DataFrame:
    """A row for each place where a document has a passage that another document has too.

    kind `line`: a line of `line` words and more that equals or is similar to (Jaccard of 5-word shingles) a line of another
    document, by clusters of links. kind `run`: overlapping windows of `window` words, amid lines or over several, that stand
    word by word in the document cluster_doc. Words in a row that two documents have are found wherever they stand from
    window + among - 1 (50) on, and never below `window` (34); up to among - 1 of them at each end may be left over. Words
    are compared in lower case (A-Z), by 96 bits of hash.

    Returns id_column, kind, start and n (words), cluster (one of a line's cluster's content hashes; the run's first
    window's), cluster_doc and removed: true but for cluster_doc's own places. cluster_doc is the smallest id among the
    documents that have the passage: of a line's cluster, or of each of a run's windows. Windows that meet a removed line are
    out of that, as they're gone; so each window that is removed stands in a document of a smaller id, and of no words the
    last copy is removed. The similarity of lines is that of the upper 32 bits of their shingles' hashes.

    Null or short text: no rows. Null id: left out. Repeated rows with one id are one document and have their places once.
    Other columns are left out. All units are written once to the shared checkpoint folder; counts are pre-aggregated.
    """
    every = written(unit_rows(docs, id_column, line, window, among))
    lines = every.where("line")
    unique = written(unique_lines(lines))
    found = line_clusters(lines.select("content", "grams"), unique, least, group)
    of_lines = unique.select("content", "low", "high").join(found, "content", "left").withColumn("cluster", F.coalesce("cluster", "content"))
    clusters = of_lines.groupBy("cluster").agg(F.min("low").alias("cluster_doc"), F.max("high").alias("high")).where("cluster_doc < high").drop("high")
    line_of = written(of_lines.select("content", "cluster").join(clusters, "cluster"))
    discard(unique, found)
    places = written(lines.select("_id", "start", "n", "content").join(line_of, "content").select("_id", F.lit("line").alias("kind"), "start", "n", "cluster", "cluster_doc").distinct())
    discard(line_of)

    windows = every.where("not line")
    twice = windows.groupBy("content").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("lo < hi").select("content")
    met = windows.select("_id", "start", "n", "content", "check").join(twice, "content").withColumn("stretch", F.floor(F.col("start") / STRETCH))
    # A window is looked for by the stretch of words that it begins in. One of several equal windows goes with its first.
    gone = places.where(F.col("_id") != F.col("cluster_doc")).select(F.col("_id").alias("id2"), F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to"))
    gone = gone.withColumn("stretch2", F.explode(F.sequence(F.floor(F.greatest(F.col("from") - window + 1, F.lit(0)) / STRETCH), F.floor((F.col("to") - 1) / STRETCH))))
    overlap = (F.col("_id") == F.col("id2")) & (F.col("stretch") == F.col("stretch2")) & (F.col("start") < F.col("to")) & (F.col("start") + window > F.col("from"))
    left = written(met.join(gone, overlap, "left_anti"))
    keepers = left.groupBy("content", "check").agg(F.min("_id").alias("cluster_doc"), F.max("_id").alias("hi")).where("cluster_doc < hi").drop("hi")
    by = Window.partitionBy("_id", "cluster_doc").orderBy("start")
    ended = F.max(F.col("start") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = left.join(keepers, ["content", "check"]).withColumn("apart", F.coalesce((F.col("start") >= ended).cast("int"), F.lit(0))).withColumn("island", F.sum("apart").over(by))
    joined = islands.groupBy("_id", "cluster_doc", "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("int").alias("n"), F.min_by("content", "start").alias("cluster"))
    passages = joined.select("_id", F.lit("run").alias("kind"), "start", "n", "cluster", "cluster_doc")
    return places.unionByName(passages).select(F.col("_id").alias(id_column), "kind", "start", "n", "cluster", "cluster_doc", (F.col("_id") != F.col("cluster_doc")).alias("removed"))
