"""Best-fit packing of token sequences by a grouping genetic algorithm on islands, with migration of elites."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import map_batches, pick, written

CAPACITY, END = 2048, 0
#: Pieces that one problem packs, about; islands of a problem, their individuals, and generations between two migrations.
PROBLEM, ISLANDS, INDIVIDUALS, EPOCHS, GENERATIONS = 16384, 3, 3, 3, 6
#: A crossover injects about this share of the bins, chosen among the fuller half; bins with more free room than this share
#: of the capacity go back to the pool, as long as it's larger than a problem and shrinks, for so many levels at most.
INJECTED, ROOM, LEVELS = 0.05, 1 / 256, 6
#: Bytes of words that a worker remembers, and the longest among them.
REMEMBERED, LONGEST = 160 << 20, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """Token ids of words as little-endian 32-bit integers, asked of the tokenizer once and remembered for a while.

    The vocabulary drops white space and no piece of text crosses it, so a text's ids are those of its words in turn; words
    end at spaces and U+0009 to U+000D, other white space within them is left to the tokenizer. Letters and a mark behind
    them are pieces of their own, and capitals mean nothing. What was used since the memory was last half full is kept.
    """

    #: A word of Latin letters, and the mark behind it; both are pieces that the vocabulary's model takes as they are, in the
    #: letters that stand for bytes.
    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): letter for letter, b in byte_letters().items()})
        self.held, self.old = 0, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._asked(word)
        if len(word) <= LONGEST:
            self.held += len(ids) + len(word) + 150
            self[word] = ids
        return ids

    def _asked(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # of ASCII
            return array("I", [t.id for t in self.model(word.decode())]).tobytes()
        text = word.decode()
        plain = self.PLAIN.fullmatch(text)
        if not plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if plain[2]:
            return self[plain[1].lower().encode()] + self[plain[2].encode()]
        if (low := text.lower()) != text:
            return self[low.encode()]
        return array("I", [t.id for t in self.model(word.decode("latin-1").translate(self.letters))]).tobytes()

    def encode(self, data: bytes) -> bytes:
        if self.held > REMEMBERED // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, data.split()))


_LOADED: dict[str, Words] = {}


def words(path: str | None) -> Words:
    """Loaded once in a process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, id_column: str = "doc_id", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of at most `capacity` tokens that each whole text and its end token are cut to; columns as in PIECES.

    The vocabulary file must be at `path` on every worker (default: the installed public one). Null text: the end token only.
    """

    def make():
        encode, end = words(path).encode, END.to_bytes(4, "little")

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            for doc_id, text in zip(batch.column(id_column).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode((text or "").encode()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[c].append(v)
            return out

        return each

    return map_batches(pick(docs, id_column, "text"), make, PIECES, "text", most=2 << 20)


class Packing:
    """Bins of pieces by number, and the open bins by free room: the best fit for a size is the lowest set bit from it on."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity, self.bins = sizes, capacity, []
        self.at: dict[int, list[int]] = {}
        self.mask = 0
        for members in bins:
            self.bins.append(members)
            self._open(len(self.bins) - 1, capacity - sum(map(sizes.__getitem__, members)))

    def _open(self, k: int, room: int) -> None:
        if room:
            self.at.setdefault(room, []).append(k)
            self.mask |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        """Puts each item, the largest first, where it leaves least room, or into a bin of its own."""
        sizes, at = self.sizes, self.at
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[i]
            if fits := self.mask >> size:
                room = size + (fits & -fits).bit_length() - 1
                stack = at[room]
                k = stack.pop()
                if not stack:
                    self.mask ^= 1 << room
                self.bins[k].append(i)
                self._open(k, room - size)
            else:
                self.bins.append([i])
                self._open(len(self.bins) - 1, self.capacity - size)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins, then fuller ones: the sum of squares of what is left free."""
        return -len(self.bins), sum(len(ks) * room * room for room, ks in self.at.items())


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer: by the sum, and by the pieces of over half a bin, none of which fits another."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def crossed(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator, share: float = INJECTED) -> Packing:
    """Bins of b, whole and among its fuller half, injected into a; a's bins that hold one of their pieces are taken apart, so
    that no piece is there twice, and what is displaced is placed by best fit. So are some of a's emptiest bins."""
    fill = np.array([sum(map(sizes.__getitem__, m)) for m in b])
    fuller = np.argsort(-fill, kind="stable")[: max(1, len(b) // 2)]
    taken = [b[k] for k in rng.permutation(fuller)[: max(1, int(share * len(b)))]]
    within = {i for m in taken for i in m}
    kept, displaced = [], []
    for m in a:
        if within.isdisjoint(m):
            kept.append(m)
        else:
            displaced += [i for i in m if i not in within]
    rooms = np.array([capacity - sum(map(sizes.__getitem__, m)) for m in kept] or [0])
    worst = set(np.argsort(-rooms, kind="stable")[: max(1, int(share * len(kept)))].tolist()) if kept else set()
    worst = {k for k in worst if rooms[k] and rng.random() < 0.7}
    for k in worst:
        displaced += kept[k]
    child = Packing(sizes, capacity, [list(m) for k, m in enumerate(kept) if k not in worst] + [list(m) for m in taken])
    child.best_fit(displaced)
    return child


def as_bins(chromosome: list[int]) -> list[list[int]]:
    """Pieces by bin, from the bin of each piece."""
    bins: list[list[int]] = [[] for _ in range(max(chromosome, default=-1) + 1)]
    for i, k in enumerate(chromosome):
        bins[k].append(i)
    return bins


def as_chromosome(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, m in enumerate(bins):
        for i in m:
            out[i] = k
    return out


def evolved(sizes: list[int], population: list[list[int]], capacity: int, individuals: int, generations: int, seed: int) -> list[list[int]]:
    """The population after some generations, the fittest first. An empty one begins with best fit decreasing, and with best
    fits of shuffled pieces. It ends early when the fittest needs no more bins than any packing must."""
    rng = np.random.default_rng(seed)
    n, least = len(sizes), least_bins(sizes, capacity)
    alive = [Packing(sizes, capacity, as_bins(c)) for c in population]
    if not alive:
        alive = [Packing(sizes, capacity)]
        alive[0].best_fit(list(range(n)))
    while len(alive) < individuals and -alive[0].fitness()[0] > least:
        # Another start: some random bins first, the rest by best fit.
        other = Packing(sizes, capacity)
        order = rng.permutation(n).tolist()
        for k in range(0, n // 4, 64):
            other.best_fit(order[k : k + 64])
        other.best_fit(order[len(range(0, n // 4, 64)) * 64 :])
        alive.append(other)
    alive.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations):
        if -alive[0].fitness()[0] <= least or len(alive) < 2:
            break
        one, two = rng.permutation(len(alive))[:2].tolist()
        one, two = min(one, two), max(one, two)  # into the fitter one
        for x, y in ((one, two), (0, 0)):
            alive.append(crossed(alive[x].bins, alive[y].bins, sizes, capacity, rng))
        alive.sort(key=Packing.fitness, reverse=True)
        del alive[individuals:]
    return [as_chromosome(p.bins, n) for p in alive]


STATE = "problem long, island int, capacity int, sizes array<int>, population array<array<int>>"


def epoch(state: DataFrame, individuals: int, generations: int, seed: int, kept: int | None = None) -> DataFrame:
    """One epoch of every island, each on its own; the rows of `state` with the population evolved, best first, and its bins."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            rows = batch.to_pylist()
            made = [evolved(r["sizes"], r["population"], r["capacity"], individuals, generations, hash((r["problem"], r["island"], seed)) & 0x7FFFFFFF)[:kept] for r in rows]
            return {c: batch.column(c) for c in ("problem", "island", "capacity", "sizes")} | {"population": made, "bins": [max(m[0], default=-1) + 1 for m in made]}

        return each

    return map_batches(state, make, STATE + ", bins long", None)


def migrated(state: DataFrame, islands: int) -> DataFrame:
    """Each island's fittest joins the population of the next one of its problem, in a ring."""
    elites = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("population", 1, 1).alias("guest"))
    joined = state.join(elites.hint("merge"), ["problem", "island"])
    return joined.select("problem", "island", "capacity", "sizes", F.concat("population", "guest").alias("population"))


def packed(pieces: DataFrame, capacity: int = CAPACITY, problem: int = PROBLEM, islands: int = ISLANDS, individuals: int = INDIVIDUALS, epochs: int = EPOCHS, generations: int = GENERATIONS, room: float = ROOM, seed: int = 42) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; length from 1 to capacity) with sequence_id and offset, each in one
    sequence of at most `capacity` tokens, without gaps.

    A piece that fills a sequence is one. The others are dealt by their row number to problems of about `problem` pieces, and
    each problem is packed on some islands: populations of packings that evolve apart for some generations (crossed) and
    then pass their fittest on to the next island, an epoch a Spark stage. The fittest of all islands is the problem's. Its
    full bins are sequences; those with more than a share `room` free go back to a pool, which is dealt to new problems and
    packed again, until it is one problem or no longer shrinks. So only the last ones pay for being apart from the others.
    A problem has at least 4 * capacity pieces, so that even the smallest ones fill some bins of it.
    """
    problem = max(problem, 4 * capacity)
    numbered = written(pieces.select("*", F.monotonically_increasing_id().alias("uid")))
    full = numbered.where(F.col("length") >= capacity)
    done = [full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool, base, size = numbered.where(F.col("length") < capacity), 0, None
    for level in range(LEVELS):
        before, size = size, pool.count()
        if not size:
            break
        problems = -(-size // problem)
        last = problems == 1 or level == LEVELS - 1 or (before is not None and size > 0.9 * before)
        dealt = pool.withColumn("problem", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(problems)) + base)
        base += problems
        members = dealt.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("uid", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("members"))
        members = written(members.repartition(_tasks(problems), "problem"))
        state = members.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(capacity).alias("capacity"), F.transform("members", lambda m: m["length"].cast("int")).alias("sizes"), F.array().cast("array<array<int>>").alias("population"))
        for n in range(epochs):
            state = state.repartition(_tasks(problems * islands), "problem", "island")
            state = written(epoch(state, individuals, generations, seed + n))
            if n < epochs - 1:
                state = migrated(state, islands)
        best = state.groupBy("problem").agg(F.min_by(F.element_at("population", 1), F.struct("bins", "island")).alias("bin"))
        rows = written(_placed(members.join(best.hint("merge"), "problem"), capacity))
        again = F.lit(False) if last else F.col("free") > room * capacity
        done.append(rows.where(~again).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("problem") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        pool = rows.where(again).select("doc_id", "piece", "start", "length", "ids_crc32", "uid")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def _tasks(rows: int) -> int:
    """Rows are populations of a problem, some 100 KB: a few in a task."""
    return 1 + rows // 4


def _placed(problems: DataFrame, capacity: int) -> DataFrame:
    """A row for each piece of each problem: its bin, its offset there, and what the bin leaves free."""
    schema = "problem long, uid long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, free int"

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for row in batch.to_pylist():
                upto: dict[int, int] = {}
                at = []
                for m, k in zip(row["members"], row["bin"], strict=True):
                    at.append(upto.get(k, 0))
                    upto[k] = at[-1] + m["length"]
                for m, k, offset in zip(row["members"], row["bin"], at, strict=True):
                    for c, v in (m | {"problem": row["problem"], "bin": k, "offset": offset, "free": capacity - upto[k]}).items():
                        out[c].append(v)
            return out

        return each

    return map_batches(problems, make, schema, None)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Packs all texts into sequences of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text: the end token alone. Repeated rows are packed each. Null id: kept. No rows: none. Only texts of more than
    `capacity` tokens are cut. Other columns are left out. Options as of packed().
    """
    return packed(token_pieces(docs, id_column, path, capacity), capacity, **options)
