"""Language identification by cross-parsing: a text is cut into the longest phrases that a language's sample has."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import for_training, held_out, map_batches, pick

#: Bounds of the sample: characters of a language, of all languages, and rows of a language that are looked at for them.
SAMPLE_CHARS, ALL_CHARS, SAMPLE_ROWS = 1 << 16, 1 << 18, 256
#: Letters that the automata tell apart, the others of a sample being one more; characters of a text parsed side by side.
LETTERS, PART = 62, 256
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class SuffixAutomaton:
    """Of a sequence of small integers: its states are classes of the sequence's substrings, state 0 the empty one."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new

    def edges(self, width: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of states, and each transition as from * width + code and to."""
        at = [s * width + c for s, out in enumerate(self.next) for c in out]
        return len(self.next), np.array(at, np.int32), np.array([t for out in self.next for t in out.values()], np.int32)


class Parser:
    """Counts a text's phrases in each language."""

    def __init__(self, alphabet: str, edges: dict[str, tuple[int, np.ndarray, np.ndarray]], sizes: dict[str, int]):
        self.width = len(alphabet) + 2
        self.codes = np.zeros(0x110000, np.uint8)  # 0: no letter
        for c, kind in ((chr(k), "") for k in range(0x110000) if chr(k).isalpha()):
            self.codes[ord(c)] = len(alphabet) + 1
        for k, c in enumerate(alphabet):
            self.codes[ord(c)] = k + 1
        self.langs, self.sizes, self.tables = sorted(edges), sizes, {}
        for lang, (n, at, to) in edges.items():
            self.tables[lang] = np.zeros(n * self.width, np.int32)
            self.tables[lang][at] = to

    def coded(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, texts: list[np.ndarray], part: int = PART) -> np.ndarray:
        """(languages, texts): how many phrases each coded text has. Parts of `part` characters are parsed side by side."""
        counts = [-(-len(t) // part) for t in texts]
        owner = np.repeat(np.arange(len(texts)), counts)
        length = np.full(len(owner), part)
        ends = np.cumsum(counts)
        for t, n, end in zip(texts, counts, ends, strict=True):
            if n:
                length[end - 1] = len(t) - (n - 1) * part
        order = np.argsort(-length, kind="stable")
        flat = np.zeros(len(owner) * part, np.uint8)
        for t, n, end in zip(texts, counts, ends, strict=True):
            flat[(end - n) * part : (end - n) * part + len(t)] = t
        columns = np.ascontiguousarray(flat.reshape(-1, part)[order].T).astype(np.int32)
        active = np.searchsorted(-length[order], -np.arange(part), side="left")  # parts longer than k
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        for row, lang in enumerate(self.langs):
            table, state, n = self.tables[lang], np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for k in range(part):
                m = active[k]
                if not m:
                    break
                c, s = columns[k, :m], state[:m]
                to = table[s * self.width + c]
                # A phrase begins at the root, and where the longest match can't be extended.
                miss = to == 0
                n[:m] += miss | (s == 0)
                state[:m] = np.where(miss, table[c], to)
            np.add.at(out[row], owner[order], n)
        return out

    def predict(self, texts: list[str | None], part: int = PART) -> tuple[list[str], list[float]]:
        coded = [self.coded(t) if t else np.zeros(0, np.uint8) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        counts = self.phrases(coded, part or max(1, *map(len, coded), 1))
        cost = counts * np.array([[math.log(max(2, self.sizes[x]))] for x in self.langs])
        best = cost.argmin(axis=0)
        weight = np.exp(np.maximum(cost.min(axis=0) - cost, -700.0) / 4)
        sure = weight.max(axis=0) / weight.sum(axis=0)
        known = [bool(c.any()) for c in coded]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(sure, known, strict=True)]


def samples(docs: DataFrame, id_column: str = "doc_id", chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Text of each language, at most `chars` characters and `all_chars` for all, from at most `rows` rows that a hash of
    the row picks among those that models may learn from."""
    known = pick(docs, id_column, "lang", "text").where(for_training(F.col(id_column)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    mark = F.xxhash64(F.lit(7), id_column, "lang")
    # Of a language with many rows only some eight times as many as are looked at go on.
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, 8 * rows / n))) for lang, n in sorted(counts.items())])
    drawn = known.where(F.shiftrightunsigned(mark, 11) / float(1 << 53) < share)
    by = Window.partitionBy("lang").orderBy(mark, id_column, F.xxhash64("text"))
    taken = drawn.withColumn("at", F.row_number().over(by)).where(F.col("at") <= rows)
    most = min(chars, all_chars // len(counts))
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    taken = taken.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < most).select("lang", "at", F.substring("text", F.lit(1), F.lit(most) - F.col("upto")).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["at"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: "\n".join(texts)[:most] for lang, texts in out.items()}


def learn(texts: dict[str, str], letters: int = LETTERS) -> tuple[str, dict, dict[str, int]]:
    """Alphabet, automata's edges and sizes of the languages' samples, as Parser takes them."""
    seen = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
    alphabet = "".join(sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:letters]))
    codes = {c: k + 1 for k, c in enumerate(alphabet)}
    rare = len(alphabet) + 1
    edges = {lang: SuffixAutomaton([codes.get(c, rare if c.isalpha() else 0) for c in t.lower()]).edges(len(alphabet) + 2) for lang, t in texts.items()}
    return alphabet, edges, {lang: len(t) for lang, t in texts.items()}


_PARSERS: dict[str, Parser] = {}


def identify(docs: DataFrame, id_column: str = "doc_id", train: DataFrame | None = None, carry: tuple[str, ...] = (), part: int = PART, letters: int = LETTERS, **bounds: int) -> DataFrame:
    """Predicts the language of each whole text; columns as in SCHEMA, then those of docs that `carry` names.

    Learns from text and lang of the rows of `train` (docs) that aren't held out, by samples() with its bounds, and makes a
    suffix automaton of each language's sample. A text is cross-parsed in every language: each phrase is the longest match
    with the sample that begins where the last one ended. The language with the fewest phrases, times the logarithm of its
    sample's size, wins; ties go to the first by name. score is the winner's share of exp(-cost / 4). Texts are parsed in
    parts of `part` characters side by side, each of which begins a phrase; part 0 parses each text in one, which takes a
    step for each character of a batch's longest text. The `letters` (254 at most) most frequent letters are told apart.

    `und` with score 0: null text, a text without letters, or nothing to learn from. Null lang: not learned from. Repeated
    rows are judged each. The automata (at most all_chars characters in all) are all that is sent to workers.
    """
    alphabet, edges, sizes = learn(samples(docs if train is None else train, id_column, **bounds), letters)
    sent = docs.sparkSession.sparkContext.broadcast((alphabet, edges, sizes))
    key = f"{docs.sparkSession.sparkContext.applicationId}:{sent._jbroadcast.id()}"
    names = [c for c in dict.fromkeys((id_column, "text", *carry))]
    rows = pick(docs, *names).withColumn("_held_out", held_out(F.col(id_column)))
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema.fields) if carry else ""

    def make():
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(*sent.value)
        parser = _PARSERS[key]

        def each(batch: pa.RecordBatch) -> dict:
            langs, scores = parser.predict(batch.column("text").to_pylist(), part)
            return {c: batch.column(c) for c in carry} | {f"{x}doc_id": batch.column(id_column) for x in ("_" if carry else "",)} | {"held_out": batch.column("_held_out"), "lang_pred": langs, "score": scores}

        return each

    if not carry:
        return map_batches(rows, make, SCHEMA, "text")
    return map_batches(rows, make, "_doc_id long, held_out boolean, lang_pred string, score double" + fields, "text")


def recognised(docs: DataFrame) -> DataFrame:
    """documents whose language is identified, with all their columns; texts of no language (`und`) go, and a lang that
    was null is the predicted one. Null and empty texts go; very long ones are parsed whole. Repeated rows are judged each.
    Names of other columns may clash."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    named = plain.withColumnsRenamed({at["doc_id"]: "doc_id", at["text"]: "text", at["lang"]: "lang"})
    kept = identify(named, carry=tuple(named.columns)).where(F.col("lang_pred") != UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*named.columns).toDF(*docs.columns)
