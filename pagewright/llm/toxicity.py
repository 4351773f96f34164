"""Toxicity by maximum-scoring segments over token log-odds, with extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_training, held_out, map_batches, pick, written

#: Rows of each class that a model is fitted on at most (picked by a hash), and tokens that it has at most.
SAMPLE_ROWS, TOKENS = 20_000, 50_000
#: The Dirichlet prior: so much for every token, and so much in all by the tokens' background frequency.
FLAT, BACKGROUND = 0.5, 500.0
#: Tokens whose log-odds are so many standard deviations from 0 count; other words score REST. Longer words also have the
#: tokens of their first STEMS letters, for words that the sample doesn't have.
SIGNIFICANT, REST, STEMS = 3.0, -0.25, (5, 4)
#: Segments with a smaller E = K * words * exp(-lambda * score) (Karlin and Altschul) are significant; a text's evidence at
#: most. K is fitted on clean texts; UNFITTED_K holds where there are none with a segment.
UNFITTED_K, MOST_E, MOST_EVIDENCE = 0.1, 0.5, 60.0
PREDICTED = 0.7

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages string"
Segment = tuple[int, int, float]


def words(text: str | None, find=re.compile(r"\w+").findall) -> list[str]:
    return find(text.lower()) if text else []


def maximal_segments(scores: np.ndarray) -> list[Segment]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa).

    Runs of one sign are joined first: a segment begins and ends with positive scores, and each run is in it whole.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(up)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    sums = np.add.reduceat(scores.astype(np.float64), starts)
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    lower: list[int] = []  # of each the last one before it with a smaller sum before: those between are passed once
    total = 0.0
    for start, end, value in zip(starts.tolist(), ends.tolist(), sums.tolist(), strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        s, left, j = start, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                found.append((s, end, left, total))
                lower.append(j)
                break
            s, left, k = found[j][0], found[j][2], j
            j = lower[j]
            del found[k:], lower[k:]
    return [(s, e, right - left) for s, e, left, right in found]


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> tuple[float, float]:
    """A token's log-odds between the classes with its Dirichlet prior, and their standard score."""
    prior = FLAT + BACKGROUND * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    all_ = BACKGROUND + FLAT
    odds = math.log(a / max(n_toxic + all_ - a, FLAT)) - math.log(b / max(n_clean + all_ - b, FLAT))
    return odds, odds / math.sqrt(1 / a + 1 / b)


def decay(weights: dict[float, float]) -> float:
    """lambda: the positive root of sum(weight * exp(lambda * score)) = sum(weight), or 1 where there is none."""
    total = sum(weights.values())
    f = lambda x: sum(w * math.exp(min(x * s, 700)) for s, w in weights.items()) - total
    if not total or max(weights, default=0) <= 0 or sum(s * w for s, w in weights.items()) >= 0:
        return 1.0
    low, high = 0.0, 1e-3
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


class Model:
    """Scores texts: token scores, lambda, and the logistic curve from a text's evidence to its score."""

    def __init__(self, tokens: dict[str, float], rate: float, curve: tuple[float, float] = (-4.0, 1.0), k: float = UNFITTED_K):
        self.tokens, self.rate, self.curve, self.k = tokens, rate, curve, k
        self.stems = {t[:-1]: s for t, s in tokens.items() if t.endswith("*")}
        self.words = {t: s for t, s in tokens.items() if not t.endswith("*")}

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """A word's own score, else its longest stem's, else REST."""
        scores: dict[str, float] = {}
        for t in set(tokens):
            s = self.words.get(t)
            for n in STEMS if s is None else ():
                if len(t) > n and (s := self.stems.get(t[:n])) is not None:
                    break
            if s is not None:
                scores[t] = s
        return np.fromiter((scores.get(t, REST) for t in tokens), np.float32, len(tokens)) if scores else np.full(len(tokens), REST, np.float32)

    def significant(self, scores: np.ndarray, n: int) -> list[Segment]:
        """Segments that are significant in a text of n words, with their -ln E."""
        found = ((s, e, self.rate * x - math.log(self.k * n)) for s, e, x in maximal_segments(scores))
        return [(s, e, x) for s, e, x in found if x > -math.log(MOST_E)]

    def chance(self, tokens: list[str]) -> float | None:
        """words * exp(-lambda * the best segment's score), whose mean over clean texts is 1 / K; null without a segment."""
        found = maximal_segments(self.token_scores(tokens)) if tokens else []
        return len(tokens) * math.exp(-self.rate * max(x for _, _, x in found)) if found else None

    def passages(self, tokens: list[str]) -> tuple[list[Segment], float]:
        """All significant segments with their -ln E, and their evidence together.

        What counts as evidence is that the passages have a token: after its first place in them a positive one is neutral.
        """
        if not tokens:
            return [], 0.0
        scores = self.token_scores(tokens)
        found = self.significant(scores, len(tokens))
        seen, total = set(), 0.0
        for s, e, _ in found:
            part = scores[s:e].copy()
            for k in np.flatnonzero(part > 0).tolist():
                if tokens[s + k] in seen:
                    part[k] = 0.0
                seen.add(tokens[s + k])
            total += sum(x for _, _, x in self.significant(part, len(tokens)))
        return found, min(total, MOST_EVIDENCE)

    def score(self, x: float) -> float:
        """Evidence x on the logistic curve."""
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic regression of y on x, by Newton steps; the slope isn't negative."""
    beta = np.zeros(2)
    rows = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (w * (y - p)) - ridge * beta
        hessian = (rows * (w * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def labelled(docs: DataFrame, labels: DataFrame, id_column: str, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts with y (0 or 1) that models may learn from, at most `rows` of a class, and how many there are of each."""
    known = pick(labels, id_column, "toxic").where(for_training(F.col(id_column)) & F.col("toxic").isin(0, 1))
    known = known.groupBy(id_column).agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(1), id_column), id_column).limit(rows) for y in (0, 1)]
    # At most 2 * rows ids: small enough to be sent to where the texts are.
    return pick(docs, id_column, "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), id_column).select("y", "text"), counts


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from the labelled rows that aren't held out; at most `rows` of each class."""
    sample, counts = labelled(docs, labels, id_column, rows)
    sample = written(sample)  # at most 2 * rows texts, read three times

    def count():
        def each(batch: pa.RecordBatch) -> dict:
            n, uses = {0: Counter(), 1: Counter()}, Counter()
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                n[y].update(set(own))
                n[y].update({t[:k] + "*" for t in set(own) for k in STEMS if len(t) > k})
                n[y].update({"": len(own)})
                if y == 0:
                    uses.update(own)
            tokens = list(n[0].keys() | n[1].keys())
            return {"token": tokens, "clean": [n[0][t] for t in tokens], "toxic": [n[1][t] for t in tokens], "uses": [uses[t] for t in tokens]}

        return each

    # Documents that have a token: a word that one text repeats says no more than once. uses: a word's places in clean ones.
    seen = map_batches(sample, count, "token string, clean long, toxic long, uses long", "text", most=8 << 20).groupBy("token").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"), F.sum("uses").cast("double").alias("uses"))
    seen = seen.where("token = '' or clean + toxic >= 3")
    all_words = seen.where("token = ''").first()
    if all_words is None or not counts.get(1) or not counts.get(0):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Model({}, 1.0, (math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0))
    n = seen.where("token != '' and not endswith(token, '*')").agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = n[0] or 1.0, n[1] or 1.0
    prior = FLAT + BACKGROUND * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    rough = (F.log(a / n_toxic) - F.log(b / n_clean)) / F.sqrt(1 / a + 1 / b)  # bounds what is brought to the driver
    kept = seen.where("token != ''").withColumn("z", F.abs(rough)).where(F.col("z") > SIGNIFICANT / 2).orderBy(F.col("z").desc(), "token").limit(TOKENS).collect()
    tokens, weights, positive = {}, Counter(), 0.0
    for r in kept:
        odds, z = log_odds(r["toxic"], r["clean"], n_toxic, n_clean)
        if abs(z) >= SIGNIFICANT:
            tokens[r["token"]] = odds
            if not r["token"].endswith("*"):
                weights[round(odds, 2)] += r["uses"] + FLAT
    weights[REST] += max(0.0, all_words["clean"] - sum(weights.values()))
    model = Model(tokens, decay(weights))

    def chances():
        def each(batch: pa.RecordBatch) -> dict:
            return {"x": [model.chance(words(t)) for t in batch.column("text").to_pylist()]}

        return each

    # The maximum-likelihood K of extreme values, given lambda, over the clean texts that have a segment.
    fitted = map_batches(sample.where("y = 0"), chances, "x double", "text").agg(F.count("x"), F.sum("x")).first()
    model.k = fitted[0] / fitted[1] if fitted[0] and fitted[1] > 0 else UNFITTED_K

    def evidence():
        def each(batch: pa.RecordBatch) -> dict:
            found = [model.passages(words(t)) for t in batch.column("text").to_pylist()]
            return {"y": batch.column("y"), "x": [x for _, x in found]}

        return each

    binned = map_batches(sample, evidence, "y int, x double", "text").groupBy("y", F.round("x", 1).alias("x")).agg(F.count("*").alias("n")).collect()
    y, x, n = (np.array([r[c] for r in binned], np.float64) for c in ("y", "x", "n"))
    drawn = {k: max(1.0, n[y == k].sum()) for k in (0, 1)}
    model.curve = logistic(x, y, n * np.where(y == 1, counts[1] / drawn[1], counts[0] / drawn[0]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Scores each whole text, as labels.toxic marks toxic ones; columns as in SCHEMA.

    Tokens (words in lower case, and stems of long words) score their log-odds between toxic and clean labelled documents
    with a Dirichlet prior; a linear-time scan finds all maximal-scoring segments of a text. Those whose expected number by
    chance, by Karlin-Altschul statistics over clean documents, is below 0.5 are its passages (first and last word:
    -ln E). Their evidence together, each token counted once, gives the score by a logistic curve fitted on the sample.

    Null or empty text, or one without known toxic words: no passages, the curve's lowest score. No labels to learn from:
    the share of toxic ones for all. Rows with several labels count as toxic if one is. Repeated rows are scored each.
    Other columns are left out. The model (at most TOKENS tokens) is all that is sent to workers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_column, rows))

    def make():
        model = sent.value

        def each(batch: pa.RecordBatch) -> dict:
            found = [model.passages(words(t)) for t in batch.column("text").to_pylist()]
            scores = [model.score(x) for _, x in found]
            told = [",".join(f"{s}-{e - 1}:{x:.1f}" for s, e, x in f) for f, _ in found]
            return {"doc_id": batch.column(id_column), "held_out": batch.column("_held_out"), "score": scores, "predicted": [int(s >= PREDICTED) for s in scores], "n_passages": [len(f) for f, _ in found], "passages": told}

        return each

    return map_batches(pick(docs, id_column, "text").withColumn("_held_out", held_out(F.col(id_column))), make, SCHEMA, "text")
