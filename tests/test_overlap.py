"""Overlapping pages by their rarest terms, against all pairs."""

import random

import pytest
from pagewright.operators import site


def all_pairs(rows, most):
    out = []
    kept = sorted({(s, g, p, o, tuple(t)) for s, g, p, o, t in rows if g and p and t})
    for s in {r[0] for r in kept}:
        found = []
        for x in kept:
            for y in kept:
                if x[0] == y[0] == s and x[1:3] == y[1:3] and x[3] < y[3]:
                    shared = [t for t in dict.fromkeys(y[4]) if t in x[4]]
                    ratio = len(shared) / min(len(x[4]), len(y[4]))
                    if len(shared) >= 3 and ratio >= 0.6:
                        found.append((-ratio, -len(shared), x[3], y[3], shared))
        out += [(s, a, b, tuple(shared), -r, k + 1) for k, (r, _, a, b, shared) in enumerate(sorted(found)[:most])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)]
    rows = [(f"s{rng.randrange(3)}", rng.choice(["x", "y", None]), rng.choice(["sell", "explain"]), k, rng.sample(words, rng.randrange(0, 9))) for k in range(150)]
    rows += [("s0", "x", "sell", 500 + k, ["w1", "w2", "w3", "w4"][:: 1 if k % 2 else -1]) for k in range(20)] + rows[:3]
    df = spark.createDataFrame(rows, "site string, stage string, purpose string, ord long, terms array<string>")
    for most in (5, 40):
        got = sorted((r["site"], r["a"], r["b"], tuple(r["shared"]), r["ratio"], r["nth"]) for r in site.overlaps(df, most).collect())
        assert got == all_pairs(rows, most)


def test_copies_of_a_page_make_no_pairs_of_all(spark):
    rows = [("s", "x", "sell", k, ["a", "b", "c", "d"]) for k in range(3000)] + [("s", "x", "sell", 9000, ["a", "b", "c", "z"])]
    df = spark.createDataFrame(rows, "site string, stage string, purpose string, ord long, terms array<string>")
    assert [(r["a"], r["b"], r["ratio"]) for r in site.overlaps(df).orderBy("nth").collect()] == [(0, k, 1.0) for k in range(1, 6)]
    assert site.overlaps(df.limit(0)).collect() == []
