"""Fill-in-the-middle, packing and the audit of filter orders, against plain versions, libraries and round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import binpack, infill, interaction, queries

TEXTS = st.text(alphabet=st.sampled_from("aé日😀<>PSM \n"), max_size=60)


def rows(rel):
    return sorted(repr(dict(zip(sorted(rel.columns), (dict(zip(rel.columns, r))[c] for c in sorted(rel.columns))))) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_filter_orders"])
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(repr({c: r[c] for c in cols}) for r in df.collect()) == rows(db.sql(queries.oracle_sql()[name]))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_boundary_lists_hold_every_code_point(text):
    data = text.encode()
    n, bounds = infill.boundaries(data)
    starts = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
    assert n == len(text)
    assert [infill.boundary(bounds, n, len(data), k) for k in range(n + 1)] == starts


def test_boundary_lists_of_long_texts(monkeypatch):
    monkeypatch.setattr(infill, "PART", 1000)  # several parts, cut within code points
    for unit in ("a", "é", "日", "a😀", "x" * 50 + "日"):
        text = unit * 3001
        n, bounds = infill.boundaries(text.encode())
        for k in (0, 1, 333, 334, n // 2, n - 1, n):
            assert infill.boundary(bounds, n, len(text.encode()), k) == len(text[:k].encode())
        assert len(bounds) * 8 < 4 * n + 64 + len(text.encode()) % 8


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_outputs_are_taken_apart_again(text, a, b, form):
    data = text.replace("<P>", "").replace("<S>", "").replace("<M>", "").encode()
    if infill.form_of(data, 0, 0) != "plain":
        a, b = sorted((min(a, len(data)), min(b, len(data))))
        assert infill.restored(infill.joined(data, a, b, form), form) == data


def test_copies_share_a_list_and_have_cuts_of_their_own(spark):
    docs = spark.createDataFrame([(k, "one two three four five") for k in range(200)] + [(900, "other"), (901, None), (902, "")], "doc_id long, text string")
    index = {r["n_units"]: r["copies"] for r in infill.text_index(docs).collect()}
    assert index == {23: 200, 5: 1, 0: 2}
    got = infill.fill_in_middle(docs, with_output=True).collect()
    assert len(got) == 203 and len({r["output"] for r in got if r["doc_id"] < 200}) > 100
    assert {r["restored_sha256"] for r in got if r["doc_id"] < 200} == {hashlib.sha256(b"one two three four five").hexdigest()}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["Foo", "bar.", "É", "é.", "é", "'s", "it's,", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|startoftext|>x.", " ", "\t", "\x1c", "\x85", " ", "̈", "ß!", "İ", "Σ", "日本", "12,", "\x00", "w" * 99])).map("".join)))
def test_ids_are_the_librarys(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    if "lib" not in KEPT:
        KEPT["lib"] = Tokenizer.from_file(path)
    assert binpack.words(path).encode(text.encode()) == np.array(KEPT["lib"].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


KEPT = {}


def test_words_are_forgotten_and_asked_again(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(binpack, "REMEMBERED", 5000)
    few = binpack.Words(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"word{k % 97}, Größe{k % 31}." for k in range(500)).encode()
    assert few.encode(text) == binpack.words(None).encode(text) == few.encode(text)
    assert few.encode(b"once more") == binpack.words(None).encode(b"once more") and few.old


def whole(got, capacity):
    """Nothing lost, nothing over, no gaps."""
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    return by


def test_documents_are_packed_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op12_pack_sequences(spark, sf).collect()
    by = whole(got, 2048)
    words = binpack.words(None)
    want = []
    for r in docs.collect():
        ids = words.encode((r["text"] or "").encode()) + bytes(4)
        want += [(r["doc_id"], k, 2048 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(ids[a : a + 8192] for a in range(0, len(ids), 8192))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    least = binpack.least_bins([w[3] for w in want], 2048)
    assert least <= len(by) <= least + 1 + least // 200


@pytest.mark.parametrize("sizes", [[60] * 50 + [40] * 50, [51] * 30, [34] * 31, [1] * 900, [99], list(range(1, 100)) * 6])
def test_pools_and_islands_pack_tightly(spark, sizes):
    rows = [(k, 0, 0, n, k) for k, n in enumerate(sizes)] * 2
    df = spark.createDataFrame(rows, binpack.PIECES)
    got = binpack.packed(df, capacity=100, problem=40, islands=2, epochs=2, generations=4).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    best = binpack.Packing([r[3] for r in rows], 100)
    best.best_fit(list(range(len(rows))))
    assert len(whole(got, 100)) <= 1.02 * len(best.bins) + 1  # of all in one problem


def test_crossover_injects_whole_bins_and_loses_nothing():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 90, 400).tolist()
    a, b = (binpack.Packing(sizes, 100) for _ in range(2))
    a.best_fit(list(range(400)))
    for k in rng.permutation(400).tolist():
        b.best_fit([k])
    child = binpack.crossed(a.bins, b.bins, sizes, 100, rng, share=0.2)
    assert sorted(i for m in child.bins for i in m) == list(range(400))
    assert all(sum(sizes[i] for i in m) <= 100 for m in child.bins)
    both = {frozenset(m) for m in b.bins} & {frozenset(m[: len(m)]) for m in child.bins}
    assert len(both) >= 0.5 * int(0.2 * len(b.bins))  # later best fits may add to injected bins
    assert all(len(m) for m in child.bins)


def test_evolution_mends_a_bad_start():
    """Triples that fill bins exactly: best fit decreasing needs more bins, crossovers with better packings none."""
    rng = random.Random(3)
    sizes = []
    for _ in range(60):
        x, y = rng.randint(26, 48), rng.randint(26, 48)
        sizes += [x, y, 100 - x - y] if 100 - x - y > 0 else [50, 50]
    rng.shuffle(sizes)
    start = binpack.Packing(sizes, 100)
    for k in range(len(sizes)):
        start.best_fit([k])
    bad = binpack.as_chromosome(start.bins, len(sizes))
    got = binpack.evolved(sizes, [bad], 100, individuals=4, generations=60, seed=1)
    fits = [max(c) + 1 for c in got]
    assert fits[0] == min(fits) < max(bad) + 1
    assert fits[0] <= -(-sum(sizes) // 100) + 2


DOCS = [
    (1, "word " * 250, "a"), (2, "word " * 250, "a"), (2, "word " * 250, "a"), (None, "word " * 250, "a"), (3, " ".join(f"w{k}" for k in range(300)), None), (4, " ".join(f"W{k}" for k in range(300)), ""),
    (5, None, "b"), (6, "", "b"), (7, "a # b", "é"), (8, "\x1cé " * 200, "b"), (9, " \t\r\n", None), (10, "Xy " + "x" * 40000, "b"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, None, 1), (5, 0, None), (10, 1, 1), (None, 1, 1), (77, 1, 1)]


def plainly(docs, labels):
    """Every order applied to lists of documents, one after the other."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def fails(i, text):
        words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and first[text] < i,
        }

    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(fails(i, t or ""), i in good, i in toxic) for i, t, s in docs if (s or "") == part]
        removed = Counter()
        for p in permutations("ABCDE"):
            left = own
            for k, f in enumerate(p):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed[f] += len(gone)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                out[part, "".join(p), k + 1] = [len(left), len(gone), sum(d[0][f] for d in own) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (pt, p, k), v in out.items():
            if pt == part:
                v.append(removed[p[k - 1]])
    return out


def test_filter_orders_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1.0, "x", True) for r in DOCS], "doc_id long, text string, source string, n double, PART string, good boolean")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in interaction.filter_orders(docs, labels).collect()}
    assert got == plainly(DOCS, LABELS)
    assert interaction.filter_orders(docs.limit(0), labels).collect() == []


def test_states_are_entered_once(spark, monkeypatch):
    """32 sets of filters, 80 edges and the end, though 120 orders have 600 steps."""
    entered = []
    monkeypatch.setattr(interaction, "written", lambda df, tidy=True, f=interaction.written: entered.append(1) or f(df, tidy))
    failing = spark.createDataFrame([("a", k & 1 == 1, k & 2 == 2, k & 4 == 4, k & 8 == 8, k & 16 == 16, False, True) for k in range(32)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    edges = interaction.explored(failing).collect()
    assert len(entered) == 32 and len(edges) == 81
    assert all(r["removed"] * 2 == r["n"] for r in edges if r["filter"])
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_odd_rows_go_through(spark, odd, none):
    ids = Counter(r["doc_id"] for r in odd.collect())
    assert Counter(r["doc_id"] for r in infill.fill_in_middle(odd).collect()) == ids
    packed = binpack.pack_documents(odd).collect()
    assert set(ids) == {r["doc_id"] for r in packed}
    assert sum(r["length"] for r in packed if r["doc_id"] == 3) == 1
    assert infill.fill_in_middle(none).collect() == binpack.pack_documents(none).collect() == []
