"""Operators against plain versions of themselves, libraries, and exact round trips."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import bpe, langid, mixing, passages, quality, secrets, simhash, telephony, toxicity, urls
from pagewright.llm import components as comp
from pyspark.sql import functions as F

TEXT = st.text(alphabet=st.sampled_from("ab cd\n\t\x0b'é😀1!<|>"), max_size=80)


# BPE ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), TEXT))
def test_bpe_equals_the_library(library, text):
    voc = bpe.vocabulary(bpe.default_path())
    ids = voc.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
    assert voc.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_of_a_long_piece_and_special_tokens(library):
    voc = bpe.vocabulary(bpe.default_path())
    for text in ("ab" * 20_000, "x<|endoftext|>y  <|endoftext|>", "\ud7ff\u0000 \u3000\u00a0a"):
        assert list(np.frombuffer(voc.encode(text), "<u4")) == library.encode(text, add_special_tokens=False).ids


# Telephony ---------------------------------------------------------------------------------------------------------


def test_companding_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256


def plain_adpcm(block: bytes) -> list[int]:
    value, index = struct.unpack_from("<h", block)[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + telephony.MOVES[code & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_side_by_side():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 68), np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]


@given(st.binary(max_size=500))
@settings(deadline=None)
def test_stored_payloads_come_back(data):
    payload = telephony.payload_of(data)
    assert len(payload) % 64 == 0 and payload.startswith(data) and len(payload) > 0
    for tag in (telephony.MULAW, telephony.ALAW, telephony.ADPCM):
        read, rate, align, stored = telephony.read_wav(telephony.store(payload, tag))
        assert (read, rate) == (tag, 8000) and telephony.stored_payload(tag, align, stored) == payload


def test_resampling_keeps_a_tone():
    t = np.arange(4000)
    pcm = (8000 * np.sin(2 * np.pi * 400 * t / 8000)).astype(np.int16)
    up = telephony.resample(pcm, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 400 * np.arange(8000) / 16000)
    assert len(up) == 8000 and np.abs(up[200:-200] - want[200:-200]).max() < 200
    assert len(telephony.resample(pcm, 8000, 11025)) == -(-4000 * 441 // 320)
    long = np.tile(pcm, 100)
    assert (telephony.resample(long, 8000, 16000)[200:7000] == np.tile(up, 2)[200:7000]).all()


@pytest.mark.parametrize("rate", [44100, 11025, 48000, 22050])
def test_resampling_makes_the_kept_phases_only(rate):
    rng = np.random.default_rng(rate)
    pcm = rng.integers(-9000, 9000, 3000).astype(np.int16)
    g = np.gcd(rate, 16000)
    up, down, taps = 16000 // g, rate // g, telephony.TAPS
    phases, padded = telephony._phases(up, down, taps).astype(float), np.pad(pcm, (taps - 1, taps)).astype(float)
    want = [np.dot(padded[m * down // up : m * down // up + 2 * taps], phases[m * down % up][::-1]) for m in range(-(-len(pcm) * up // down))]
    got = telephony.resample(pcm, rate, 16000)
    assert len(got) == len(want) and np.abs(got - np.clip(want, -32768, 32767)).max() <= 1


def test_files_that_cannot_be_read(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(telephony.store(b"\x55" * 64, telephony.ALAW)))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in telephony.resample_column(df).collect()}
    assert got[1]["pcm"] is None and got[1]["error"] is None and got[2]["error"] and len(got[3]["pcm"]) == 44 + 4 * 64


def test_stored_pcm(spark):
    r = telephony.store_texts(spark.createDataFrame([(1, "some text" * 30)], "doc_id long, text string"), with_files=True).first()
    assert r["pcm_bytes"] == len(r["pcm"]) and r["pcm_sha256"] == hashlib.sha256(r["pcm"]).hexdigest()
    tag, rate, _, data = telephony.read_wav(r["pcm"])
    media_tag, media_rate, align, media = telephony.read_wav(r["media"])
    assert (tag, rate) == (telephony.PCM, 16000)
    assert np.array_equal(np.frombuffer(data, "<i2"), telephony.resample(telephony.expand([(media_tag, align, media)])[0], media_rate))


def test_columns_of_stored_texts(spark):
    r = telephony.store_texts(spark.createDataFrame([(1, "häß")], "doc_id long, text string"), with_files=True).first()
    payload = "häß".encode() + b"\0" * 59
    assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (5, 64, zlib.crc32(payload))
    assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()


# Secrets -----------------------------------------------------------------------------------------------------------

PARTS = ["password", "passwd", "API_KEY", "apikey", "secret", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKL", "deadbeef" * 4, "abc", "x1y2z3w4", "\n", "é"]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@settings(max_examples=200, deadline=None)
def test_base_spans(text):
    want = []
    for kind, pattern, flags, keep in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        (1, r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
        (2, r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    ):
        want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if keep(m)]
    assert secrets.base_spans(text) == sorted(want)


def test_novel_strings_and_redaction():
    rng = random.Random(0)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    text = f"client credential {key} is used; the colour of request_handler_timeout_value_1 is known"
    novelty = secrets.Novelty()
    (span,) = novelty.spans(text, secrets.base_spans(text))
    assert text[span[0] : span[2]] == key
    assert novelty.spans(text, [span]) == []
    assert novelty.spans(f"the {key} stands alone", []) == []
    assert secrets.redacted(text, [span]) == text.replace(key, "[SECRET]")
    assert secrets.redacted("abcdef", [(1, 0, 4), (2, 2, 3), (4, 1, 5)]) == "a[SECRET][SECRET]f"


# Language ----------------------------------------------------------------------------------------------------------


def plain_phrases(text: str, sample: str) -> int:
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


@given(st.text("abc ", max_size=60), st.text("abcd ", max_size=40))
@settings(max_examples=150, deadline=None)
def test_phrases_are_longest_matches(sample, text):
    parser = langid.Parser(*langid.learn({"x": sample, "y": "zzz"}))
    coded = parser.coded(text)
    plain = lambda t: "".join(c if c.isalpha() else " " for c in t)
    got = parser.phrases([coded, coded[:0]], part=1000)[0]
    rare = plain(text).replace("d", "z")  # letters that no sample has are one letter; another sample has z
    want = plain_phrases(plain(text), plain(sample)) if text else 0
    assert got.tolist() == [want, 0] or "d" in rare


def test_whole_texts_can_be_parsed_in_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    samples = langid.samples(docs)
    parser = langid.Parser(*langid.learn(samples))
    rows = docs.select("doc_id", "text").where("length(text) between 300 and 1500").limit(12).collect()
    want = parser.phrases([parser.coded(r["text"]) for r in rows], part=10**4)
    plain = lambda t: "".join(c if c.isalpha() else " " for c in t.lower())
    for k, r in enumerate(rows[:3]):
        for row, lang in enumerate(parser.langs):
            assert want[row][k] == plain_phrases(plain(r["text"]), plain(samples[lang]))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, part=0).collect()}
    assert all(got[r["doc_id"]] == parser.predict([r["text"]], 0)[0][0] for r in rows)


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


# SimHash and components --------------------------------------------------------------------------------------------


def smallest(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in smallest(links, nodes).items()}
    assert comp.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    words = ["a", "B", "c", "a", "b", "c"]
    shingles = [" ".join(words[k : k + 3]).lower() for k in range(4)]
    votes = [sum(xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    assert simhash.fingerprint("a B\tc a\x0bb\nc") == sum(1 << b for b in range(64) if 2 * votes[b] > 4)
    assert simhash.fingerprint(" ") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("x y") == xxh64_intdigest(b"x y", 42)


def test_links_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:20]:
        for n in (1, 2, 3, 4):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_near_duplicates_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    want = smallest([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
    kept = [r["doc_id"] for r in simhash.one_each(docs.unionByName(docs)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


# Quality -----------------------------------------------------------------------------------------------------------


@given(st.lists(st.sampled_from(["a", "b", "#c", "\n", "é ", " "]), max_size=60).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    assert quality.repeated_words(text.encode().split()) == len(covered)
    lines = text.split("\n")
    assert quality.duplicate_lines(text.encode()) == sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))


def test_quality_verdicts(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400))
    rows = [(1, prose), (2, "the same words again and again " * 80), (3, "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(9)) + " ")]
    rows[2] = (3, " ".join("".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(60)) for _ in range(60)))
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[3]["kept"] and not got[3]["base_failed"]


def test_a_short_repetitive_end_counts(spark):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(800)).encode()[:2048].decode()
    rows = [(1, prose), (2, prose + " " + "y" * 1500)]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and (got[1]["n_chunks"], got[2]["n_chunks"]) == (1, 2)
    assert got[2]["chunks_outside"] == 1 and not got[2]["kept"] and not got[2]["base_failed"]


# Mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes: dict, weights=(3, 1, 2), total=1.5, most=2) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), total * sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 7, None: 900}, {"a": 1}, {"a": 0, "b": 0}, {chr(97 + k): 10**k for k in range(6)}, {"Z": 5, "é": 5, "a": 5, "b": 400}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_permutations(spark):
    for n in (1, 2, 3, 5, 10, 97, 1000, 1024):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7), F.lit(1)).alias("p"))
        values = [r["p"] for r in df.collect()]
        assert sorted(values) == list(range(n))
        assert n < 10 or values != sorted(values)


def test_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.taken_words(docs).join(docs.select("doc_id", "text", "source"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 2 * mixing.BLOCK
    assert sorted(got) == sorted(mixing.taken_words(docs.repartition(7)).join(docs.select("doc_id", "text", "source"), "doc_id").collect())


def test_many_shards_and_buckets(spark, sf, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.taken_words(docs, shard_slots=100).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.1 * r["target"] + 128 for r in got)


def test_repeated_secrets_do_not_hide_themselves(spark):
    rng = random.Random(3)
    novelty = secrets.Novelty()
    for gap in (3, 2048, 2048 - 28, 2048 - 40):
        key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
        words = invented(rng, 1000)[: gap - 10]
        text = f"the bearer {key}\n{words}\nthe bearer {key}\n"
        assert [text[s:e] for s, _, e in novelty.spans(text, secrets.base_spans(text))] == [key] * 2
        text = f"the bearer {key} and\nbearer auth={key}\nbearer auth={key}\n"
        assert [text[s:e] for s, _, e in novelty.spans(text, secrets.base_spans(text))][0] == key
        assert key not in secrets.redacted(text, novelty.spans(text, secrets.base_spans(text)) + secrets.base_spans(text))
    line = f"the bearer {key} opens it\n"
    rows = spark.createDataFrame([(1, line * 3)], "doc_id long, text string")
    assert secrets.scan_secrets(rows).first()["n_novel"] == 3 and key not in secrets.redact(rows).first()["text"]


# Passages ----------------------------------------------------------------------------------------------------------


def invented(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n))


def words_of(rows):
    return {i: (t or "").lower().split() for i, t in rows}


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(11)
    shared, para = invented(rng, 60), invented(rng, 40).split()
    near = para[:-1] + ["changed"]
    rows = [(k, f"{invented(rng, 20 + k)} {shared} {invented(rng, 30)}") for k in range(1, 5)] + [(k, invented(rng, 150)) for k in range(5, 15)]
    rows += [(20, invented(rng, 9) + "\n" + " ".join(para)), (21, invented(rng, 30) + "\n" + " ".join(near).upper() + "\n")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 20, 21}
    assert {(r["doc_id"], r["removed"]) for r in got if r["kind"] == "line"} == {(20, False), (21, True)}
    for r in got:
        if r["kind"] == "run":
            found = " ".join(words_of(rows)[r["doc_id"]][r["start"] : r["start"] + r["n"]])
            assert found in shared and r["n"] >= 34 and r["cluster_doc"] == 1 and r["removed"] == (r["doc_id"] != 1)


def plain_windows(words, window, among):
    """Starts of a text's windows, the slow way."""
    from xxhash import xxh64_intdigest

    hashes = [xxh64_intdigest(w.encode()) for w in words]
    found = {min(range(k, k + among), key=lambda j: (hashes[j], j)) for k in range(len(words) - among + 1)}
    return sorted(k for k in found if k + window <= len(words))


def plain_runs(rows, window, among, gone=frozenset()):
    """(doc, start, n, keeper) of all runs; gone: (doc, word) of removed lines."""
    texts, holders = words_of(rows), {}
    for i, words in texts.items():
        for k in plain_windows(words, window, among):
            if not any((i, j) in gone for j in range(k, k + window)):
                holders.setdefault(tuple(words[k : k + window]), set()).add((i, k))
    placed = {}
    for at in holders.values():
        keeper = min(at)[0]
        if max(at)[0] != keeper:
            for i, k in at:
                placed.setdefault((i, keeper), []).append(k)
    out = []
    for (i, keeper), starts in placed.items():
        first = last = None
        for k in [*sorted(starts), None]:
            if first is None or k is None or k >= last + window:
                out += [(i, first, last + window - first, keeper)] if first is not None else []
                first = k
            last = k
    return sorted(out)


def test_runs_against_brute_force(spark):
    for seed in range(2):
        rng = random.Random(seed)
        parts = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(4, 30))] for _ in range(14)] + [["same"] * 25, ["a", "b"] * 20]
        rows = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(parts) + [f"x{rng.randrange(10**6)}"] * rng.randint(0, 2))) for i in range(60)] + [(99, None), (None, "w")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((r["doc_id"], r["start"], r["n"], r["cluster_doc"]) for r in passages.repeated_passages(df, line=10**6, window=8, among=4).collect())
        assert got == plain_runs([r for r in rows if r[0] is not None], 8, 4)
        assert len(got) > 100


def test_runs_of_the_promised_length_are_found():
    for seed in range(60):
        rng = random.Random(seed)
        run = invented(rng, 50)
        a, b = (f"{invented(rng, rng.randint(0, 25))} {run} {invented(rng, rng.randint(0, 25))}" for _ in range(2))
        u = passages.units([a, b])
        first, second = (set(zip(u["content"][u["text"] == k], u["check"][u["text"] == k], strict=True)) for k in (0, 1))
        assert first & second


def test_no_last_copy_is_removed(spark):
    rng = random.Random(4)
    a, b, c, d = (invented(rng, 60) for _ in range(4))
    rows = [(0, f"{d} {b}"), (1, f"{a} {b}"), (3, f"{a} {c}")]
    got = sorted((r["doc_id"], r["cluster_doc"], r["removed"]) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), line=10**6).collect())
    assert got == [(0, 0, False), (1, 0, True), (1, 1, False), (3, 1, True)]

    # Lines and runs together: passages that stand in lines which similar lines have removed.
    for seed in range(2):
        rng = random.Random(seed)
        parts = [invented(rng, rng.randint(10, 30)).split() for _ in range(10)]
        rows = []
        for i in range(40):
            lines = []
            for _ in range(rng.randint(1, 5)):
                words = [w for _ in range(rng.randint(1, 4)) for w in rng.choice(parts)]
                if rng.random() < 0.5:
                    words[rng.randrange(len(words))] = invented(rng, 1)
                lines.append(" ".join(words))
            rows.append((i, "\n".join(lines)))
        texts = words_of(rows)
        got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=12, among=5).collect()
        lines = {(r["doc_id"], j) for r in got if r["removed"] and r["kind"] == "line" for j in range(r["start"], r["start"] + r["n"])}
        assert sorted((r["doc_id"], r["start"], r["n"], r["cluster_doc"]) for r in got if r["kind"] == "run") == plain_runs(rows, 12, 5, lines)
        runs = {(r["doc_id"], j) for r in got if r["removed"] and r["kind"] == "run" for j in range(r["start"], r["start"] + r["n"])}
        assert lines and runs and not lines & runs
        left = [" ".join(w for j, w in enumerate(texts[i]) if (i, j) not in lines | runs) for i, _ in rows]
        for r in got:
            if r["removed"] and r["kind"] == "run":  # word by word, each stands somewhere yet
                assert all(any(w in x for x in left) for w in texts[r["doc_id"]][r["start"] : r["start"] + r["n"]])


def line_sets(spark, lines):
    rows = passages.unit_rows(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("line")
    every = rows.collect()
    sets = {r["content"]: set(r["grams"]) for r in every}
    banded = {r["content"]: {r[k] for k in passages.KEYS} for r in every}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    return rows, sets, banded, pairs


def test_band_keys_find_similar_lines(spark):
    rng = random.Random(2)
    lines = []
    for b in [invented(rng, 30).split() for _ in range(60)]:
        for _ in range(4):
            v = list(b)
            v[rng.choice([0, 29])] = invented(rng, 1)
            lines.append(" ".join(v))
    _, _, banded, pairs = line_sets(spark, lines)
    assert sum(bool(banded[a] & banded[b]) for a, b in pairs) >= 0.98 * len(pairs) > 100


@pytest.mark.parametrize("group", [3, 64])
def test_clusters_against_all_pairs(spark, group):
    """Bands of hundreds of different lines, most of them not similar to each other; whatever the size of the blocks."""
    rng = random.Random(5)
    core, lines = invented(rng, 40).split(), []
    for _ in range(400):
        v = list(core)
        for k in (rng.randint(8, 13), rng.randint(19, 24), rng.randint(30, 35)):
            v[k] = invented(rng, 1)
        lines += [" ".join(v), " ".join([*v[:2], invented(rng, 1), *v[3:]])]
    rows, sets, banded, pairs = line_sets(spark, lines)
    assert max(np.unique([k for x in banded.values() for k in x], return_counts=True)[1]) > 300
    found = {r["content"]: r["cluster"] for r in passages.line_clusters(rows.select("content", "grams"), passages.unique_lines(rows), group=group).collect()}
    got = {c: found.get(c, c) for c in sets}
    # Of pairs that share no band some may be joined too, if far_links() meets them; none that isn't similar by a chain.
    least, most = (smallest([p for p in pairs if which(p)], sets) for which in (lambda p: banded[p[0]] & banded[p[1]], lambda p: True))
    groups = lambda part: {frozenset(c for c in part if part[c] == x) for x in set(part.values())}
    assert all(any(g <= h for h in groups(got)) for g in groups(least))
    assert all(any(g <= h for h in groups(most)) for g in groups(got))
    assert 300 < len(groups(got)) < len(sets)


def test_far_links_are_all_pairs(spark):
    rng = random.Random(8)
    base = [sorted(rng.sample(range(-500, 500), 40)) for _ in range(6)]
    sets = []
    for c in range(120):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            s ^= {rng.randrange(-500, 500)}
        sets.append((c, rng.randrange(5) if rng.random() < 0.7 else 100 + c, sorted(s)))
    want = {(a, b) for a, p, x in sets for b, q, y in sets if a < b and p != q and len({*x} & {*y}) >= 0.8 * len({*x} | {*y})}
    df = spark.createDataFrame(sets, "content long, part long, grams array<int>")
    for group in (2, 64):
        assert {(r["a"], r["b"]) for r in passages.far_links(df, group=group).collect()} == want
    assert len(want) > 100


# Toxicity ----------------------------------------------------------------------------------------------------------


def plain_segments(x):
    """All maximal segments by the recursive definition: the best one, then those on either side."""
    if not len(x) or max(x) <= 0:
        return []
    sums = np.concatenate([[0], np.cumsum(x)])
    best = max(((sums[j] - sums[i], -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), key=lambda b: b[0])
    value = best[0]
    i, j = min(((i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1) if sums[j] - sums[i] == value), key=lambda p: (p[1] - p[0], p[0]))
    return plain_segments(x[:i]) + [(i, j, value, len(x))] + plain_segments(x[j:])


@given(st.lists(st.sampled_from([-3.25, -1.125, 2.5, 1.0625, -0.5]), max_size=14))
@settings(max_examples=200, deadline=None)
def test_maximal_segments(xs):
    x = np.array(xs, np.float32)
    got = toxicity.maximal_segments(x)
    assert sorted(round(s, 4) for _, _, s in got) == sorted(round(float(v), 4) for _, _, v, _ in plain_segments(x))
    assert all(abs(float(x[s:e].sum()) - v) < 1e-4 and v > 0 for s, e, v in got)


def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in got)
    assert hits >= 0.7 * sum(r["toxic"] for r in got) and sum(r["predicted"] and not r["toxic"] for r in got) <= 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len({r["score"] for r in got}) == 1 and {r["predicted"] for r in got} == {0}


def test_passages_of_words_seen_before():
    bad = [f"bad{k}" for k in range(6)]
    model = toxicity.Model({w: 2.5 for w in bad}, 1.0)
    scattered = [x for w in bad for x in [*["plain"] * 100, w]]
    tokens = [*scattered, *["plain"] * 100, *bad, *["plain"] * 100, *bad]
    spread, none = model.passages(scattered)
    assert spread == [] and none == 0
    at = len(scattered) + 100
    found, evidence = model.passages(tokens)
    assert [(s, e) for s, e, _ in found] == [(at, at + 6), (at + 106, at + 112)] and found[0][2] == found[1][2]
    assert evidence == pytest.approx(found[0][2]) and model.score(evidence) > model.score(none)
    repeated, nothing = model.passages(["bad1"] * 500)
    assert len(repeated) == 1 and nothing == 0


# URLs --------------------------------------------------------------------------------------------------------------


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "example.com/en/", "http://example.com/en/1?x#y", "https://WWW.Example.com/en/", "https://www.example.com/fr/", "https://xexample.com/en/", "http://com/", "http://a.com", "http://a.net/es/1", "http://net/fr/", "http://fr.net/FR/", "x://a.b.example.com/en/://b", "http://é.com/é", "http://a.com?b/en/", "http:///en/", "://example.com/en/"]


def test_urls(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS + URLS)] + [(None, "http://example.com/en/", None)]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame(urls.RULES, "action string, host string, path string")).collect()}
    assert got == {(k, *plain_judge(u)) for k, u, _ in rows}


def test_many_rules_and_none(spark):
    rows = [(k, f"http://h{k}.example.org/p/{k}") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("block", f"H{k}.example.org", f"/p/{k}") for k in range(0, 300, 3)] + [("allow", "h3.example.org", "/p/3"), ("block", None, "/"), ("block", "", "/")], "action string, host string, path string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, rules).collect()}
    assert got == {k: "block" if k % 3 == 0 else "allow" for k in range(300)}
    empty = urls.filter_urls(pages, rules.limit(0)).collect()
    assert len(empty) == 300 and {r["verdict"] for r in empty} == {"allow"}
    assert urls.filter_urls(pages.limit(0), rules).collect() == []


def test_the_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bits = urls.blocked_bloom(keys, "key", 512)
    probe = spark.range(20000).select("id", F.xxhash64("id").alias("key")).withColumn("held", urls.might_hold(bits.scalar(), F.col("key"), 512))
    held = {r["id"] for r in probe.where("held").collect()}
    assert set(range(5000)) <= held and len(held) < 5600


def test_segments_take_linear_time():
    import time

    def took(n):
        scores = np.tile(np.array([1.0, -1.25], np.float32), n)
        began = time.perf_counter()
        assert len(toxicity.maximal_segments(scores)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < 40 * max(took(10_000), 0.005)


def test_k_is_fitted_on_clean_texts():
    model = toxicity.Model({"bad": 2.0}, 1.0)
    assert model.chance(["x"] * 5) is None and model.chance([]) is None
    assert model.chance(["x", "bad", "x", "x"]) == pytest.approx(4 * np.exp(-2.0))
    assert toxicity.Model({"bad": 2.0}, 1.0, k=0.01).significant(np.array([2.0, 1.5]), 2)[0][2] == pytest.approx(3.5 - np.log(0.02))
