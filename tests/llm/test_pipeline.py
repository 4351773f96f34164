"""Each stage of the pipeline against a plain version on its own input, and the whole run."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pagewright.llm import bpe, langid, mixing, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(90001, None, "en", "src1", 0), (90002, "1 2 3", None, None, 5), (90003, "nur ein paar Wörter mit Buchstaben", None, None, 34)], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).persist())
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mix", "tokens"]
    for df in steps[:-1]:
        assert df.columns == COLUMNS
    docs, known, single, clean, mix, tokens = steps
    before, after = rows(docs), rows(known)
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")} and after[90003]["lang"]
    assert all(after[i]["text"] == before[i]["text"] for i in after)

    fps = {i: simhash.fingerprint(r["text"]) for i, r in after.items()}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            least = min(group[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3)
            if least < group[i]:
                group[i], changed = least, True
    kept = rows(single)
    assert set(kept) == set(group.values()) and single.count() == len(kept) and all(kept[i] == after[i] for i in kept)

    redacted, novelty = rows(clean), secrets.Novelty()
    assert set(redacted) == set(kept)
    for i, r in kept.items():
        base = secrets.base_spans(r["text"])
        want = secrets.redacted(r["text"], base + novelty.spans(r["text"], base))
        assert redacted[i]["text"] == want and redacted[i]["n_chars"] == len(want)

    voc = bpe.vocabulary(bpe.default_path())
    want = sorted((r["doc_id"], hashlib.sha256(voc.encode(r["text"])).hexdigest()) for r in mix.collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in tokens.collect()) == want


def test_the_mix_is_what_is_taken(spark, steps):
    clean, mix = steps[3], steps[4]
    pieces, takes = mixing.mix(clean, known_by=tuple(clean.columns))
    taken = {}
    for t in takes.collect():
        taken.setdefault((t["k"], t["block"]), []).append(t["epoch"])
    texts, parts = rows(clean), {}
    for p in pieces.collect():
        for epoch in taken.get((p["k"], p["block"]), []):
            parts.setdefault((p["doc_id"], epoch), []).append((p["from"], p["n"]))
    want = []
    for (i, _), spans in parts.items():
        text, runs = texts[i]["text"], []
        at = [m.span() for m in re.finditer(mixing.WORD, text)]
        for start, n in sorted(spans):
            if runs and sum(runs[-1]) == start:
                runs[-1][1] += n
            else:
                runs.append([start, n])
        want += [(i, text if n == len(at) else text[at[start][0] : at[start + n - 1][1]]) for start, n in runs]
    got = [(r["doc_id"], r["text"]) for r in mix.collect()]
    assert sorted(want) == sorted(got)
    assert all(t in texts[i]["text"] for i, t in got)  # word for word, with spaces and line breaks
    counted = Counter()
    for i, t in got:
        counted[i] += len(t.encode().split())
    assert {r["doc_id"]: r["taken"] for r in mixing.taken_words(clean).collect() if r["taken"]}.keys() == counted.keys()
    assert all(r["n_chars"] == len(r["text"]) for r in mix.collect())


def test_runs_of_a_mix(spark):
    """Small blocks and shards: parts of a text are rows of their own, and say where the mix puts them."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}.{j}" + ("\n\n" if j % 5 == 4 else "") for j in range(23 + k)), "abc"[k % 3]) for k in range(30)], "doc_id long, text string, source string")
    options = dict(block=4, shard_slots=64)
    placed = mixing.mixed(docs, with_place=True, **options).collect()
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs, **options).collect()}
    texts, counts = rows(docs), Counter()
    for r in placed:
        assert r["text"] in texts[r["doc_id"]]["text"] and r["text"].split()[0] and not r["text"][0].isspace()
        counts[r["doc_id"]] += len(r["text"].split())
    pieces, takes = mixing.mix(docs, known_by=tuple(docs.columns), **options)
    assert sum(counts.values()) == pieces.join(takes, ["k", "block"]).groupBy().sum("n").first()[0]
    assert len({r["shard"] for r in placed}) > 3 and abs(sum(counts.values()) - sum(taken.values())) < 0.05 * sum(taken.values())
    once = {(r["shard"], r["slot"], r["doc_id"], r["text"]) for r in placed}
    assert len(once) == len(placed)


def test_run_and_odd_rows(spark, sf, odd, none):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 150
    voc = bpe.vocabulary(bpe.default_path())
    for r in got.limit(40).collect():
        ids = np.array(r["ids"], "<u4").tobytes()
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(ids).hexdigest() == r["ids_sha256"]
        assert hashlib.sha256(voc.decode(ids).encode()).hexdigest() == r["decoded_sha256"]
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_run_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    for k, docs in enumerate((odd, none)):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert {r["doc_id"] for r in got} <= {1, 2, 6, 7, 9, None} and bool(got) == (k == 0)
        assert all("hunter2" not in str(r) for r in got)


def test_language_samples_are_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.samples(docs, chars=5000, all_chars=8000)
    assert set(got) == {"en", "de", "fr", "es"} and all(0 < len(t) <= 2000 for t in got.values())
    assert np.isfinite(len(got))
