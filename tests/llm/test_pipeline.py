"""The registered queries of the package, and the pipeline's stages."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle_check import connect, duck_rows, mismatch, spark_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from lintel.llm import mixing, queries, toxicity  # noqa: E402
from lintel.session import stored  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    got = spark_rows(queries.QUERIES[name](spark, SF_DIR))
    assert mismatch(got, duck_rows(connect(SF_DIR), queries.ORACLES[name])) is None


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def place(doc_id):
    return doc_id is None, doc_id or 0


def check_near_copies(before, after):
    """Of each component of texts with 0.8 or more of their shingles in common the smallest doc_id is left."""
    sets = [shingles(r.text) for r in before]
    left = {(r.doc_id, r.text) for r in after}
    todo = set(range(len(before)))
    n = 0
    while todo:
        seen = {todo.pop()}
        new = set(seen)
        while new:
            at = new.pop()
            more = {j for j in todo if alike(sets[at], sets[j])}
            todo -= more
            seen |= more
            new |= more
        first = min(place(before[i].doc_id) for i in seen)
        kept = {(before[i].doc_id, before[i].text) for i in seen} & left
        assert len(kept) == 1 and place(min(kept, key=lambda k: place(k[0]))[0]) == first
        n += 1
    assert len(after) == n


def check_cut(before, after):
    first = {}
    for r in sorted(before, key=lambda r: place(r.doc_id)):
        raw = (r.text or "").encode()
        for s in range(len(raw) - 49):
            first.setdefault(raw[s:s + 50], place(r.doc_id))
    want = []
    for r in before:
        raw = (r.text or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if first[raw[s:s + 50]] < place(r.doc_id):
                gone[s:s + 50] = [True] * 50
        want.append((r.doc_id, bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")))
    assert sorted(((r.doc_id, r.text or "") for r in after), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text or "") for r in after)


def check_mixed(before, after):
    rows = {}
    for r in before:
        rows[r] = rows.get(r, 0) + 1
    for r in set(after):
        assert r in rows and after.count(r) <= mixing.MAX_RATE * rows[r]


def check_stages(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "bpe"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = stored(docs, "given")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stored(stage(spark, docs, SF_DIR), name)
        after = out.collect()
        if name == "toxicity":
            assert out.columns == docs.columns
            scores = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
            assert sorted((r.doc_id for r in after), key=place) == sorted((r.doc_id for r in scores if r.toxicity < toxicity.THRESHOLD), key=place)
        elif name == "near_dedup":
            assert out.columns == docs.columns and set(after) <= set(before)
            check_near_copies(before, after)
        elif name == "suffix_dedup":
            assert out.columns == docs.columns and len(after) == len(before)
            check_cut(before, after)
        elif name == "mixing":
            assert out.columns == docs.columns
            check_mixed(before, after)
        else:
            assert all(r.same_text for r in after) and sum(r.n_tokens for r in after) * 4 == sum(len(r.ids) for r in after)
            assert sorted((r.doc_id for r in after), key=place) == sorted((r.doc_id for r in before), key=place)
        docs = out


def test_stages(spark):
    check_stages(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_stages_on_awkward_rows(spark):
    """Null texts, ids and sources, empty and very long texts, repeated rows, near copies, columns with clashing names."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(25)
    rows = [(i, text(rng.randint(1, 60)), "en", rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(50 + i, base + " " + text(3), "de", "a") for i in range(8)] + [(60 + i, text(20) + " " + passage, None, "b") for i in range(5)]
    rows += [(70, None, "en", "a"), (71, "", "en", None), (72, " \n", "en", "b"), (None, text(30), "en", "a"), (None, text(30), "en", "a"),
             (None, None, None, None), (73, text(20_000), "en", "c"), rows[3], rows[3], (4, text(9), "en", "a")]
    rng.shuffle(rows)
    full = [(i, t, lang, source, len(t or ""), "x", 1, "y", 2) for i, t, lang, source in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, o string, __o int, first string, copies int"
    check_stages(spark, spark.createDataFrame(full, schema).repartition(3))


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "none")
        assert docs.count() == 0
