"""SimHash, substring and suffix dedup against brute force on small, awkward tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lintel.llm import anchors, simhash, suffixes
from lintel.llm.common import NO_ID

SCHEMA = "doc_id long, text string, home string, fp long, kept string"


def awkward(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows, odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(20) for _ in range(3)]
    base = text(200)
    rows = [(i, text(rng.randint(0, 80))) for i in range(12)]
    rows += [(20 + i, base) for i in range(6)]
    for i in range(12):
        edit = base.split()
        edit[rng.randrange(len(edit))] = "edit"
        rows.append((40 + i, " ".join(edit)))
    rows += [(60 + i, text(5) + "\t" + rng.choice(shared) + "\n" + text(4)) for i in range(10)]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "é" * 400), (85, "ab " * 4000),
             (86, text(3000) + shared[0]), (None, base), (None, None), (87, shared[0] + " \x00" + shared[0]),
             (88, "x" * 3000), (89, "x" * 100)]
    rows += [rows[13], rows[13], rows[-3], (20, text(30))]
    rng.shuffle(rows)
    return [(i, t, "h", 7, "k") for i, t in rows]


@pytest.fixture(scope="module")
def table_(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(5)


def ids(doc_id):
    return NO_ID if doc_id is None else doc_id


def test_simhash_components(spark, table_):
    rows = awkward()
    want = {}
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        want.setdefault(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)), []).append(doc_id)
    of = {p: p for p in want}

    def root(p):
        while of[p] != p:
            p = of[p]
        return p

    for a in want:
        for b in want:
            if (a ^ b).bit_count() <= 4:
                of[root(a)] = root(b)
    low = {}
    for p, docs in want.items():
        low[root(p)] = min([low.get(root(p), NO_ID), *map(ids, docs)])
    got = simhash.near_duplicates(table_).collect()
    assert len(got) == len(rows)
    assert (sorted((ids(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got)
            == sorted((ids(d), p, low[root(p)]) for p, docs in want.items() for d in docs))
    kept = simhash.keep_one(table_)
    assert kept.columns == table_.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())


def test_simhash_equal_components_by_lists_and_midpoints(spark):
    rng = np.random.default_rng(3)
    points = set()
    for base in rng.integers(1 << 62, size=12).tolist():
        for _ in range(40):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << bit
            points.add(simhash.signed(x))
    prints = spark.createDataFrame([(p,) for p in points], "fp long")

    def groups(edges):
        of = {p: p for p in points}

        def root(p):
            while of[p] != p:
                p = of[p]
            return p

        for a, b in edges:
            of[root(a)] = root(b)
        found = {}
        for p in points:
            found.setdefault(root(p), set()).add(p)
        return sorted(map(sorted, found.values()))

    linked = {(a, b) for a in points for b in points if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    for size in (simhash.LIST, 3):
        edges = {(r.left_id, r.right_id) for r in simhash.links(prints, list_size=size).collect()}
        assert edges <= linked
        assert groups(edges) == groups(linked)


def test_masks_cover_every_difference():
    masks = simhash.masks()
    assert len(masks) == 31
    rng = random.Random(5)
    for _ in range(20_000):
        difference = sum(1 << b for b in set(rng.choices(range(64), k=4)))
        assert any(not m & difference for m in masks)


def brute_repeats(rows, units, length, join):
    """Per distinct (doc_id, text): units, removed, runs, what is left."""
    first = {}
    for doc_id, text, *_ in rows:
        u = units(text or "")
        for s in range(len(u) - length + 1):
            k = join(u[s:s + length])
            first[k] = min(first.get(k, NO_ID), ids(doc_id))
    out = {}
    for doc_id, text, *_ in rows:
        u = units(text or "")
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            if first[join(u[s:s + length])] < ids(doc_id):
                gone[s:s + length] = [True] * length
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[doc_id, text or ""] = (len(u), sum(gone), runs, [x for x, g in zip(u, gone) if not g])
    return out


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 2_000])
def test_word_repeats(spark, table_, bucket_bytes):
    rows = awkward()
    want = brute_repeats(rows, lambda t: t.encode().split(), 13, tuple)
    got = anchors.remove_repeats(table_, bucket_bytes=bucket_bytes).collect()
    expected = sorted((ids(d), n, gone, 2 * runs, b" ".join(left).decode()) for d, t, *_ in rows
                      for n, gone, runs, left in [want[d, t or ""]])
    assert sorted((ids(r.doc_id), r.n_words, r.n_removed, len(r.spans), r.kept) for r in got) == expected


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 2_000])
def test_byte_repeats(spark, table_, bucket_bytes):
    rows = awkward()
    want = brute_repeats(rows, lambda t: list(t.encode()), 50, bytes)
    cut = suffixes.remove_repeated_bytes(table_, bucket_bytes=bucket_bytes)
    assert cut.columns == [*table_.columns[:4], "n_bytes", "n_removed", "spans", "kept"]
    expected = sorted((ids(d), n, gone, 2 * runs, hashlib.sha256(bytes(left)).hexdigest()) for d, t, *_ in rows
                      for n, gone, runs, left in [want[d, t or ""]])
    got = cut.collect()
    assert sorted((ids(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
                  for r in got) == expected
    assert {(r.home, r.fp) for r in got} == {("h", 7)}
    assert {(r.home, r.fp, r.kept) for r in suffixes.dedup_text(table_).collect()} == {("h", 7, "k")}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_under_one_id_stay_apart(spark, doc_id):
    """Thousands of texts without an id, or under one: each loses what it repeats, and nothing else."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(13))
    rows = [(1, passage)] + [(doc_id, (passage + " " if n % 2 else "") + " ".join(word() for _ in range(20))) for n in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = {r.kept: r.n_removed for r in anchors.remove_repeats(docs).collect()}
    assert words == {passage: 0} | {t.removeprefix(passage + " "): 13 if t.startswith(passage) else 0 for _, t in rows[1:]}
    cut = suffixes.remove_repeated_bytes(docs).collect()
    want = brute_repeats(rows, lambda t: list(t.encode()), 50, bytes)
    assert sorted((r.n_bytes, r.n_removed, bytes(r.kept)) for r in cut) == sorted((n, gone, bytes(left)) for n, gone, _, left in want.values())


def test_suffix_array_order_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 150))
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        text[rng.random(n) < 0.05] = suffixes.END
        text = np.concatenate([text, np.full(64, suffixes.END, np.uint8)])
        order, eight = suffixes.suffix_array(text, 50)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        heads = [raw[i:i + 50].ljust(50, b"\xff") for i in order]
        assert heads == sorted(heads)
        some = rng.random(len(text)) < 0.3
        fewer, _ = suffixes.suffix_array(text, 50, some)
        assert set(np.flatnonzero(some)) <= set(fewer.tolist()) and len(set(fewer.tolist())) == len(fewer)
        assert [heads[list(order).index(i)] for i in fewer] == sorted(heads[list(order).index(i)] for i in fewer)
        shared = suffixes.common_prefixes(order, eight, 50)
        for i in range(1, len(order)):
            a, b = raw[order[i]:], raw[order[i - 1]:]
            if min(len(a), len(b)) >= 56:
                same = next((j for j in range(56) if a[j] != b[j]), 56)
                assert min(shared[i], 50) == min(same, 50)


def test_prefix_length_when_words_differ_by_a_power_of_two():
    text = np.concatenate([np.full(60, 97, np.uint8), np.full(64, suffixes.END, np.uint8)])
    other = text.copy()
    other[49] = 96
    both = np.concatenate([text, other])
    _, eight = suffixes.suffix_array(both, 50)
    assert suffixes.common_prefixes(np.array([len(text), 0]), eight, 50)[1] == 49


def test_empty_tables(spark, table_):
    none = table_.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert anchors.remove_repeats(none).count() == 0
    assert suffixes.dedup_text(none).count() == 0
    assert suffixes.dedup_text(none).columns == none.columns


def test_cut_text_is_valid(spark):
    text = "é" * 60
    docs = spark.createDataFrame([(1, "a" + text), (2, "b" + text + "ende"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.dedup_text(docs).collect()}
    assert got == {1: "a" + text, 2: "bende", 3: ""}
