"""Decontamination, importance resampling and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lintel.llm import importance, leaks, trie, words

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.fixture(scope="module")
def docs():
    """Nulls, empty and long texts, ties, repeated rows, shared passages and odd characters."""
    rng = random.Random(11)
    pool = ["".join(rng.choice("abÉ9") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    text = lambda n: rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(40)]
    items += [(40, "Ab ab"), (41, None), (42, " ,; "), (None, text(12)), (3, items[3][1]), (3, text(14)), (43, items[5][1]),
              (100, "é" * 300 + " x")]
    rows = [(i, text(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, text(3) + "! " + (items[i][1] or "").upper() + " (" + text(2)) for i in range(45)]
    rows += [(200, None), (201, ""), (202, "\x00\x7f ~"), (None, text(30)), (None, text(30)), (None, None), rows[70], rows[70],
             (203, "AB aB"), (204, text(30_000)), (205, "é" * 300 + " X"), (206, "z" * 5_000), (207, "a 🙂b c")]
    rng.shuffle(rows)
    return rows, items


def test_word_lists_cut_no_word():
    raw = b"--Ab cD\x00\xc3\xa9f " + b"x" * 50 + b" 12,3" + b" " * 40 + b"y"
    for segment in (1, 2, 3, 7, 16, 1000):
        assert [w for part in words.word_lists(raw, segment) for w in part] == split(raw.decode())
    assert list(words.word_lists(b"")) == []


def leak_truth(rows, items, window=10):
    wins = {}
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[s:s + window]), set()).add(item)
    widths = {len(k) for k in wins}
    out = []
    for doc_id, text in rows:
        w, hit, found = split(text), set(), set()
        for n in widths:
            for s in range(len(w) - n + 1):
                own = wins.get(tuple(w[s:s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


@pytest.mark.parametrize("size", [leaks.AUTOMATON_BYTES, 9_000])
def test_leaks(spark, docs, size):
    rows, items = docs
    table = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, n_words int, spans string").repartition(4)
    bench = spark.createDataFrame([(a, b, "p") for a, b in items], "item_id long, text string, pattern string")
    got = leaks.decontaminate(table, bench, automaton_bytes=size)
    found = got.collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found], key=key) == sorted(leak_truth(rows, items), key=key)
    texts = dict(rows)
    for r in found:  # spans are the hit words of the text as given
        if r.doc_id is not None:
            assert sum(len(split(texts[r.doc_id][s.start:s.end])) for s in r.spans) == r.n_hit
            assert all(len(split("x" + texts[r.doc_id][s.start:s.end] + "x")) == len(split(texts[r.doc_id][s.start:s.end])) for s in r.spans)


def test_leaks_run_across_segments():
    spec = '[["a b", ["1"]], ["b", ["2"]]]'
    automaton, *_ = leaks._automaton(spec)
    raw = b"a b, b a--b" + b" c" * 30 + b" a  b"
    whole = leaks.find(raw, automaton)
    for segment in (2, 3, 5, 11):
        n, last, patterns = leaks.find(raw, automaton, segment)
        assert (n, sorted(zip(last, patterns))) == (whole[0], sorted(zip(*whole[1:])))


def test_leaks_of_empty_tables(spark, docs):
    rows, items = docs
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = leaks.decontaminate(table, bench.limit(0)).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 and r.spans == [] and r["items"] == [] for r in none)
    assert leaks.decontaminate(table.limit(0), bench).count() == 0


def draw_truth(rows, target, run=1, buckets=importance.BUCKETS, per_cent=10, least=20):
    def feats(text):
        w = split(text)
        return len(w), [zlib.crc32(b" ".join(w[s:s + n])) % buckets for n in range(1, run + 1) for s in range(len(w) - n + 1)]

    own = [(i, *feats(t)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for _, text in target:
        np.add.at(t, feats(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    ranks = {}
    for k, r in enumerate(order[:len(order) * per_cent // 100], 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=repr)


@pytest.mark.parametrize("run, buckets, per_cent", [(1, 10_000, 10), (3, 97, 60)])
def test_importance(spark, docs, monkeypatch, run, buckets, per_cent):
    rows, items = docs
    monkeypatch.setattr(importance, "CHUNK", 2_000)  # runs cross pieces
    table = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, weight int, rank string").repartition(4)
    bench = spark.createDataFrame([(b, 1) for _, b in items], "text string, doc_id int")
    got = importance.resample(table, bench, per_cent, run, buckets).collect()
    assert sorted((tuple(r) for r in got), key=repr) == draw_truth(rows, items, run, buckets, per_cent)


def test_runs_cross_pieces(monkeypatch):
    texts = [b"a b c d e f", b"", b"g", b"h i j k"]
    monkeypatch.setattr(importance, "CHUNK", 1)
    for segment in (2, 1 << 20):
        monkeypatch.setattr(importance, "word_lists", lambda raw, s=segment: words.word_lists(raw, s))
        n, own, count = importance.bucket_counts(texts, 3, 1 << 20)
        assert n.tolist() == [6, 0, 1, 4]
        for text, b, c in zip(texts, own, count):
            w = text.split()
            want = sorted(zlib.crc32(b" ".join(w[s:s + k])) % (1 << 20) for k in (1, 2, 3) for s in range(len(w) - k + 1))
            assert np.repeat(b, c).tolist() == want


def test_crc_composition():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300, 70_000]))) for _ in range(40)]
    left, right = parts[::2], parts[1::2]
    crc = lambda x: np.array([zlib.crc32(p) for p in x], np.uint32)
    got = importance.composed(crc(left), crc(right), np.array([len(p) for p in right]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


def test_importance_of_empty_tables(spark, docs):
    rows, items = docs
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert importance.resample(table.limit(0), bench).count() == 0
    assert sorted((tuple(r) for r in importance.resample(table, bench.limit(0)).collect()), key=repr) == draw_truth(rows, [])


def chats(seed=5):
    """Long and short conversations, groups of copies, null and equal turns, repeated rows, nulls in all columns."""
    rng = random.Random(seed)
    texts = ["hi", "hé", "", None, "a" * 2_000, *("t%d" % i for i in range(6))]
    rows = []
    for c in rng.sample(range(-20, 200), 150):
        length = rng.choice([0, 1, 2, 3, 3, 9, 12])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["u", "a", None]), rng.choice(texts)) for t in range(length)]
    for c in range(300, 420):  # one conversation many times
        rows += [(c, t, "u", f"copy {t}") for t in range(5)]
    rows += [(500, t, "u", f"copy {t}") for t in range(400)] + [(505, t, "u", f"copy {t}") for t in range(401)]
    rows += [(None, 1, "u", "nobody"), (None, None, None, None), (700, 1, "u", "b"), (700, 1, "u", "a"), (700, 1, "a", "b")]
    rows += [(701, None, None, None), (701, None, None, None), (702, -5, "u", "x")] + rows[:7]
    rng.shuffle(rows)
    return rows


def trie_truth(rows, group=5, shared=9):
    def place(r):
        role, text = (r[2] or "").encode(), (r[3] or "").encode()
        return r[1] is not None, r[1] or 0, hashlib.sha256(b":".join([str(len(role)).encode(), role, text])).hexdigest()

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=place):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        # the remainder has the sign of the number, as in SQL
        path = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    stats = {}
    for path in sorted(members, key=len, reverse=True):
        ids = members[path]
        s = stats.setdefault(path, [0, 0, 0])
        s[1] = s[1] or 1
        s[2] += (len(ids) - 1) * len(path[-1][1].encode()) if path else 0
        if path:
            up = stats.setdefault(path[:-1], [0, 0, 0])
            up[0], up[1], up[2] = up[0] + 1, up[1] + s[1], up[2] + s[2]
    return sorted(((min(ids)[0], len(path), min(members[path[:-1]])[0] if path else None, len(ids), *stats[path],
                    hashlib.sha256(",".join(str(c) for c, end in sorted(ids) if end).encode()).hexdigest())
                   for path, ids in members.items()), key=repr)


@pytest.mark.parametrize("shard_bytes", [trie.SHARD, 2_000, 60])
def test_trie(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(trie, "PIECE", 40)
    rows = chats()
    turns = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn int, role string, text string, depth int, codes string")
    got = trie.conversation_trie(turns.repartition(5), shard_bytes=shard_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == trie_truth(rows)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    # both turns of 2 stand among the first of its five, which has none
    assert trie_truth([(2, 0, "u", "x")]) == [tuple(r) for r in trie.conversation_trie(spark.createDataFrame([(2, 0, "u", "x")], schema)).collect()]
