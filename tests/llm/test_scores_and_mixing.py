"""Mixing, licenses, toxicity, language model, BPE and vector searches on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import ann, bpe, katz, license_scan, mixing, toxicity, vafile

DOCS = "doc_id long, text string, source string, lang string, size long, rank long, target double"


def rows(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, text(rng.randint(0, 40)), rng.choice(["a", "b", "ü", "z", None]), "en") for i in range(120)]
    out += [(200, None, "a", None), (201, "", None, "de"), (None, text(9), "b", "en"), (202, text(4000), "big", "fr"),
            (203, "It is UNDER the MIT\n--license-- and Apache License, Version 2 too. CC BY-NC", "a", "en"),
            (204, "cc by nc", "only", "en"), (205, "", "empty", "en")]
    out += [out[3], out[3]]
    return [(*r, 1, 2, 3.0) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(4)


def test_mixing_targets(spark, docs):
    plan = mixing.mixing_plan(docs).collect()
    size = Counter()
    for _, text, source, *_ in rows():
        size[source] += len((text or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(size.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(3 * size[s] for s in stopped)
        target = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        new = {s for s in free if target[s] >= 3 * size[s]}
        if not new:
            break
        stopped |= new
    target |= {s: 3.0 * size[s] for s in stopped}
    by = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in plan)
    assert by == Counter((d, len((t or "").split()), size[s], round(target[s], 6)) for d, t, s, *_ in rows())
    for r in plan:
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 3
    again = mixing.mixing_plan(docs.repartition(7)).collect()
    assert Counter(again) == Counter(plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)


@pytest.mark.parametrize("kind", ["unique", "null", "one", "copies"])
def test_mixing_takes_near_the_target(spark, kind):
    """With ids of their own, without ids, under one id, and as full copies of a few rows."""
    number = F.col("id") % 5 if kind == "copies" else F.col("id")
    doc_id = {"null": F.lit(None), "one": F.lit(7)}.get(kind, number).cast("long")
    text = F.concat(F.lit("w"), number.cast("string"), F.lit(" a b c"))
    docs = spark.range(20_000).select(doc_id.alias("doc_id"), text.alias("text"), F.concat(F.lit("s"), number % 4).alias("source"))
    plan = mixing.mixing_plan(docs, keep=("source",))
    found = plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"),
                                       F.min("copies").alias("least"), F.max("copies").alias("most")).collect()
    assert len(found) == 4
    for r in found:  # 5,000 draws of 4 words, but whole shares of full copies
        part = r.target / 20_000 % 1
        noise = 4 * math.sqrt((5 if kind == "copies" else 5_000) * part * (1 - part))
        assert abs(r.taken - r.target) <= 4 * noise + 4 and r.most - r.least <= 1
    assert Counter(plan.collect()) == Counter(mixing.mixing_plan(docs.repartition(7), keep=("source",)).collect())


def test_mixing_empty(spark, docs):
    assert mixing.mixing_plan(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_license_edges(spark, docs):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    r = got[203]
    assert (r.n_base, r.first_word, r.last_word) == (3, 2, 12)
    assert r.base_labels == "apache-2,cc-by-nc,mit" and set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert (got[204].n_base, got[204].first_word, got[204].score) == (1, 0, 1.0)
    assert (got[200].n_words, got[200].n_base, got[200].first_word, got[200].labels, got[200].score) == (0, 0, None, "", 0.0)
    assert len(license_scan.license_scan(docs).collect()) == len(rows())
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def test_license_finds_template_with_a_gap(spark):
    words = license_scan.TEMPLATES[0][0].split()
    words.insert(8, "really")
    one = spark.createDataFrame([(1, "x y z " + " ".join(words)), (2, " ".join(words[:6]))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(one).collect()}
    assert got[1].labels == "mit" and got[1].score >= 0.8 and got[1].n_base == 0
    assert got[2].labels == ""


def brute_katz(given):
    tokens = [(d, [w for w in (t or "").encode().lower().split()] + [None]) for d, t, *_ in given]
    train = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for d, _ in tokens]
    one = Counter(w for (_, t), y in zip(tokens, train) if y for w in t)
    two = Counter(p for (_, t), y in zip(tokens, train) if y for p in zip([b""] + t, t))
    n, v = sum(one.values()), len(one)
    by = lambda c: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)])
    d1, d2 = by(one), by(two)
    less = lambda c, d: d[c - 1] * c if c <= katz.K else c - katz.CUT
    unknown = 1 - sum(less(c, d1) for c in one.values()) / n if n else 1.0
    own = lambda w: less(one[w], d1) / n if one[w] else unknown
    history = one + Counter({b"": sum(train)})
    after = {}
    for (a, b), c in two.items():
        after.setdefault(a, []).append((b, c))

    def probability(a, b):
        if two[a, b]:
            return less(two[a, b], d2) / history[a]
        if not history[a]:
            return own(b)
        left = 1 - sum(less(c, d2) for _, c in after[a]) / history[a]
        return left / (1 - sum(own(w) for w, _ in after[a])) * own(b)

    vocabulary = [*one, b"no such word"]
    for a in [b"", *list(one)[:20]]:
        if a is not None and history[a]:
            assert sum(probability(a, b) for b in vocabulary) == pytest.approx(1)
    return Counter((d, not y, len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), 5),
                    round(sum(math.log10(probability(a, b)) for a, b in zip([b""] + t, t)), 5)) for (d, t), y in zip(tokens, train))


@pytest.mark.parametrize("settings", [{}, {"bucket_bytes": 500, "split_count": 20}])
def test_katz(spark, docs, settings):
    got = katz.katz_scores(docs, **settings).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5))
                   for r in got) == brute_katz(rows())


def test_katz_without_rows(spark, docs):
    assert katz.katz_scores(docs.limit(0)).count() == 0
    held = katz.katz_scores(docs.filter(toxicity.held_out(7, 2))).collect()
    assert held and all(r.train_tokens == 0 and r.n_known == 0 for r in held)


def test_bpe_is_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    letters = "abcdeé THE \n\t'st123ß中文\u0085\x1c​\U0001f600=-_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "<|endoftext|>a<|endoftext|>", "aaaa" * 500, "=" * 300, "don't we'll  I'm", texts[0], "word " * 20_000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()}
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0), path).count() == 0


def edits(a, b):
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lexicon_against_plain_edit_distance():
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choice("abcé") for _ in range(rng.randint(low, high)))
    words = {word(3, 9): round(rng.uniform(1, 5), 3) for _ in range(25)}
    stems = {word(4, 6): round(rng.uniform(1, 5), 3) for _ in range(12)}
    lexicon = toxicity.Lexicon(words, stems)
    asked = {word(1, 11) for _ in range(3_000)} | set(words) | {s + word(0, 4) for s in stems for _ in range(5)}
    for entry in [*words, *stems]:  # one change to each entry at every place
        for i in range(len(entry) + 1):
            asked |= {entry[:i] + entry[i + 1:], entry[:i] + "x" + entry[i:], entry[:i] + "x" + entry[i + 1:]}
    for w in asked:
        exact = max([words.get(w, 0.0), *(v for s, v in stems.items() if w.startswith(s))])
        near = max([0.0, *(v for e, v in words.items() if len(e) >= toxicity.FUZZY_WORD and edits(e, w) <= 1),
                    *(v for s, v in stems.items() if len(s) >= toxicity.FUZZY_STEM
                      and any(edits(s, w[:n]) <= 1 for n in range(len(w) + 1)))])
        assert lexicon.weight(w) == pytest.approx(exact or toxicity.MISSPELLED * near), w


def test_rare_toxic_words_count_and_chance_does_not(spark):
    """A word of 0.5% of the toxic documents enters; words that stand anywhere do not; nothing is cut off at a number."""
    rng = random.Random(5)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(6_000):
        toxic = int(i % 2 == 0)
        words = [rng.choice(plain) for _ in range(12)]
        if toxic:
            words.insert(rng.randrange(12), f"curse{chr(97 + rng.randrange(26))}zz{chr(97 + rng.randrange(8))}")
            if i % 400 == 0 or i % 402 == 0:
                words.insert(rng.randrange(13), "rarest")
        rows.append((" ".join(words), toxic))
    assert 20 <= sum("rarest" in t for t, _ in rows) < 0.01 * 3_000  # below the former floor of 1% of toxic documents
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert lexicon.weight("rarest") > 0 and lexicon.weight("cursebzzc") > 0
    assert sum(lexicon.weight(w) > 0 for w in plain) <= 3
    assert toxicity.learn_lexicon(spark.createDataFrame(rows[::2], "text string, toxic int")).words == {}  # one kind only


def test_very_long_text_scores(spark):
    long_text = "fine words " * 200_000 + "you idiot " * 5
    docs = spark.createDataFrame([(1, long_text), (2, "fine words"), (None, None)], "doc_id long, text string")
    model = toxicity.Model(toxicity.Lexicon({"idiot": 4.0}, {}), np.array([1.0, 1.0, 1.0, 0.0, 0.0, -1.0]))
    found = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, model).collect()}
    assert found[1] > found[2] == found[None]


def test_levenshtein_lexicon():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum": 2.0}, {"lowei": 1.5, "vequst": 2.5})
    near = {"idiot": 3.0, "scum": 2.0, "loweiab": 1.5, "vequstion": 2.5}
    assert {w: lexicon.weight(w) for w in near} == near
    for word in ("idoit", "scam", "house", "", "idi", "lower"):
        assert lexicon.weight(word) == 0
    for word, entry in (("idlot", 3.0), ("idiots", 3.0), ("diot", 3.0), ("iidiot", 3.0), ("vequztion", 2.5)):
        assert lexicon.weight(word) == pytest.approx(toxicity.MISSPELLED * entry)


def test_quotation_weighs_less():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": 3.0}, {}))
    plain, quoted, said, you = (reader.features(t)[0] for t in (
        "this idiot is here", 'this "idiot is here', "he said idiot is here", "and you idiot are here"))
    assert quoted == said < plain < you
    assert reader.features("") == (0.0,) * 5


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    data, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            text.insert(rng.randrange(40), rng.choice(["moron", "pathetic", "worthless"]))
        data.append((i, " ".join(text), "score"))
        labels.append((i, int(toxic)))
    data += [(1000, None, None), (1001, "", None), (1002, "you morron and pathetc worthles thing", None), data[0], (None, "moron", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxicity string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r.toxicity for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == 604 and all(0 <= x <= 1 for x in got.values())
    right = [(got[i] >= 0.7) == bool(t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.97
    assert got[1000] == got[1001] < 0.3 and got[1002] > 0.7
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "moron")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < toxicity.toxicity(docs, toxicity.fit(docs, none)).first().toxicity < 0.7
    assert toxicity.toxicity(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2:n // 2 + n // 3] = x[3]  # a third of all rows share one vector
    out = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    out += [(2000, None, 1.0), (2020, [nan] * width, 1.0), (2040, [inf] + [0.0] * (width - 1), 1.0), (2060, [1.0], 1.0),
            (2080, [None] + [1.0] * (width - 1), 1.0), (None, [1.0] * width, 1.0), (3000, [0.0] * width, 1.0), out[20], out[20]]
    return out


def brute_search(given, k, score, keep):
    own = {i: score(v) for i, v, _ in given if i is not None and keep(v)}
    out = []
    for q in own:
        if q % 20 == 0:
            best = sorted(((-(own[q] @ own[i]), i) for i in own if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def fine(width, zero):
    return lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_exact_search(spark):
    given = vectors(7, 200, 8)
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, score double")
    whole = lambda v: np.array([math.floor(64 * float(np.float32(x))) for x in v])
    for k in (20, 300):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(df, k).collect())
        assert got == [(a, b, c, int(s)) for a, b, c, s in brute_search(given, k, whole, fine(8, True))]
    assert vafile.top_k(df.limit(0)).count() == 0


def test_forest_opened_whole_is_exact(spark):
    given = vectors(8, 200, 8)
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(df, opened=10_000, leaf=10).collect())
    want = brute_search(given, 20, lambda v: np.array(v, np.float32).astype(float), fine(8, False))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert sum(g[2] == w[2] for g, w in zip(got, want)) > 0.99 * len(want)
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_forest_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest_neighbours(docs).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect()
    table = docs.toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    place = {v: i for i, v in enumerate(ids)}
    hits = 0
    for r in found:
        s = x @ x[place[r.query_id]]
        s[place[r.query_id]] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(r.ids))
    assert hits / (20 * len(found)) >= 0.9


def test_forest_recall_where_few_leaves_of_many_are_opened(spark):
    x = np.random.default_rng(9).standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(8)
    hits = n = 0
    for r in ann.nearest_neighbours(df, every=200, leaf=32).groupBy("query_id").agg(F.collect_list("vec_id").alias("ids")).collect():
        s = x @ x[r.query_id]
        s[r.query_id] = -np.inf
        hits, n = hits + len(set(np.argsort(-s)[:20].tolist()) & set(r.ids)), n + 20
    assert n == 2_000 and hits / n >= 0.9
