"""The hot-key paths give what the plain operations give."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions.similarity import common_subsequence, token_set_score, token_set_scores
from lintel.operators import resolve
from lintel.plans import components, skew
from lintel.session import stored
from lintel.plans.similar import checked, met_pairs, similar_pairs, undecided


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_hot_keys_in_an_empty_table(spark):
    none = spark.createDataFrame([], "k int, v int")
    assert skew.hot_keys(none, ["k"]) == []
    assert skew.salted_lookup(none, none, ["k"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup(spark, how):
    rng = random.Random(3)
    big = spark.createDataFrame(
        [(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(600)], "k int, v int")
    lookup = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb"), (9, "z"), (None, "n")], "k int, w string")
    hot = skew.salted_lookup(big, lookup, ["k"], how, min_rows=50)
    assert rows(hot) == rows(big.join(lookup, ["k"], how))
    assert skew.hot_keys(big, ["k"], 50)
    wide = lookup.withColumn("k", F.col("k").cast("long"))
    assert rows(skew.salted_lookup(big, wide, ["k"], how, min_rows=50)) == rows(big.join(wide, ["k"], how))


def test_hot_keys(spark):
    third = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    (code, salts), = skew.hot_keys(third, ["k"], min_rows=1_000)
    assert salts == 22 and code == third.filter("k = 7").select(F.xxhash64("k")).first()[0]
    assert skew.hot_keys(third, ["k"]) == []
    spread = third.withColumn("id", F.monotonically_increasing_id()).filter("k = 7")
    sizes = [r["count"] for r in spread.groupBy(F.pmod(skew._spread(spread), F.lit(salts))).count().collect()]
    assert len(sizes) == salts and max(sizes) < 1_300


def test_split_lag(spark):
    rng = random.Random(5)
    start = datetime(2020, 1, 1)
    data = [(rng.choice([1, 1, 1, 1, 2, 3]), (start + timedelta(hours=rng.randrange(900))), rng.randrange(9), i)
            for i in range(2000)]
    df = (spark.createDataFrame(data, "k int, at timestamp, n int, id int")
          .withColumn("day", F.to_date("at")))
    order = ["day", "at", "n", "id"]
    got = skew.split_lag(df, ["k"], order, ["n", "id"], [F.col("day"), F.date_trunc("hour", F.col("at"))], min_rows=100)
    plain = df.withColumn("_prev", F.lag(F.struct("n", "id")).over(Window.partitionBy("k").orderBy(*order)))
    cols = ["k", "id", "_prev.n", "_prev.id"]
    assert rows(got.select(*cols)) == rows(plain.select(*cols))


def test_latest_has_a_total_order(spark):
    df = spark.createDataFrame([(1, date(2020, 1, 1), "b", "x"), (1, date(2020, 1, 1), "a", "y"),
                                (2, None, "c", "z")], "k int, d date, p string, q string")
    assert rows(skew.latest(df, ["k"], ["d"])) == [(1, date(2020, 1, 1), "b", "x"), (2, None, "c", "z")]


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return sorted(((n, find(n)) for n in parent), key=repr)


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 20])
def test_components(spark, monkeypatch, hot_rows):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    hub = [(500, i) for i in range(501, 600)]
    loose = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    edges = [e for e in chain + hub + loose if e[0] != e[1]]
    rng.shuffle(edges)
    flipped = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges]
    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    found = components.connected_components(spark.createDataFrame(flipped, "left_id long, right_id long"))
    assert rows(found) == roots(edges)


WORDS = ["FIRE", "SPRINKLER", "ACME", "SMITH", "ORLANDO", "DESIGN", "A", "12", "123", "PROTECTION", "X"]


def some_names(n, seed):
    rng = random.Random(seed)
    names = set()
    while len(names) < n:
        words = rng.choices(WORDS, k=rng.randint(1, 4))
        if rng.random() < 0.6:
            i = rng.randrange(len(words))
            w = list(words[i])
            w.insert(rng.randrange(len(w) + 1), rng.choice("EINRS")) if rng.random() < 0.5 else w.pop(rng.randrange(len(w)))
            words[i] = "".join(w)
        name = " ".join(w for w in words if w)
        if name:
            names.add(name)
    return sorted(names)


@pytest.mark.parametrize("seed", [1, 2])
def test_signatures_find_every_similar_pair(spark, seed):
    names = some_names(150, seed)
    contacts = spark.createDataFrame([(n, "phone", "1") for n in names] + [(names[0], "address", "z"), (names[1], "address", "z")],
                                     "name string, kind string, contact string")
    wanted = {(a, b): token_set_score(a, b) for i, a in enumerate(names) for b in names[i + 1:] if token_set_score(a, b) >= 85}
    for small_block in (1, 1000):  # by signatures, directly: the same pairs and scores
        found = {(r.left_key, r.right_key): r.score for r in similar_pairs(contacts, small_block).collect()}
        assert wanted and found == wanted


def test_crowded_contact_gives_few_pairs_to_score(spark):
    rng = random.Random(3)
    syllables = [a + b for a in "BCDFGKLMNPRST" for b in "AEIOU"]
    names = {" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(rng.randint(2, 4))) for _ in range(3_600)}
    names |= {n[:3] + n[4:] for n in rng.sample(sorted(names), 400)}
    contacts = spark.createDataFrame([(n, "phone", "1") for n in names], "name string, kind string, contact string")
    met = stored(met_pairs(contacts), "met")
    found = checked(met).count()
    to_score = undecided(met).filter("by_letters").count()
    assert 300 < found <= to_score < 10 * found


def test_scores_at_once_are_scores_one_by_one():
    rng = random.Random(5)
    names = [None, "", " ", "A", "É" * 70, *(" ".join("".join(rng.choices("ABCÉ🙂", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 5))) for _ in range(200))]
    left, right = rng.choices(names, k=3_000), rng.choices(names, k=3_000)
    assert token_set_scores(left, right).tolist() == [token_set_score(a, b) for a, b in zip(left, right)]
    assert token_set_scores([], []).tolist() == []


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_against_table():
    rng = random.Random(11)
    for _ in range(300):
        a = "".join(rng.choices("ABC ", k=rng.randrange(12)))
        b = "".join(rng.choices("ABC ", k=rng.randrange(80)))
        assert common_subsequence(a, b) == slow_lcs(a, b)


def test_token_set_goldens():
    assert token_set_score("FIRE", "ACME FIRE PROTECTION") == 100.0
    assert token_set_score("ACME FIRE", "FIRE ACME ACME") == 100.0
    assert token_set_score("", "FIRE") == 0.0
    assert token_set_score(None, None) == 0.0
    assert token_set_score("ABCD", "WXYZ") == 0.0
    assert token_set_score("ABCDEFGHIJKL", "ABCDEFGHIJKLM") == 100.0 - 100.0 / 25
    for a, b in [("ACME FIRE", "ACNE FIRE"), ("A B C", "C D")]:
        assert token_set_score(a, b) == token_set_score(b, a)


def test_bands(spark):
    cases = [("a", 92.0, True, "merge"), ("b", 91.99, True, "review"), ("c", 85.0, True, "review"),
             ("d", 84.99, True, None), ("e", 100.0, False, "review"), ("f", 92.0, None, "review")]
    scored = spark.createDataFrame([(n, n, s, p, False if p is not None else None) for n, s, p, _ in cases],
                                   "left_key string, right_key string, score double, shared_phone boolean, shared_address boolean")
    merges, queue = resolve.resolve_pairs(scored)
    assert {r.left_key for r in merges.collect()} == {"a"}
    assert {r.left_key: r.reason for r in queue.collect()} == {
        "b": "similar, below merge score", "c": "similar, below merge score",
        "e": "similar, no shared contact", "f": "similar, no shared contact"}


def test_company_values_are_whole(spark):
    members = spark.createDataFrame(
        [(f"m{i:03}", f"Name {i}", None, None, None, "T", str(i)) for i in range(30)] + [("x", "Lone", "4075550100", None, None, None, None)],
        "member_id string, raw_name string, phone string, address string, email string, license_type string, license_number string")
    clustered = resolve.normalize_members(members).withColumn(
        "company_id", F.when(F.col("member_id") == "x", "x").otherwise("m000"))
    full = {r.company_id: r for r in resolve.build_company(clustered).collect()}
    assert full["m000"].n_aliases == 30 and full["m000"].canonical_name == "Name 0"
    assert (full["x"].n_aliases, full["x"].n_licenses) == (1, 0)
    assert resolve.company_values(clustered).filter("company_id = 'm000' and kind = 'alias'").count() == 30
