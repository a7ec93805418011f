"""Pairs of names at or above a similarity floor that share a contact.

A block is all distinct names that share a phone or an address.  Names of a small block meet
directly; names of a large one meet only through signatures, and every pair at or above the floor
shares at least one.  Whichever way a pair comes about, it is decided by the same exact check, so the
result does not depend on the size of a block, and nothing is capped.

Why the signatures lose nothing, for names x, y of length |x|, |y| (their
distinct words joined by single blanks) and a floor of 85, so that at most
0.15 * (|x| + |y|) letters are inserted or deleted:

* Letters.  With a blank at both ends the multiset of two-letter pieces does not
  depend on word order.  A deletion removes at most two pieces of the longer name and an
  insertion one, so both names keep at least c = 1 + 0.275 * (|x| + |y|) pieces in common, which
  is 1 + 0.478 * |x| or more whatever the other's length.
  Order pieces from rare to frequent; then the first (pieces - common + 2) of
  either name share at least two, and any two of them make a signature.  The second of the first two
  shared pieces leaves c - 2 behind it in both names, which is asked for at the join with both lengths known.
  (Names too short to have two common pieces allow no edit at all.)  The
  lengths may differ by no more than the edits, which drops pairs at the join.
* Shared words.  Shared words of length i against x with a leftover of length a
  reach the floor only if i >= (0.85 / 0.30) * (1 + a).  Take words of x from
  rare to frequent until what is left, even with the longest taken word, is too
  short for that; then two of the taken words must be shared, and x looks for
  each two of them among all word pairs of the others.  Where one word alone is
  long enough, x looks for single words instead, taken until the rest is too
  short.

The check splits both names into words and decides by lengths alone where the shared words reach the floor.
Else the score is that of the letters, and the Levenshtein distance, which is never more than the
insertions and deletions, rules out nearly all other pairs.  Only what is left goes to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.similarity import token_set_ratio
from lintel.plans.skew import salted_lookup
from lintel.session import ensure_checkpoint_dir

FLOOR = 85.0
#: Blocks of up to so many names are paired directly; larger ones by signatures.  Affects speed only.
SMALL_BLOCK = 128

_LOSS = (100.0 - FLOOR) / 100.0
_PIECE_SHARE = 0.478
_PAIR_SHARE = 0.275
_WORD_FACTOR = (1.0 - _LOSS) / (2.0 * _LOSS)


def _words(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != "")))


def _with_pieces(names: DataFrame) -> DataFrame:
    """Two-letter pieces of the padded words, numbered when they repeat."""
    padded = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.length("_padded") - 1),
                      lambda i: F.substring(F.col("_padded"), i, F.lit(2)))
    numbered = F.transform("_cut", lambda p, i: F.concat(
        p, F.size(F.filter(F.slice("_cut", F.lit(1), i + 1), lambda q: q == p)).cast("string")))
    return (names.withColumn("_padded", padded).withColumn("_cut", cut)
            .withColumn("pieces", numbered).drop("_padded", "_cut"))


def _ranked(names: DataFrame, parts: str) -> DataFrame:
    """``parts`` of each name from rare to frequent; a name is short, so its list is too."""
    single = names.select("name", F.explode(parts).alias("part"))
    counts = single.groupBy("part").agg(F.count(F.lit(1)).alias("_rows"))
    weighed = salted_lookup(single, counts, ["part"], "inner")
    order = F.array_sort(F.collect_list(F.struct("_rows", "part")))
    return weighed.groupBy("name").agg(F.transform(order, lambda s: s["part"]).alias(parts))


def _piece_signatures(names: DataFrame) -> DataFrame:
    """``(name, letters, second, sign)``: each two of a name's rarest pieces, and the place of the second."""
    ranked = _ranked(_with_pieces(names), "pieces")
    total = F.size("pieces")
    common = F.ceil(F.lit(1.0) + F.lit(_PIECE_SHARE) * (total - 1)).cast("int")
    picked = ranked.select("name", (total - 1).alias("letters"), F.slice("pieces", F.lit(1), F.least(total, total - common + 2)).alias("first"))
    twos = F.flatten(F.transform("first", lambda p, i: F.transform(
        F.slice("first", i + 2, F.size("first")), lambda q, j: F.struct((i + j + 2).alias("second"), F.xxhash64(p, q).alias("sign")))))
    return picked.select("name", "letters", F.explode(twos).alias("t")).select("name", "letters", "t.second", "t.sign")


def _two_of(words: str) -> Column:
    """Every two of the words as one value, whatever their order."""
    return F.flatten(F.transform(words, lambda p, i: F.transform(
        F.slice(words, i + 2, F.size(words)), lambda q: F.xxhash64(F.least(p, q), F.greatest(p, q)))))


def _probe_words(names: DataFrame) -> DataFrame:
    ranked = _ranked(names, "words").withColumn("whole", F.length(F.array_join("words", " ")))

    def taken(i):
        return F.slice("words", F.lit(1), i + 1)

    def length(i):
        return F.length(F.array_join(taken(i), " "))

    def longest(i):
        return F.array_max(F.transform(taken(i), lambda w: F.length(w)))

    def two_needed(_, i):
        short = F.col("whole") - length(i) + longest(i)
        return (i >= 1) & (short.cast("double") < F.lit(_WORD_FACTOR) * (length(i) - longest(i)))

    def one_needed(_, i):
        return (F.col("whole") - length(i) - 1).cast("double") < F.lit(_WORD_FACTOR) * (length(i) + 1)

    sized = ranked.select(
        "name", "words",
        F.array_position(F.transform("words", two_needed), True).cast("int").alias("two"),
        F.array_position(F.transform("words", one_needed), True).cast("int").alias("one"))
    probes = sized.select("name", "two", F.slice("words", F.lit(1), F.when(F.col("two") > 0, F.col("two"))
                                                 .otherwise(F.col("one"))).alias("probe"))
    signs = F.when(F.col("two") > 0, _two_of("probe")).otherwise(F.transform("probe", lambda w: F.xxhash64(w)))
    return probes.select("name", F.explode(signs).alias("sign"))


def _index_words(names: DataFrame) -> DataFrame:
    return names.select("name", F.explode(F.concat(
        F.transform("words", lambda w: F.xxhash64(w)), _two_of("words"))).alias("sign"))


def _meet(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    return salted_lookup(second.withColumnRenamed("name", "b"),
                         first.withColumnRenamed("name", "a"), on, "inner")


def _by_pieces(rows: DataFrame, on: list[str]) -> DataFrame:
    """Names that share two rare pieces, have similar lengths, and enough pieces behind the second."""
    other = rows.select(*on, "sign", "name", F.col("letters").alias("letters_b"), F.col("second").alias("second_b"))
    length = F.col("letters") + F.col("letters_b")
    behind = F.lit(_PAIR_SHARE - 1e-9) * length - 1
    return (_meet(rows, other, [*on, "sign"])
            .filter((F.col("a") < F.col("b")) & (F.abs(F.col("letters") - F.col("letters_b")) <= F.lit(_LOSS) * length)
                    & (F.col("letters") + 1 - F.col("second") >= behind) & (F.col("letters_b") + 1 - F.col("second_b") >= behind)))


def similar_pairs(contacts: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Every pair of names that shares a contact and scores at least the floor: ``left_key, right_key,
    shared_phone, shared_address, score``.

    ``contacts`` has one row per distinct (name, kind, contact).
    """
    return checked(met_pairs(contacts, small_block))


def met_pairs(contacts: DataFrame, small_block: int = SMALL_BLOCK) -> DataFrame:
    """Pairs to check, among them all that reach the floor, with the kinds of contact they share."""
    ensure_checkpoint_dir(contacts.sparkSession)
    block = ["kind", "contact"]
    contacts = contacts.checkpoint()
    counts = contacts.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    largest = counts.agg(F.max("_rows")).first()[0] or 0
    sized = salted_lookup(contacts, counts, block, "inner") if largest > small_block else contacts.withColumn("_rows", F.lit(0))
    small = sized.filter(F.col("_rows") <= small_block).drop("_rows")
    met = [small.withColumnRenamed("name", "a").join(small.withColumnRenamed("name", "b"), block).filter("a < b")]
    if largest > small_block:
        large = sized.filter(F.col("_rows") > small_block).drop("_rows").checkpoint()
        names = large.select("name").distinct().withColumn("words", _words(F.col("name"))).checkpoint()
        met.append(_by_pieces(large.join(_piece_signatures(names), "name"), block))
        met.append(_meet(large.join(_probe_words(names), "name"), large.join(_index_words(names), "name"), [*block, "sign"]))
    return _merged(met)


def _merged(met: list[DataFrame]) -> DataFrame:
    """Each pair once, with the kinds of contact it shares."""
    pairs = [m.filter("a <> b").select("kind", F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key")) for m in met]
    whole = pairs[0]
    for more in pairs[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("left_key", "right_key").agg(
        F.bool_or(F.col("kind") == "phone").alias("shared_phone"),
        F.bool_or(F.col("kind") == "address").alias("shared_address"))


def undecided(pairs: DataFrame) -> DataFrame:
    """Pairs that can reach the floor, with ``by_words``: their score by shared words, null below the floor."""
    left, right = _words(F.col("left_key")), _words(F.col("right_key"))
    parts = (pairs.withColumn("_l", left).withColumn("_r", right)
             .withColumn("_shared", F.length(F.array_join(F.array_intersect("_l", "_r"), " ")).cast("double"))
             .withColumn("_only_l", F.array_join(F.array_except("_l", "_r"), " "))
             .withColumn("_only_r", F.array_join(F.array_except("_r", "_l"), " ")))
    la, lb = F.length("_only_l"), F.length("_only_r")
    joint = F.when(F.col("_shared") > 0, F.col("_shared") + 1).otherwise(F.lit(0.0))

    def against(rest: Column) -> Column:
        return F.lit(100.0) - F.lit(100.0) * (rest + 1) / (F.col("_shared") + joint + rest)

    by_words = (F.when(F.col("_shared") == 0, F.lit(0.0)).when((la == 0) | (lb == 0), F.lit(100.0))
                .otherwise(F.greatest(against(la), against(lb))))
    edits = F.floor(F.lit(_LOSS + 1e-9) * (2 * joint + la + lb)).cast("int")
    scored = parts.withColumn("by_words", by_words).withColumn("_edits", edits)
    near = (F.abs(la - lb) <= F.col("_edits")) & (F.levenshtein("_only_l", "_only_r") <= F.col("_edits"))
    return (scored.withColumn("by_words", F.when(F.col("by_words") >= FLOOR, F.col("by_words")))
            .filter(F.col("by_words").isNotNull() | near)
            .withColumn("by_letters", (F.coalesce(F.col("by_words"), F.lit(0.0)) < 100) & near)
            .select(*pairs.columns, "by_words", "by_letters"))


def checked(pairs: DataFrame) -> DataFrame:
    """The pairs at or above the floor with their score; Python sees those that the letters may decide."""
    open_pairs = undecided(pairs).checkpoint()
    by_letters = open_pairs.filter("by_letters").withColumn("score", token_set_ratio("left_key", "right_key"))
    by_words = open_pairs.filter("not by_letters").withColumn("score", F.col("by_words"))
    return by_letters.unionByName(by_words).filter(F.col("score") >= FLOOR).select(*pairs.columns, "score")
