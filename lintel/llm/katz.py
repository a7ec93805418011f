"""Language-model scores: a Katz bigram model with Good-Turing discounts.

Counts are gathered over all training documents.  Words and bigrams are known by hashes and counted
in buckets; each home (a bucket of texts) sends every distinct word and bigram once, with its count, and
gets the total counts back.  A token is scored by its bigram if that was seen, else by the history's
backoff weight times the token's own probability, else by the mass left for unknown words.  Weights
are normalised exactly: over all known words and the unknown one each history's probabilities add up to 1.

Two sums need all counts before any score: the numbers of words and of bigrams that occur 1 to 6
times.  They are six numbers each and pass through the driver; all else stays in tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.anchors import mixed, word_hashes
from lintel.llm.bpe import _chunks
from lintel.llm.common import buckets_for, table, text_bytes, tidy
from lintel.llm.packed import batch_of, home_column, keyed, planes, unplanes
from lintel.llm.toxicity import held_out
from lintel.session import stored

BUCKET = 16 << 20
#: Counts up to this are discounted by Good-Turing; larger ones lose ``CUT`` so that every history has mass left.
K = 5
CUT = 0.1
#: Histories more frequent than both are split over several buckets: at most this many are.
SPLIT_COUNT, SPLIT_WORDS = 200_000, 10_000
#: Words a task sums up before it passes them on.
HELD_WORDS = 500_000
#: Stand for the start and the end of a text.
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Followers of a history are told apart by so many bits.
BITS = np.uint64((1 << 48) - 1)

WORDS = "bucket int, home int, h binary, c binary, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, types long, tokens long"
ROWS = "bucket int, home int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
#: Kinds of ROWS: counts of words, bigrams to be counted, bigrams counted, sums over a bucket.
WORD, ASK, COUNTED, SUMS = 0, 1, 2, 3


def discounts(n: list[int]) -> np.ndarray:
    """What is kept of counts 1 to K, from the numbers of types that occur 1 to K + 1 times.

    Good-Turing scaled so that counts above K are left alone; where the numbers do not allow it
    (too few types), each count loses a half.
    """
    r = np.arange(1, K + 1)
    half = (r - 0.5) / r
    if min(n[:K + 1]) <= 0:
        return half
    rest = (K + 1) * n[K] / n[0]
    kept = ((r + 1) * np.array(n[1:K + 1]) / np.array(n[:K]) / r - rest) / (1 - rest) if rest < 1 else np.zeros(K)
    return np.where((kept > 0) & (kept < 1), kept, half)


def discounted(c: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Counts after discounting; 0 stays 0."""
    small = np.concatenate([[0.0], kept * np.arange(1, K + 1)])
    return np.where(c <= K, small[np.minimum(c, K)], c - CUT)


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and their histories, and the text of each: words with A-Z lowered, then one end."""
    each = [word_hashes(t.encode().lower()) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(w) + 1 for w in each])
    tokens = np.concatenate([x for w in each for x in (w, np.array([END]))]) if each else np.zeros(0, np.uint64)
    history = np.concatenate([x for w in each for x in (np.array([START]), w)]) if each else tokens
    return tokens, history, doc


def tight(a: np.ndarray) -> bytes:
    """Planes of small numbers, compressed beyond what the shuffle does."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(planes(a))


def loose(b: bytes, dtype) -> np.ndarray:
    import zstandard

    return unplanes(zstandard.ZstdDecompressor().decompress(b), dtype)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def by_bucket(bucket: np.ndarray):
    """Bucket numbers and slices of an array sorted by bucket."""
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cut, [*cut[1:], len(bucket)])]


def word_table(own: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the training words' hashes, sorted, and counts; and what sums need."""
    def summed(h, c):
        words, of = np.unique(np.concatenate(h), return_inverse=True)
        return words, np.bincount(of, np.concatenate(c)).astype(np.int64)

    def packed(h, c):
        order = np.argsort(spread := bucket_of(h, buckets), kind="stable")
        return batch_of([(b, 0, planes(h[order][s]), tight(c[order][s]), *[0] * 8)
                         for b, s in by_bucket(spread[order])], WORDS)

    @tidy
    def read(batches):
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in _chunks(batches, "text", 3 << 20):
            tokens, _, doc = tokens_of(batch.column("text").to_pylist())
            train = np.array(batch.column("__train").to_pylist(), bool)
            tokens = tokens[train[doc]]
            h, c = summed([h, tokens], [c, np.ones(len(tokens), np.int64)])
            if len(h) > HELD_WORDS:
                yield packed(h, c)
                h, c = h[:0], c[:0]
        yield packed(h, c)

    @tidy
    def add(key, rows):
        words, total = summed([unplanes(x, np.uint64) for x in rows["h"].to_pylist()],
                              [loose(x, np.int64) for x in rows["c"].to_pylist()])
        return pa.Table.from_batches([batch_of([(key[0].as_py(), 0, planes(words), tight(total), *(
            int((total == r).sum()) for r in range(1, K + 2)), len(words), int(total.sum()))], WORDS)])

    return own.select("text", "__train").mapInArrow(read, WORDS).groupBy("bucket").applyInArrow(add, WORDS)


class Home:
    """The tokens of one home's texts, its distinct words in order of bucket and hash."""

    def __init__(self, own: pa.Table, buckets: int):
        # The order in which rows arrive is not fixed; words and bigrams are sorted, so it does not matter.
        self.texts = own["text"].to_pylist()
        tokens, history, self.doc = tokens_of(self.texts)
        self.train = np.array(own["__train"].to_pylist(), bool)
        words, of = np.unique(tokens, return_inverse=True)
        bucket = bucket_of(words, buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.words, self.bucket, self.token = words[order], bucket[order], place[of]
        del of, place, tokens
        # A history is the token before; at the start of a text, number len(words).
        self.history = np.empty(len(self.token), np.int32)
        self.history[1:] = self.token[:-1]
        self.history[history == START] = len(words)
        self.n = len(words)

    def set_counts(self, rows: dict[int, bytes]) -> None:
        """``count``: training counts of the words, the start's behind them (one start per end)."""
        got = [loose(rows[b], np.int64) for b, _ in by_bucket(self.bucket)]
        count = np.concatenate(got) if got else np.zeros(0, np.int64)
        ends = count[self.words == END]
        self.count = np.append(count, ends if len(ends) else 0)

    def bigrams(self, limit: int, buckets: int) -> None:
        """Distinct bigrams of known histories, in order of bucket, history and follower.

        All unknown followers are one, number len(words), that is never seen.
        """
        known = np.flatnonzero(self.count[self.history] > 0)
        follower = np.where(self.count[self.token[known]] > 0, self.token[known], self.n)
        pairs, of = np.unique(self.history[known].astype(np.int64) * (self.n + 1) + follower, return_inverse=True)
        del follower
        first, second = pairs // (self.n + 1), pairs % (self.n + 1)
        names = np.append(self.words, START)
        self.far = np.append(self.words, np.uint64(0))
        parts = (1 + self.count[first] // limit).astype(np.uint64)
        part = self.far[second] % parts
        bucket = bucket_of(mixed(names[first] + part * np.uint64(0xD6E8FEB86659FD93)), buckets)
        order = np.lexsort((second, first, bucket))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.first, self.second, self.pair_bucket = first[order].astype(np.int32), second[order].astype(np.int32), bucket[order]
        self.pair = np.full(len(self.token), -1, np.int32)
        self.pair[known] = place[of]
        del pairs, of, place, first, second, part, parts, bucket, order
        self.times = np.bincount(self.pair[known][self.train[self.doc[known]]], minlength=len(self.first)).astype(np.uint32)
        self.names = names


def scored_homes(own: DataFrame, words: DataFrame, p1: np.ndarray, unknown: float, n: int, types: int, limit: int,
                 homes: int) -> DataFrame:
    """Per home the sums of its documents that do not depend on the bigrams' discounts, and what does."""
    texts = own.withColumn("home", home_column(homes)).select("home", "doc_id", "__train", "text")

    @tidy
    def ask(key, rows):
        home = Home(rows, homes)
        return pa.Table.from_batches([batch_of([(b, key[0].as_py(), WORD, planes(home.words[s]), *[b""] * 5)
                                                for b, s in by_bucket(home.bucket)], ROWS)])

    @tidy
    def look_up(key, asked, known):
        if not asked.num_rows:
            return pa.Table.from_batches([batch_of([], ROWS)])
        h = unplanes(known["h"][0].as_py(), np.uint64) if known.num_rows else np.zeros(0, np.uint64)
        c = loose(known["c"][0].as_py(), np.int64) if known.num_rows else np.zeros(0, np.int64)
        out = []
        for home, a in zip(asked["home"].to_pylist(), asked["a"].to_pylist()):
            want = unplanes(a, np.uint64)
            at = np.minimum(np.searchsorted(h, want), len(h) - 1)
            out.append((key[0].as_py(), home, WORD, tight(np.where(h[at] == want, c[at], 0) if len(h) else np.zeros(len(want), np.int64)),
                        *[b""] * 5))
        return pa.Table.from_batches([batch_of(out, ROWS)])

    @tidy
    def send(key, rows, counts):
        """Distinct bigrams to their buckets: histories, numbers of followers, followers, their counts."""
        if not rows.num_rows:
            return pa.Table.from_batches([batch_of([], ROWS)])
        home, own_home = Home(rows, homes), key[0].as_py()
        got = dict(zip(counts["bucket"].to_pylist(), counts["a"].to_pylist()))
        home.set_counts(got)
        home.bigrams(limit, homes)
        out = [(own_home % homes, own_home, WORD, a, np.int32(b).tobytes(), *[b""] * 4) for b, a in got.items()]
        for b, s in by_bucket(home.pair_bucket):
            first, second = home.first[s], home.second[s]
            new = np.flatnonzero(np.diff(first, prepend=-1))
            far = home.far[second] & BITS
            out.append((b, own_home, ASK, planes(home.names[first[new]]), tight(np.diff(new, append=len(first)).astype(np.uint32)),
                        planes((far >> np.uint64(16)).astype(np.uint32)) + planes(far.astype(np.uint16)),
                        tight(np.append(home.count[:-1], 0)[second].astype(np.uint32)), tight(home.times[s]),
                        planes((home.count[first[new]] > limit).astype(np.uint8))))
        return pa.Table.from_batches([batch_of(out, ROWS)])

    @tidy
    def count(key, rows):
        """Total counts of the bigrams asked for; per history, how many followers it has by count, and their own mass."""
        out = [tuple(r.values()) for r in rows.filter(pa.array(rows["kind"].to_numpy() == WORD)).to_pylist()]
        asked = rows.filter(pa.array(rows["kind"].to_numpy() == ASK)).to_pylist()
        if not asked:
            return pa.Table.from_batches([batch_of(out, ROWS)])
        heads = [unplanes(r["a"], np.uint64) for r in asked]
        followers = [loose(r["b"], np.uint32).astype(np.int64) for r in asked]
        sizes = [int(f.sum()) for f in followers]
        far = np.concatenate([unplanes(r["c"][:4 * m], np.uint32).astype(np.uint64) << np.uint64(16)
                              | unplanes(r["c"][4 * m:], np.uint16) for r, m in zip(asked, sizes)])
        own = np.concatenate([loose(r["d"], np.uint32) for r in asked])
        times = np.concatenate([loose(r["e"], np.uint32) for r in asked])
        names, head = np.unique(np.concatenate(heads), return_inverse=True)
        hist = np.repeat(head.astype(np.int32), np.concatenate(followers))
        order = np.lexsort((far, hist))
        new = np.ones(len(order), bool)
        new[1:] = (hist[order][1:] != hist[order][:-1]) | (far[order][1:] != far[order][:-1])
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(new) - 1
        total = np.bincount(of, times, minlength=int(new.sum())).astype(np.int64)
        some = order[new]
        del order, new, far, times
        seen = total > 0
        kept_by = np.zeros((len(names), K + 2))
        np.add.at(kept_by, (hist[some][seen], np.minimum(total[seen], K + 1) - 1), 1)
        kept_by[:, K + 1] = np.bincount(hist[some][seen], discounted(own[some][seen], p1) / max(n, 1), minlength=len(names))
        split = np.concatenate([unplanes(r["f"], np.uint8) for r in asked]).astype(bool)
        at = at_head = 0
        for r, h, m in zip(asked, heads, sizes):
            mine = head[at_head:at_head + len(h)]
            out.append((key[0].as_py(), r["home"], COUNTED, tight(total[of[at:at + m]].astype(np.uint32)),
                        tight(kept_by[mine, :K + 1].astype(np.uint32).ravel()), planes(kept_by[mine, K + 1]), b"", b"", b""))
            at, at_head = at + m, at_head + len(h)
        parted = np.unique(head[split])
        counts = np.array([int((total == r).sum()) for r in range(1, K + 2)], np.int64)
        out.append((key[0].as_py(), homes + key[0].as_py(), SUMS, counts.tobytes(), planes(names[parted]),
                    planes(kept_by[parted].ravel()), b"", b"", b""))
        return pa.Table.from_batches([batch_of(out, ROWS)])

    kind = own.schema["doc_id"].dataType.simpleString()
    result = (f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, fixed double, by_count array<long>, "
              "backed binary, stats binary, mass binary, splits binary, sums binary, split_names binary, split_stats binary")

    @tidy
    def score(key, rows, got):
        names = [f.split()[0] for f in result.split(", ")]
        kinds = {"held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "fixed": pa.float64(),
                 "by_count": pa.list_(pa.int64())}
        cols: dict[str, list] = {c: [] for c in names[1:]}
        make = lambda ids: pa.table({"doc_id": ids} | {c: pa.array(v, kinds.get(c, pa.binary())) for c, v in cols.items()})
        if key[0].as_py() >= homes:
            for r in got.to_pylist():
                for c in cols:
                    cols[c].append({"sums": r["a"], "split_names": r["b"], "split_stats": r["c"]}.get(c))
            return make(pa.array([None] * got.num_rows, rows.schema.field("doc_id").type))
        if not rows.num_rows:
            return make(rows["doc_id"])
        home = Home(rows, homes)
        parts = got.to_pylist()
        home.set_counts({int(np.frombuffer(r["b"], np.int32)[0]): r["a"] for r in parts if r["kind"] == WORD})
        home.bigrams(limit, homes)
        counted = {r["bucket"]: r for r in parts if r["kind"] == COUNTED}
        total = np.zeros(len(home.first), np.int64)
        stats = np.zeros((home.n + 1, K + 1), np.int64)
        mass = np.zeros(home.n + 1)
        for b, s in by_bucket(home.pair_bucket):
            r, first = counted[b], home.first[s]
            total[s] = loose(r["a"], np.uint32)
            heads = first[np.flatnonzero(np.diff(first, prepend=-1))]
            stats[heads] = loose(r["b"], np.uint32).reshape(-1, K + 1)
            mass[heads] = unplanes(r["c"], np.float64)
        c1, c2, doc, docs = home.count[home.history], home.count[home.token], home.doc, len(home.texts)
        c12 = np.where(home.pair >= 0, total[home.pair], 0) if len(total) else np.zeros(len(c1), np.int64)
        seen = c12 > 0
        own_p = np.where(c2 > 0, discounted(c2, p1) / max(n, 1), unknown)
        whole = np.where(c12 > K, np.log10(np.maximum(c12 - CUT, CUT)), 0.0) - np.log10(np.maximum(c1, 1))
        by_count = np.zeros((docs, K), np.int64)
        small = seen & (c12 <= K)
        np.add.at(by_count, (doc[small], c12[small] - 1), 1)
        backed = ~seen & (c1 > 0)
        per_doc = lambda x: np.bincount(doc, x, minlength=docs)
        cols["held_out"] = (~home.train).tolist()
        cols["n_tokens"] = np.bincount(doc, minlength=docs).tolist()
        cols["n_known"] = np.bincount(doc[c2 > 0], minlength=docs).tolist()
        cols["base"] = per_doc(np.log10((c2 + 1) / (n + types + 1))).tolist()
        cols["fixed"] = per_doc(np.where(seen, whole, np.log10(own_p))).tolist()
        cols["by_count"] = by_count.tolist()
        ends = np.cumsum(np.bincount(doc[backed], minlength=docs))
        for used in np.split(home.history[backed], ends[:-1]):
            # per history of a document that was backed off: how often, its sums, its name if split
            hist, times = np.unique(used, return_counts=True)
            cols["backed"].append(planes(times.astype(np.uint32)))
            cols["stats"].append(planes(np.column_stack([stats[hist], home.count[hist]]).astype(np.uint32).ravel()))
            cols["mass"].append(planes(mass[hist]))
            cols["splits"].append(planes(np.where(home.count[hist] > limit, home.names[hist], np.uint64(0))))
        for c in ("sums", "split_names", "split_stats"):
            cols[c] = [None] * docs
        return make(rows["doc_id"])

    asked = texts.groupBy("home").applyInArrow(ask, ROWS)
    counts = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(look_up, ROWS)
    sent = texts.groupBy("home").cogroup(counts.groupBy("home")).applyInArrow(send, ROWS)
    totals = sent.groupBy("bucket").applyInArrow(count, ROWS)
    return texts.groupBy("home").cogroup(totals.groupBy("home")).applyInArrow(score, result)


def katz_scores(docs: DataFrame, bucket_bytes: int = BUCKET, split_count: int = SPLIT_COUNT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32 of the doc_id as text leaves 2 when divided by 7 are held out of the counts.  A
    null text counts as empty: one token, the end.  A null doc_id counts as an empty one; repeated
    rows count as often as they stand there.  Without training rows every word is unknown, with
    probability 1.
    """
    spark = docs.sparkSession
    homes = buckets_for(spark, text_bytes(docs), bucket_bytes)
    own = keyed(docs.select("doc_id", "text")).withColumn("__train", ~held_out(7, 2))
    words = stored(word_table(own, homes), "words")
    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n5", "n6", "types", "tokens"))).first()
    n, types, by_count = sums.tokens, sums.types, list(sums)[:K + 1]
    p1 = discounts(by_count)
    r = np.arange(1, K + 1)
    unknown = float(((1 - p1) * r * by_count[:K]).sum() + CUT * (types - sum(by_count[:K]))) / n if n else 1.0
    limit = max(split_count, n // SPLIT_WORDS)
    rows = stored(scored_homes(own, words, p1, unknown, n, types, limit, homes), "scored")
    found = np.zeros(K + 1, np.int64)
    split: dict[int, np.ndarray] = {}
    # One row per bucket with six numbers, and the sums of at most SPLIT_WORDS histories by part.
    for row in rows.filter("sums is not null").select("sums", "split_names", "split_stats").toLocalIterator():
        found += np.frombuffer(row.sums, np.int64)
        stats = unplanes(row.split_stats, np.float64).reshape(-1, K + 2)
        for name, part in zip(unplanes(row.split_names, np.uint64).tolist(), stats):
            split[name] = split.get(name, 0) + part
    p2 = discounts(found.tolist())
    sent = spark.sparkContext.broadcast(split)
    seen = np.log10(p2 * r)

    @tidy
    def finish(batches):
        for batch in batches:
            score = []
            for fixed, counts, times, stats, mass, names in zip(*(batch.column(c).to_pylist() for c in (
                    "fixed", "by_count", "backed", "stats", "mass", "splits"))):
                times, mass = unplanes(times, np.uint32), unplanes(mass, np.float64).copy()
                table_ = unplanes(stats, np.uint32).reshape(-1, K + 2).astype(float)
                for i, name in enumerate(unplanes(names, np.uint64).tolist()):
                    if name:
                        table_[i, :K + 1], mass[i] = sent.value[name][:K + 1], sent.value[name][K + 1]
                left = (table_[:, :K] @ ((1 - p2) * r) + CUT * table_[:, K]) / np.maximum(table_[:, K + 1], 1)
                weight = left / np.maximum(1 - mass, 1e-12)
                score.append(fixed + float(seen @ np.array(counts)) + float(np.log10(weight) @ times))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")),
                 pa.array(np.full(batch.num_rows, n, np.int64)), batch.column("base"), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.filter("sums is null").mapInArrow(
        finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_katz(spark, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
