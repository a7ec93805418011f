"""Importance resampling towards a target: documents drawn by how much their words resemble the target's.

Features are runs of words, hashed into buckets by CRC-32.  A chunk of texts gives one Aho-Corasick
dictionary of its distinct words, each between blanks and with its CRC and length as payload; one
scan of the chunk emits a payload per word.  The CRC of a run follows from those of its words and their lengths alone,
so longer runs are composed from neighbouring payloads without touching the text again.

Texts are read once.  What is stored is one small row of bucket counts per document; counts over all documents and the scores
come from these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.bpe import _chunks
from lintel.llm.common import table, tidy
from lintel.llm.words import word_lists
from lintel.plans.order import numbered
from lintel.session import stored

#: Longest run of words, number of buckets, per cent drawn, words that a drawn document has at least, and the seed.
RUN, BUCKETS, PER_CENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Bytes of text per dictionary.
CHUNK = 2 << 20


@lru_cache(maxsize=1)
def _steps() -> list[np.ndarray]:
    """For 1, 2, 4, ... zero bytes: what feeding them does to each byte of a CRC, as four tables of 256."""
    feed = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        feed = (feed >> np.uint32(1)) ^ np.where(feed & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    plain = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    steps = [feed[plain & np.uint32(255)] ^ (plain >> np.uint32(8))]
    for _ in range(31):
        steps.append(_feed(steps[-1], steps[-1]))
    return steps


def _feed(crc: np.ndarray, step: np.ndarray) -> np.ndarray:
    byte = lambda k: (crc >> np.uint32(8 * k)) & np.uint32(255)
    return step[0][byte(0)] ^ step[1][byte(1)] ^ step[2][byte(2)] ^ step[3][byte(3)]


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of left and right in a row, from both CRCs and the bytes on the right."""
    out, k = left.copy(), 0
    while (length >> k).any():
        at = (length >> k) & 1 == 1
        out[at] = _feed(out[at], _steps()[k])
        k += 1
    return out ^ right


def payloads(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of every word, by one scan with the automaton of the distinct ones."""
    import zlib

    import ahocorasick

    automaton = ahocorasick.Automaton()  # its own integers have 32 bits only
    for w in set(words):
        automaton.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    automaton.make_automaton()
    line = b" ".join([b"", *words, b""]).decode("latin-1")
    found = np.fromiter((payload for _, payload in automaton.iter(line)), np.int64, len(words))
    return (found & 0xFFFFFFFF).astype(np.uint32), found >> 32


def run_crcs(crc: np.ndarray, length: np.ndarray, run: int) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1, 2, ... ``run`` words joined by a blank, by their first words."""
    import zlib

    blank, whole = np.full(len(crc), zlib.crc32(b" "), np.uint32), crc
    yield whole
    for n in range(2, run + 1):
        if len(crc) < n:
            return
        gap = composed(whole[:-1], blank[:len(whole) - 1], np.ones(len(whole) - 1, np.int64))
        whole = composed(gap, crc[n - 1:], length[n - 1:])
        yield whole


def text_words(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts' words by the megabyte: the text of each word, and the words."""
    of, words, size = [], [], 0
    for i, raw in enumerate(texts):
        for part in word_lists(raw):
            of += [i] * len(part)
            words += part
            size += sum(map(len, part))
            if size >= CHUNK:
                yield of, words
                of, words, size = [], [], 0
    if words:
        yield of, words


def bucket_counts(texts: list[bytes], run: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: words, the buckets of its features, and how many fall in each."""
    n_words, found = np.zeros(len(texts), np.int64), []
    ends: list[tuple] = []
    for of, words in text_words(texts):
        of, (crc, length) = np.array(of, np.int64), payloads(words)
        n_words += np.bincount(of, minlength=len(texts))
        if ends:  # the last words of the piece before, for runs that cross
            of, crc, length = (np.concatenate(x) for x in zip(ends[0], (of, crc, length)))
        tail = len(ends[0][0]) if ends else 0
        for n, crcs in enumerate(run_crcs(crc, length, run), 1):
            begin = max(0, tail - n + 1)  # shorter runs within the tail have been counted
            inside = (of[:len(crcs)] == of[n - 1:])[begin:]
            found.append(np.unique(of[begin:len(crcs)][inside] * buckets + crcs[begin:][inside].astype(np.int64) % buckets, return_counts=True))
        keep = min(run - 1, len(of))
        ends = [(of[len(of) - keep:], crc[len(of) - keep:], length[len(of) - keep:])]
    if not found:
        return n_words, [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    key, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    count = np.bincount(of, np.concatenate([c for _, c in found])).astype(np.int64)
    cut = np.searchsorted(key, np.arange(1, len(texts)) * buckets)
    return n_words, np.split(key % buckets, cut), np.split(count, cut)


def features(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_words``, and the features as ``buckets`` with ``counts``, stored."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "text"):
            n, own, count = bucket_counts([(t or "").encode() for t in batch.column("text").to_pylist()], run, buckets)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int64()))],
                names=[*keep, "n_words", "buckets", "counts"])

    return stored(docs.select(*keep, "text").mapInArrow(read, f"{fields + ', ' if fields else ''}n_words long, buckets array<int>, counts array<long>"), "features")


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` over all rows of ``features``; each task sends its sums."""
    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket the log ratio of target to source, in thousandths; every bucket counts once more than it holds."""
    both = (source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
            .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))).collect()  # one row per bucket
    s_all, t_all = sum(r["s"] for r in both), sum(r["t"] for r in both)
    held = {r["bucket"]: (r["s"], r["t"]) for r in both}
    counts = np.array([held.get(b, (0, 0)) for b in range(buckets)], np.float64).reshape(buckets, 2)
    ratio = (counts[:, 1] + 1) * (s_all + buckets) / ((counts[:, 0] + 1) * (t_all + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, run: int = RUN, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_features, weight, score, rank``.

    ``weight`` is the mean gain of the document's features, rounded down; ``score`` adds Gumbel noise that depends on seed and
    doc_id alone, so the highest scores are a draw without replacement with chances in proportion to
    the weights.  ``per_cent`` of the documents with ``least_words`` or more are drawn, ``rank`` counts them from 1,
    the others have none.

    ``docs`` needs ``doc_id, text`` and ``target`` needs ``text``; other columns of whatever name are not looked at.
    A null or wordless text has no features and weight 0.  A null doc_id draws like an empty one and comes
    behind equal scores.  Repeated rows are rows of their own with equal scores; rows with one doc_id, equal scores and
    different texts rank by weight, then by features, more first.  A very long text is read a megabyte at a time.
    Empty tables give no rows, an empty target favours rare buckets.
    """
    spark = docs.sparkSession
    rows = features(docs, run, buckets)
    gain = spark.sparkContext.broadcast(np.array(gains(bucket_totals(rows, buckets), bucket_totals(features(target, run, buckets, ()), buckets), buckets)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.repeat(np.arange(batch.num_rows), batch.column("buckets").value_lengths().to_numpy())
            count = batch.column("counts").flatten().to_numpy()
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n, own, count)
            np.add.at(total, own, count * gain.value[batch.column("buckets").flatten().to_numpy()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["doc_id", "n_words", "n_features", "weight"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = (rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
              .withColumn("score", F.col("weight") + noise))
    scored = stored(scored, "scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * per_cent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    placed = numbered(scored.filter(enough), order, "rank", "long")
    return (placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
            .unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))))


def op12_importance(spark, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte with a table made on the spot, once per distinct word.
ORACLE = r"""
with recursive c as (select i, i as x, 0 as k from range(256) r(i)
  union all select i, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k + 1 from c where k < 8),
tab as (select list(x order by i) as tab from c where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
o as (select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from d) group by doc_id, w),
v as (select w, hex(encode(w)) as h from (select w from o union select w from b)),
k as (select w, cast(xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, cast(len(h) // 2 + 1 as bigint)),
        lambda i: cast('0x' || substr(h, cast(2 * i - 1 as bigint), 2) as bigint))),
        lambda x, y: xor(x >> 8, tab[cast(xor(x & 255, y) + 1 as bigint)])), 4294967295::bigint) % 10000 as bigint) as bucket from v, tab),
s as (select bucket, sum(n) as s from o join k using (w) group by bucket),
t as (select bucket, count(*) as t from b join k using (w) group by bucket),
a as (select (select coalesce(sum(s), 0) from s) as s_all, (select coalesce(sum(t), 0) from t) as t_all),
g as (select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double))) as bigint) as gain
      from s full join t using (bucket), a),
f as (select doc_id, cast(sum(n) as bigint) as n_features, cast(floor(sum(n * gain)::double / sum(n)::double) as bigint) as weight
      from o join k using (w) join g using (bucket) group by doc_id),
r as (select d.doc_id, len(words) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
             coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double)
               / 4294967296::double))) as bigint) as score
      from d left join f using (doc_id)),
z as (select doc_id, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from r where n_words >= 20)
select r.doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when z.rank <= n * 10 // 100 then cast(z.rank as bigint) end as rank
from r left join z using (doc_id)
"""
