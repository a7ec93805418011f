"""Toxicity scores: Levenshtein automata run through a lexicon trie, weighed by their context.

The lexicon (words, and stems that stand for any ending) is learned from labelled documents by how
much more often an entry stands in toxic ones.  A word of a text is run through the trie as a
Levenshtein automaton, so misspelled entries are found without listing their variants.  Words around
a hit tell quotation from abuse.  A small logistic model turns the hits into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.bpe import _chunks
from lintel.llm.common import table, tidy
from lintel.session import stored

#: The model is fitted on about so many labelled documents at most, drawn by a hash of their text.
FIT_ROWS = 12_000
#: Entries that chance alone may be expected to give among all that are tested.
BY_CHANCE = 1.0
MIN_LOG_ODDS = 1.5
#: Evidence for one entry counts so much at most.
MAX_LOG_ODDS = 5.0
#: An entry must follow so many different words: words of one much-copied document do not.
MIN_CONTEXTS, CONTEXT_SHARE, MANY_CONTEXTS = 5, 0.5, 40
STEMS = (4, 5, 6)
#: Shorter entries must be met letter by letter.
FUZZY_WORD, FUZZY_STEM = 5, 6
MISSPELLED = 0.95
THRESHOLD = 0.7
#: Words of context before a hit.
WINDOW = 6
QUOTED, ADDRESSED = 0.3, 1.25
#: Words that announce somebody else's words, and words that address the reader.
REPORTING = frozenset("said says wrote writes quote quoted quoting called term word slur dit disait écrit mot sagte "
                      "schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u yourself vous tu toi ton votre du dich dein ihr euch tú usted ustedes".split())
OPENING, CLOSING = "\"“«„‟‘", "\"”»“‟’"
FEATURES = ["weight", "density", "different", "quoted", "length"]
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


class Automaton:
    """All strings within ``most`` edits of ``word``; a state is one row of edit distances."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> list[int]:
        return list(range(len(self.word) + 1))

    def step(self, row: list[int], letter: str) -> list[int]:
        out = [row[0] + 1]
        for i, own in enumerate(self.word):
            out.append(min(out[i] + 1, row[i + 1] + 1, row[i] + (own != letter)))
        return out

    def alive(self, row: list[int]) -> bool:
        return min(row) <= self.most


class Lexicon:
    """A trie of words and stems with weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.root: dict = {}
        self.halves: dict[int, set[tuple[int, str]]] = {}  # by the word's length; at 0 those of stems
        for entries, end, least in ((words, "word", FUZZY_WORD), (stems, "stem", FUZZY_STEM)):
            for entry, weight in entries.items():
                if len(entry) < least:
                    continue
                node = self.root
                for letter in entry:
                    node = node.setdefault(letter, {})
                node[end] = weight
                # One edit leaves the front half or the back half as it is.
                half = len(entry) // 2
                for size in range(len(entry) - 1, len(entry) + 2) if end == "word" else (0,):
                    self.halves.setdefault(size, set()).add((0, entry[:half]))
                    for shift in (-1, 0, 1):
                        self.halves[size].add((half + shift, entry[half:]))
        self.probes = {size: sorted({(at, len(x)) for at, x in of}) for size, of in self.halves.items()}
        self.stem_sizes = sorted({len(s) for s in stems})

    def weight(self, word: str) -> float:
        """The weight of the best entry that the word is, begins with, or misspells; 0 if none."""
        best = self.words.get(word, 0.0)
        for size in self.stem_sizes:
            best = max(best, self.stems.get(word[:size], 0.0))
        return best or MISSPELLED * self._misspelled(word)

    def _misspelled(self, word: str) -> float:
        if not any((at, word[at:at + n]) in self.halves[size]
                   for size in (0, len(word)) for at, n in self.probes.get(size, ())):
            return 0.0
        automaton = Automaton(word, 1)
        best, todo = 0.0, [(self.root, automaton.start())]
        while todo:
            node, row = todo.pop()
            if "word" in node and row[-1] <= 1:
                best = max(best, node["word"])
            if "stem" in node and min(row) <= 1:
                best = max(best, node["stem"])
            for letter, below in node.items():
                if len(letter) == 1 and automaton.alive(new := automaton.step(row, letter)):
                    todo.append((below, new))
        return best


class Reader:
    """Features of texts under one lexicon; remembers words it has met."""

    def __init__(self, lexicon: Lexicon, remembered: int = 400_000):
        import regex

        self.lexicon, self.remembered = lexicon, remembered
        self.strip = regex.compile(EDGES).sub
        self.seen: dict[str, float] = {}

    def weights(self, tokens: list[str]) -> dict[str, float]:
        if len(self.seen) > self.remembered:
            self.seen = {}
        seen = self.seen
        found = {}
        for token in set(tokens):
            weight = seen.get(token)
            if weight is None:
                weight = seen[token] = self.lexicon.weight(token if token.isalpha() else self.strip("", token))
            if weight:
                found[token] = weight
        return found

    def features(self, text: str) -> tuple[float, ...]:
        """Weight of all hits in context, the same per 100 words, different hits, the quoted share, length."""
        tokens = text.lower().split()
        weights = self.weights(tokens)
        if not weights:
            return 0.0, 0.0, 0.0, 0.0, math.log1p(len(tokens))
        total = quoted = 0.0
        hits = 0
        for i, token in enumerate(tokens):
            weight = weights.get(token)
            if weight is None:
                continue
            before = tokens[max(0, i - WINDOW):i]
            names = {self.strip("", w) for w in before}
            opened = any(w[0] in OPENING for w in before) or token[0] in OPENING
            closed = any(w[-1] in CLOSING or w[-1:] in ".,!?" and w[-2:-1] in CLOSING for w in before)
            if (opened and not closed) or names & REPORTING:
                weight *= QUOTED
                quoted += 1
            elif names & ADDRESS:
                weight *= ADDRESSED
            hits += 1
            total += weight
        return math.log1p(total), math.log1p(100 * total / len(tokens)), math.log1p(len(weights)), quoted / hits, math.log1p(len(tokens))


def held_out(parts: int, rest: int):
    """Whether crc32 of the doc_id as text leaves this remainder; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == rest


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(text, toxic)`` of about ``rows`` labelled training documents at most, equal texts once."""
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__of"))
             .agg(F.max("toxic").cast("int").alias("toxic")))
    known = known.filter(~F.expr("crc32(cast(__of as string)) % 3 = 1"))
    n = known.count()
    share = F.pmod(F.xxhash64("__of"), F.lit(1 << 20)) < F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 20)))
    return (docs.select("doc_id", "text").filter("text is not null")
            .join(known.filter(share), F.col("doc_id") == F.col("__of"))
            .groupBy(F.xxhash64("text").alias("__text")).agg(F.max_by("text", "toxic").alias("text"),
                                                           F.max("toxic").alias("toxic"))
            .select("text", "toxic"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """All entries that stand in more toxic documents than chance explains, however rare they are.

    The chance of so many toxic ones among an entry's documents has a Chernoff bound, and is held against
    the number of entries tested.  Documents decide which entries count, occurrences per word how much: an entry that
    clean texts hold now and then by chance still weighs if toxic ones are full of it.  What comes to the
    driver are the entries that pass, of a sample with a bounded number of rows.
    """
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = totals.n, totals.bad
    if not bad or bad == n:
        return Lexicon({}, {})
    share = F.lit(bad / n)
    seen = F.col("t") / (F.col("t") + F.col("f"))
    surprise = (F.col("t") * F.log(seen / share)
                + F.when(F.col("f") > 0, F.col("f") * F.log((1 - seen) / (1 - share))).otherwise(0.0))
    counts = stored(rows.mapInArrow(_entry_counts, "entry string, t long, f long, tt long, ff long").groupBy("entry").agg(
        *(F.sum(c).alias(c) for c in ("t", "f", "tt", "ff"))), "entries")
    words = counts.filter("entry = ''").first()
    needed_surprise = math.log(max(counts.count(), 1) / BY_CHANCE)
    best = (counts.filter("entry <> '' and t > 0").filter(seen > share).filter(surprise >= needed_surprise)
            .withColumn("odds", F.log((F.col("tt") + 0.5) / (words.tt + 1)) - F.log((F.col("ff") + 0.5) / (words.ff + 1)))
            .filter(F.col("odds") >= MIN_LOG_ODDS).orderBy("entry").collect())
    entries = {r.entry for r in best}
    contexts = {r.entry: r.n for r in (
        rows.filter("toxic = 1").mapInArrow(_contexts(entries), "entry string, before string")
        .distinct().groupBy("entry").agg(F.count(F.lit(1)).alias("n")).collect())}  # a row for each of them
    needed = lambda t: max(MIN_CONTEXTS, min(CONTEXT_SHARE * t, MANY_CONTEXTS))
    return Lexicon(*concise({r.entry: (min(r.odds, MAX_LOG_ODDS), r.t) for r in best
                             if contexts.get(r.entry, 0) >= needed(r.t)}))


def _contexts(entries: set[str]):
    """``(entry, before)``: the words that stand before the entries' words, once per chunk."""
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        strip = regex.compile(EDGES).sub
        for batch in _chunks(batches, "text"):
            found = set()
            for text in batch.column("text").to_pylist():
                before = ""
                for token in text.lower().split():
                    word = token if token.isalpha() else strip("", token)
                    for entry in (word + "$", *(word[:n] for n in STEMS)):
                        if entry in entries:
                            found.add((entry, before))
                    before = word
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)],
                                             names=["entry", "before"])

    return read


@tidy
def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(entry, t, f, tt, ff)``: toxic and other documents with each word (marked ``$``) or stem, and
    how often it stands there, summed per chunk.  The empty entry counts all words.
    """
    import regex

    strip = regex.compile(EDGES).sub
    for batch in _chunks(batches, "text"):
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = Counter(w if w.isalpha() else strip("", w) for w in text.lower().split())
            entries = Counter({"": sum(words.values())})
            for word, times in words.items():
                if len(word) > 2:
                    entries[word + "$"] += times
                for n in STEMS:
                    if len(word) >= n:
                        entries[word[:n]] += times
            for entry, times in entries.items():
                count = counts.setdefault(entry, [0, 0, 0, 0])
                count[1 - toxic] += 1
                count[3 - toxic] += times
        tf = np.array(list(counts.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *map(pa.array, tf.T.copy())],
                                         names=["entry", "t", "f", "tt", "ff"])


def concise(found: dict[str, tuple[float, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems without those that others explain.

    A stem goes if one word or longer stem makes up most of it; else what begins with it goes.
    """
    stems: dict[str, float] = {}
    most: dict[str, int] = {}  # by stem, the documents of the most frequent entry that goes on from it
    for entry, (_, t) in found.items():
        for n in STEMS:
            if len(entry) > n:
                most[entry[:n]] = max(most.get(entry[:n], 0), t)
    explained = lambda e: any(e[:n] in stems for n in STEMS)
    for stem in sorted((e for e in found if not e.endswith("$")), key=len):
        if not explained(stem) and most.get(stem, 0) < 0.8 * found[stem][1]:
            stems[stem] = found[stem][0]
    words = {e[:-1]: odds for e, (odds, _) in found.items() if e.endswith("$") and not explained(e)}
    return words, stems


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, the constant last."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * features.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + keep @ w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), gradient)
    return w


def _featured(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            f = np.array([reader.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, f.T.copy())], names=["toxic", *FEATURES])

    return rows.select("text", "toxic").mapInArrow(read, "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))


class Model:
    """A lexicon and the weights of its features; a few hundred KB, sent with the tasks."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside the held-out third; labels enter nowhere else.

    Without a label of either kind the model is a constant: the smoothed share of toxic labels.
    """
    sample = stored(fit_rows(docs, labels, rows), "labelled")
    lexicon = learn_lexicon(sample)
    found = _featured(sample, lexicon).toPandas()  # at most about ``rows`` rows of five numbers
    y = found["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return Model(lexicon, np.array([0.0] * len(FEATURES) + [math.log(share / (1 - share))]))
    return Model(lexicon, fit_logistic(found[FEATURES].to_numpy(float), y))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus ``toxicity``, from 0 to 1; read from the text alone.

    A null or empty text has no hits and gets the model's constant.  Texts are read whole.  A column
    named ``toxicity`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "toxicity"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, weights = Reader(sent.value.lexicon), sent.value.weights
        for batch in _chunks(batches, "text"):
            f = np.array([reader.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*kept, "toxicity"])

    return docs.select(*kept).mapInArrow(score, f"{fields}, toxicity double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, columns as they were."""
    scored = toxicity(docs.withColumnRenamed("toxicity", "__toxicity") if "toxicity" in docs.columns else docs,
                      fit(docs, labels))
    kept = scored.filter(F.col("toxicity") < threshold).drop("toxicity")
    return kept.withColumnRenamed("__toxicity", "toxicity").select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
