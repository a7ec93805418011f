"""Byte-level BPE encoding and decoding by depth-first traversal of a trie of distinct words.

The encoding of a prefix is the encoding of a shorter prefix plus one last token.  So the state of a
trie node is the last token of its prefix, and a node's state follows from the states above it: it
is the one token that ends there and stays apart from the last token before it when merged.  Each
node is computed once for all words below it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lintel.llm.common import table, tidy

#: Words whose ids a task remembers at least, twice as many at most, and pairs of tokens.  Affects speed only.
REMEMBERED, PAIRS = 120_000, 400_000
#: Bytes of text a task encodes at a time.
CHUNK = 4 << 20
#: Fixed value: the split of byte-level BPE before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in set(plain)))
    return table


class TrieBpe:
    """One vocabulary; ``encode`` gives the ids of texts."""

    def __init__(self, spec: str):
        import regex

        spec = json.loads(spec)
        model, chars = spec["model"], byte_of_char()
        in_bytes = lambda s: bytes(chars[c] for c in s)
        ids = {in_bytes(t): i for t, i in model["vocab"].items() if all(c in chars for c in t)}
        # Tokens are numbered in the order they come about: first the bytes, then the merges.
        self.number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = map(in_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            new = len(self.halves)
            self.number[left + right] = new
            self.halves.append((self.number[left], self.number[right]))
            self.merged[self.halves[new]] = new
        texts = {n: t for t, n in self.number.items()}
        self.width = [len(texts[n]) if n in texts else 0 for n in range(len(self.halves))]
        self.id_bytes = [ids.get(texts.get(n), 0).to_bytes(4, "little") for n in range(len(self.halves))]
        # How long tokens can be that end in some three bytes, longest first.
        sizes: dict[bytes, set[int]] = {}
        for t in self.number:
            if len(t) > 2:
                sizes.setdefault(t[-3:], {2, 1}).add(len(t))
        self.sizes = {end: tuple(sorted(of, reverse=True)) for end, of in sizes.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT).findall
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drop the words met; the vocabulary stays for the worker's next task."""
        self.known, self.older = {}, {}
        self.apart.clear()

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes together gives just these two tokens.

        Merges are undone from the latest on, on whichever side has it; the border stands if at no
        point an earlier merge than the next undone one would have crossed it.
        """
        key, bound, done = left << 20 | right, len(self.halves), False
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < bound:
                break
            # the later of the two is undone next; on a tie the right one, as equal merges run from the left
            halves_left, halves_right = self.halves[left], self.halves[right]
            if halves_left is None and halves_right is None:
                done = True
                break
            if halves_left is not None and left > right:
                bound, left = left, halves_left[1]
            else:
                bound, right = right + 1, halves_right[0]
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[key] = done
        return done

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word (little-endian, 4 bytes each): one depth-first pass over the words' trie.

        Sorted words visit the trie depth first; ``last`` holds the states on the path from the root.
        """
        out: dict[str, bytes] = {}
        number, width, id_bytes, sizes, known = self.number, self.width, self.id_bytes, self.sizes, self.apart
        path, last = b"", [-1]
        for word, raw in sorted([(w, w.encode()) for w in words], key=itemgetter(1)):
            shared, most = 0, min(len(path), len(raw))
            while shared < most and path[shared] == raw[shared]:
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(raw) + 1):
                for size in sizes.get(raw[max(0, end - 3):end], (2, 1)):
                    if size < end:
                        token = number.get(raw[end - size:end])
                        if token is not None:
                            before = last[end - size]
                            apart = known.get(before << 20 | token)
                            if self._apart(before, token) if apart is None else apart:
                                last.append(token)
                                break
                    elif size == end and (token := number.get(raw[:end])) is not None:
                        last.append(token)
                        break
            path, ids, end = raw, [], len(raw)
            while end:
                ids.append(id_bytes[last[end]])
                end -= width[last[end]]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = []
        for text in texts:
            if self.special and any(s in text for s in self.special):
                pieces.append([x for i, part in enumerate(self.cut.split(text))
                               for x in ([(part,)] if i % 2 else self.split(part))])
            else:
                pieces.append(self.split(text))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*pieces) - known.keys()
        known.update((w, older[w]) for w in new & older.keys())
        new -= older.keys()
        known.update(self.encode_words([w for w in new if isinstance(w, str)]))
        known.update((w, self.special[w[0]].to_bytes(4, "little")) for w in new if isinstance(w, tuple))
        return [b"".join([known[w] for w in words]) for words in pieces]


@lru_cache(maxsize=1)
def _loaded(spec: str) -> TrieBpe:
    """One vocabulary stays in a worker between its tasks."""
    return TrieBpe(spec)


@lru_cache(maxsize=1)
def _texts(spec: str) -> dict[int, bytes]:
    """The bytes of each id."""
    spec, chars = json.loads(spec), byte_of_char()
    texts = {i: bytes(chars[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in chars for c in t)}
    return texts | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


def decode_ids(ids: bytes, text_of: dict[int, bytes]) -> str:
    return b"".join([text_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces whose column has about ``size`` bytes, one row at least."""
    for batch in batches:
        widths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(widths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def bpe_encode(docs: DataFrame, spec_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` plus ``ids``: token ids as little-endian unsigned 32-bit integers.

    The vocabulary file is read once on the driver and sent to the tasks (a few MB, fixed).  A null
    text counts as empty and gets no ids.  Special tokens' strings in a text become those tokens.  A
    column of the same name as ``ids`` is replaced.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(spec_path).read_text(encoding="utf-8"))
    kept = [c for c in docs.columns if c != ids]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for batch in _chunks(batches, text):
            found = bpe.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*kept, ids])
        bpe.forget()

    return docs.select(*kept).mapInArrow(encode, f"{fields}, `{ids}` binary")


def bpe_decode(encoded: DataFrame, spec_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` plus the decoded text; null ids count as none."""
    spark = encoded.sparkSession
    spec = spark.sparkContext.broadcast(Path(spec_path).read_text(encoding="utf-8"))
    kept = [c for c in encoded.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema.fields)

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = _texts(spec.value)
        for batch in _chunks(batches, ids):
            found = [decode_ids(x or b"", text_of) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*kept, text])

    return encoded.select(*kept).mapInArrow(decode, f"{fields}, `{text}` string")


def bpe_round_trip(docs: DataFrame, spec_path: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` plus ``n_tokens, ids, same_text``: the ids, and whether they decode to the text.

    One pass: a text is encoded, decoded and compared a piece of a batch at a time, and goes no further.  A null text is empty.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(spec_path).read_text(encoding="utf-8"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, text_of = _loaded(spec.value), _texts(spec.value)
        for batch in _chunks(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            found = bpe.encode(texts)
            same = [decode_ids(ids, text_of) == text for ids, text in zip(found, texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([len(ids) // 4 for ids in found], pa.int64()), pa.array(found, pa.binary()), pa.array(same)],
                names=[*keep, "n_tokens", "ids", "same_text"])
        bpe.forget()

    rows = docs.select(*keep, docs["text"].alias("__text"))
    return rows.mapInArrow(work, f"{fields}, n_tokens long, ids binary, same_text boolean")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe_decode(bpe_encode(docs, path).select("doc_id", "ids"), path)
    return decoded.selectExpr("doc_id", "cast(octet_length(ids) / 4 as bigint) as n_tokens",
                              "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")
