"""Normalised words of texts: A-Z in lower case, separated by any other ASCII character than letters and digits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.llm.common import ascii_lower

#: Words of an already lower-cased text; in UTF-8 every byte from 0x80 on belongs to a word.
NORMAL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text that are split into words at a time.
SEGMENT = 1 << 20
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def normal(raw: bytes) -> bytes:
    """The text with each separator as a blank; every byte keeps its place."""
    return raw.translate(_NORMAL)


def word_lists(raw: bytes, segment: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of about ``segment`` bytes; no word is cut."""
    at = 0
    while at < len(raw):
        part = normal(raw[at:at + segment])
        end = at + len(part)
        if end < len(raw):
            cut = part.rfind(b" ") + 1
            if cut:
                part = part[:cut]
            else:  # one word fills the segment: go on to its end
                parts = [part]
                while end < len(raw) and parts[-1].find(b" ") < 0:
                    parts.append(normal(raw[end:end + segment]))
                    end += len(parts[-1])
                part = b"".join(parts)
                part = part[:part.find(b" ") + 1] or part
        at += len(part)
        yield part.split()


def normal_words(text: Column) -> Column:
    """The same words as an array of strings; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(NORMAL_WORD), F.lit(0))
