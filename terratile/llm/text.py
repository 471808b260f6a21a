"""Small shared pieces of the text operators."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything but digits, lower-case ASCII letters and non-ASCII characters parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_line(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by single blanks (null: empty)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, NOT_WORD, " "))


def word_array(text: Column) -> Column:
    """The same words as an array; a text without words gives an empty array."""
    line = word_line(text)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def give_back() -> None:
    """Hand freed memory back to the system, so that a worker process between batches holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (AttributeError, OSError):  # another C library has no such call
            pass
