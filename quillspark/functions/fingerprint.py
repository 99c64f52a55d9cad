"""64-bit fingerprints of texts and their distance."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound

WIDTH = 3
_known: dict[str, int] = {}


def flattened(text: Column) -> Column:
    """The text in lower case, of letters, digits and ``_`` only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def grams(text: Column, width: int = WIDTH) -> Column:
    """Overlapping pieces of ``width`` characters of the flattened text; at least one."""
    pieces = lambda flat: F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - (width - 1), F.lit(1))), lambda i: F.substring(flat, i, F.lit(width)))
    return bound(flattened(text), pieces)


def _bits(gram: str) -> int:
    if gram not in _known:
        if len(_known) > 500_000:
            _known.clear()
        _known[gram] = int.from_bytes(hashlib.md5(gram.encode()).digest()[-8:], "big")
    return _known[gram]


def _voted(counted: Counter) -> str:
    codes = np.array([_known.get(g) or _bits(g) for g in counted], ">u8")
    weights = np.fromiter(counted.values(), np.float64, len(counted))
    votes = weights @ np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    return np.packbits(2 * votes > weights.sum()).tobytes().hex()


@F.pandas_udf(T.StringType())
def _majority(flat: pd.Series) -> pd.Series:
    return pd.Series(["0" * 16 if each is None else _voted(Counter([each[i : i + WIDTH] for i in range(max(len(each) - WIDTH + 1, 1))])) for each in flat])


@F.pandas_udf(T.StringType())
def _majority_words(words: pd.Series) -> pd.Series:
    return pd.Series(["0" * 16 if each is None else _voted(Counter(each)) for each in words])


def simhash(text: Column, by_words: bool = False) -> Column:
    """16 hexadecimal digits: the bits that most grams (or words in lower case) have; all zeros for null and blank texts."""
    blank = F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))
    if by_words:
        return _majority_words(F.when(~blank, F.filter(F.split(F.lower(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")))
    return _majority(F.when(~blank, flattened(text)))


def as_bits(digits: Column) -> Column:
    """Hexadecimal digits as bigint (two's complement)."""
    full = F.lpad(digits, 16, "0")
    half = lambda at: F.conv(F.substring(full, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def distance(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints of hexadecimal digits differ."""
    return F.bit_count(as_bits(a).bitwiseXOR(as_bits(b)))
