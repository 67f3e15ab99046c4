"""Histograms of a text's characters, counted in its own row by sorted code points.

An explode to a row for each character is what this replaces: a text of a thousand characters gives some
fifty rows instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.ArrayType(T.StructType([T.StructField("ch", T.IntegerType()), T.StructField("n", T.LongType())]))
PAIRS = T.ArrayType(
    T.StructType([T.StructField("class", T.IntegerType()), T.StructField("ch", T.IntegerType()), T.StructField("n", T.LongType())])
)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def classes_before(codes: np.ndarray) -> np.ndarray:
    """Class of the character before each: 0 none, 1 small letter a-z, 2 A-Z or digit, 3 any other."""
    small = (codes >= 97) & (codes <= 122)
    large = ((codes >= 65) & (codes <= 90)) | ((codes >= 48) & (codes <= 57))
    own = np.where(small, 1, np.where(large, 2, 3))
    return np.concatenate([[0], own[:-1]])[: len(codes)]


@F.pandas_udf(COUNTS)
def character_counts(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[dict]:
        chars, n = counted(code_points(text))
        return [{"ch": c, "n": k} for c, k in zip(chars.tolist(), n.tolist(), strict=True)]

    return texts.map(one, na_action=None)


@F.pandas_udf(PAIRS)
def context_counts(texts: pd.Series) -> pd.Series:
    """Characters counted apart by the class of the one before."""

    def one(text: str | None) -> list[dict]:
        codes = code_points(text)
        keys, n = counted(classes_before(codes) << 21 | codes)
        return [{"class": k >> 21, "ch": k & 0x1FFFFF, "n": c} for k, c in zip(keys.tolist(), n.tolist(), strict=True)]

    return texts.map(one, na_action=None)
