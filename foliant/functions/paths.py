"""Logical path identity: trimmed, slashes for backslashes, NFC, full Unicode case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_path(path: str | None) -> str | None:
    """The key of one path; a missing or blank path has none."""
    if path is None:
        return None
    return unicodedata.normalize("NFC", path.strip().replace("\\", "/")).casefold() or None


@F.pandas_udf(T.StringType())
def path_key(paths: pd.Series) -> pd.Series:
    """Column form of fold_path (neither NFC nor full case folding is built into Spark)."""
    return paths.map(fold_path, na_action="ignore").astype(object).where(paths.notna(), None)
