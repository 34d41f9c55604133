"""Filters of the document store and of the metadata engine as Column expressions.

A store filter skips a predicate whose value is falsy (an empty list, an empty string, 0, None): it doesn't match nothing.
Where "match nothing" is meant, pass ``Scope.nothing()``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Scope:
    """All rows, the rows of some ids, or none; it can't widen by accident."""

    kind: str
    ids: tuple[str, ...] = ()

    @staticmethod
    def all() -> Scope:
        return Scope("all")

    @staticmethod
    def some(ids: Sequence[str]) -> Scope:
        return Scope("some", tuple(ids)) if ids else Scope("nothing")

    @staticmethod
    def nothing() -> Scope:
        return Scope("nothing")

    def on(self, column: str) -> Column:
        if self.kind == "all":
            return F.lit(True)
        return F.col(column).isin(*self.ids) if self.kind == "some" else F.lit(False)


def store_filter(df: DataFrame, condition: Mapping[str, Any]) -> DataFrame:
    """Conjunction of term filters. A list means any of; on an array column any element; ``available`` counts a missing
    flag as available; ``must_not`` names columns that have to be missing; falsy values are skipped."""
    tests: list[Column] = []
    for name, value in condition.items():
        if name == "available":
            if value is not None:
                usable = F.coalesce(F.col("available"), F.lit(1)) >= 1
                tests.append(usable if value else ~usable)
        elif name == "must_not":
            tests += [F.col(c).isNull() for c in value]
        elif value:
            values = list(value) if isinstance(value, (list, tuple, set)) else [value]
            is_array = isinstance(df.schema[name].dataType, T.ArrayType)
            tests.append(F.arrays_overlap(name, F.array(*map(F.lit, values))) if is_array else F.col(name).isin(*values))
    return df.where(reduce(and_, tests)) if tests else df


_TREE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<<": lambda c, v: c.isin(*v),
    "%": lambda c, v: c.like(v),
    "**": lambda c, v: F.lower(c).contains(v.lower()),
    "^": lambda c, v: c.startswith(v),
    "~": lambda c, v: c.rlike(v),
}


def predicate_tree(conditions: Sequence[tuple[str, str, Any]]) -> Column:
    """Conjunction of (column, operator, value) triples."""
    return reduce(and_, (_TREE[op](F.col(c), v) for c, op, v in conditions), F.lit(True))


def model_filter(df: DataFrame, **wanted: Any) -> DataFrame:
    """Generic scan: equality; IN for lists; two-element lists on numbers and times are bounds, either may be None."""
    for name, value in wanted.items():
        kind = df.schema[name].dataType
        if isinstance(value, (list, tuple)):
            if len(value) == 2 and isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
                low, high = value
                if low is not None:
                    df = df.where(F.col(name) >= low)
                if high is not None:
                    df = df.where(F.col(name) <= high)
            else:
                df = df.where(F.col(name).isin(*value))
        else:
            df = df.where(F.col(name).eqNullSafe(value))
    return df


def inclusive_end(bound: str) -> str:
    """A date alone means the end of that day."""
    return f"{bound} 23:59:59" if len(bound) == 10 else bound


def path_filter(path: Column, suffix: str) -> Column:
    """Files of a suffix, without the lock files that office programs leave beside them."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.lower(path).endswith(suffix.lower()) & ~name.startswith("~$")


def below(path: Column, prefix: str) -> Column:
    """The path itself or anything below it, whatever the case."""
    p, q = F.lower(path), prefix.lower().rstrip("/")
    return (p == q) | p.startswith(q + "/")


#: Other spellings of the metadata operators.
ALIASES = {"is": "=", "not is": "≠", ">=": "≥", "<=": "≤", "!=": "≠", "==": "="}
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def metadata_test(value: Column, op: str, wanted: Any) -> Column:
    """One of the 14 metadata operators on a string bucket value.

    Comparisons: against a YYYY-MM-DD date only dates compare, as strings; else both sides as numbers if both are numbers,
    otherwise as lower-cased strings, and an order between a number and a word never holds. ``in`` with a string is
    containment in that string, with a list membership. A row without the key is no bucket and never matches.
    """
    op = ALIASES.get(op, op)
    text = F.lower(value)
    if op == "empty":
        return value == ""
    if op == "not empty":
        return value != ""
    if op in ("in", "not in"):
        if isinstance(wanted, (list, tuple)):
            hit = text.isin(*[str(w).lower() for w in wanted])
        else:
            hit = F.lit(str(wanted).lower()).contains(text)
        return hit if op == "in" else ~hit
    word = str(wanted).lower()
    if op == "contains":
        return text.contains(word)
    if op == "not contains":
        return ~text.contains(word)
    if op == "start with":
        return text.startswith(word)
    if op == "end with":
        return text.endswith(word)
    compare = {"=": lambda a, b: a == b, "≠": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "≥": lambda a, b: a >= b, "≤": lambda a, b: a <= b}[op]
    if re.match(_DATE, word.strip()):  # only dates are compared without the white space around them
        return F.trim(value).rlike(_DATE) & compare(F.trim(value), F.lit(word.strip()))
    number = text.try_cast("double")
    try:
        wanted_number = float(word)
    except ValueError:
        wanted_number = None
    if wanted_number is not None:
        mixed = F.lit(op == "≠")
        return F.when(number.isNotNull(), compare(number, F.lit(wanted_number))).otherwise(mixed)
    return F.when(number.isNull(), compare(text, F.lit(word))).otherwise(F.lit(op == "≠"))


def metadata_filter(eav: DataFrame, filters: Sequence[tuple[str, str, Any]], logic: str = "and") -> DataFrame:
    """(doc_id) of documents that match; eav has (doc_id, key, value), one row for each value of a list.

    Each filter gives a set of documents: a document with the values [a, b] matches "≠ a" by its other value. ``and`` intersects
    the sets, ``or`` unites them. All filters are tested in one pass and one aggregation by document. No filters: no rows.
    """
    if not filters:
        return eav.select("doc_id").limit(0)
    flags = [F.max((F.col("key") == k) & metadata_test(F.col("value"), op, v)).alias(f"_{i}") for i, (k, op, v) in enumerate(filters)]
    keys = sorted({k for k, _, _ in filters})
    tested = eav.where(F.col("key").isin(*keys) & F.col("value").isNotNull()).groupBy("doc_id").agg(*flags)
    hits = [F.coalesce(F.col(f"_{i}"), F.lit(False)) for i in range(len(filters))]
    return tested.where(reduce(and_ if logic == "and" else or_, hits)).select("doc_id")


def manual_filter(eav: DataFrame, filters: Sequence[tuple[str, str, Any]], logic: str = "and") -> DataFrame:
    """Filters that a user has set: no hit is an empty scope, never "no filter"."""
    return metadata_filter(eav, filters, logic)


def any_within_key(eav: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(doc_id): any of the values within a key, all keys; keys without values are skipped."""
    used = {k: v for k, v in wanted.items() if v}
    flags = [F.max((F.col("key") == k) & F.col("value").isin(*v)).alias(f"_{i}") for i, (k, v) in enumerate(used.items())]
    if not flags:
        return eav.select("doc_id").distinct()
    tested = eav.where(F.col("key").isin(*used)).groupBy("doc_id").agg(*flags)
    return tested.where(reduce(and_, (F.coalesce(F.col(f"_{i}"), F.lit(False)) for i in range(len(used))))).select("doc_id")
