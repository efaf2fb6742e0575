"""Ordered keyword rules as column expressions.

A rule list is a driver-side parameter, so it becomes one literal array that each row scans; the
generated code stays small however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(col: Column | str) -> Column:
    """Trimmed text, or NULL where nothing is left."""
    return F.nullif(F.trim(F.col(col) if isinstance(col, str) else col), F.lit(""))


def literal_map(values: Mapping) -> Column:
    """A small mapping as a literal map column."""
    pairs = [F.lit(part) for pair in values.items() for part in pair]
    return F.create_map(*pairs)


def look_up(values: Mapping, key: Column) -> Column:
    """The mapped value of ``key``, NULL where it is not a key."""
    return F.try_element_at(literal_map(values), key)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_array(rules: Iterable[tuple[str, str]]) -> Column:
    """The rules as an array literal, handed over as one SQL text rather than value by value."""
    structs = ", ".join(f"named_struct('keyword', {_quoted(k)}, 'value', {_quoted(v)})" for k, v in rules)
    return F.expr(f"array({structs})")


def first_contained(text: Column, rules: Mapping[str, str]) -> Column:
    """Value of the first keyword, in rule order, that ``text`` contains; else NULL."""
    hits = F.filter(rule_array(rules.items()), lambda rule: F.contains(text, rule["keyword"]))
    return F.get(hits, F.lit(0))["value"]


def all_contained(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Distinct values of all contained keywords, in rule order."""
    hits = F.filter(rule_array(rules), lambda rule: F.contains(text, rule["keyword"]))
    return F.array_distinct(F.transform(hits, lambda rule: rule["value"]))


def first_matching(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """Value of the first pattern, in rule order, that is found in ``text``."""
    result = None
    for pattern, value in rules:
        result = F.when(text.rlike(pattern), value) if result is None else result.when(text.rlike(pattern), value)
    return result.otherwise(otherwise)
