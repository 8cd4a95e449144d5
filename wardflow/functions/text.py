"""String expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from wardflow.functions import fixed_values as fixed


def part(location_string: Column, n: int) -> Column:
    """n-th ``^``-separated part, 1-based; '' when the string has fewer parts."""
    return F.split_part(location_string, F.lit(fixed.SEPARATOR), F.lit(n))


def capture(text: Column, pattern: str) -> Column:
    """First capture group of ``pattern``, NULL when it does not match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def capture_int(text: Column, pattern: str) -> Column:
    return capture(text, pattern).try_cast("int")


def initials(*names: Column) -> Column:
    """First letters joined; a missing name is skipped."""
    return F.concat_ws("", *[F.left(n, F.lit(1)) for n in names])


def first_match(rules: Iterable[tuple[Column, object]]) -> Column:
    """Value of the first rule that holds, NULL if none does."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, value)
    return chain


def label_for(code: Column, labels: Iterable[tuple[str, object]]) -> Column:
    return first_match((code == key, value) for key, value in labels)
