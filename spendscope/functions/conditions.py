"""Campaign conditions: unanchored, case-insensitive regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F


def matches_all(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(and_, [matches_any(text, [p]) for p in patterns])


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return F.rlike(text, F.lit("(?iu)" + "|".join(patterns)))


def matches_none(text: Column, patterns: Sequence[str]) -> Column:
    return ~matches_any(text, patterns)


@dataclass(frozen=True)
class Condition:
    """All of, any of and none of the patterns; an empty list asks nothing.

    A row with a missing campaign satisfies no condition.
    """

    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.all_of or self.any_of or self.none_of)

    def on(self, text: Column) -> Column:
        parts = [
            test(text, patterns)
            for test, patterns in (
                (matches_all, self.all_of),
                (matches_any, self.any_of),
                (matches_none, self.none_of),
            )
            if patterns
        ]
        return F.coalesce(reduce(and_, parts), F.lit(False)) if parts else F.lit(True)
