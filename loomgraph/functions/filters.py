"""The algebra of name filters: frozen values that turn into boolean columns.

Filters see real names: the default package is the empty name.  Any callable from a column to a boolean column is a filter too, by ``custom``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names


@dataclass(frozen=True)
class NameFilter:
    """label: how the filter is shown; prefix: all accepted names start with it (None: no name is accepted)."""

    label: str
    test: Callable[[Column], Column]
    prefix: str | None = ""

    def __call__(self, c: Column) -> Column:
        return self.test(c)

    def __str__(self) -> str:
        return self.label

    def __and__(self, other: NameFilter) -> NameFilter:
        return all_of(self, other)

    def __or__(self, other: NameFilter) -> NameFilter:
        return any_of(self, other)

    def __invert__(self) -> NameFilter:
        return negated(self)


ANY = NameFilter("any", lambda c: F.lit(True))
NONE = NameFilter("none", lambda c: F.lit(False), None)


def negated(f: NameFilter) -> NameFilter:
    """What the filter doesn't accept."""
    return NameFilter(f"not({f})", lambda c: ~f(c))


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def all_of(*filters: NameFilter) -> NameFilter:
    """What all filters accept; nothing without filters, or if their prefixes exclude each other."""
    label = f"and({','.join(map(str, filters))})"
    longest = max((f.prefix or "" for f in filters), key=len, default="")
    if not filters or any(f.prefix is None or not longest.startswith(f.prefix) for f in filters):
        return NameFilter(label, NONE.test, None)
    return NameFilter(label, lambda c: reduce(lambda x, y: x & y, [f(c) for f in filters]), longest)


def any_of(*filters: NameFilter) -> NameFilter:
    """What some filter accepts; nothing without filters."""
    label = f"or({','.join(map(str, filters))})"
    some = [f for f in filters if f.prefix is not None]
    if not some:
        return NameFilter(label, NONE.test, None)
    return NameFilter(label, lambda c: reduce(lambda x, y: x | y, [f(c) for f in some]), reduce(_common, [f.prefix for f in some]))


def equals_name(s: str) -> NameFilter:
    """One name."""
    return NameFilter(f"equalsName({s})", lambda c: c == s, s)


def starts_with(s: str) -> NameFilter:
    """Names that start with a string."""
    return NameFilter(f"startsWith({s})", lambda c: c.startswith(s), s)


def starts_with_name(s: str) -> NameFilter:
    """A name and what is below it."""
    return NameFilter(f"startsWithName({s})", lambda c: names.starts_with_name(c, s), s)


def ends_with(s: str) -> NameFilter:
    """Names that end with a string."""
    return NameFilter(f"endsWith({s})", lambda c: c.endswith(s))


def ends_with_name(s: str) -> NameFilter:
    """Names whose last parts are a name."""
    return NameFilter(f"endsWithName({s})", lambda c: names.ends_with_name(c, s))


def contains(s: str) -> NameFilter:
    """Names that contain a string."""
    return NameFilter(f"contains({s})", lambda c: c.contains(s))


def contains_name(s: str) -> NameFilter:
    """Names with a name among their parts."""
    return NameFilter(f"containsName({s})", lambda c: names.contains_name(c, s))


def matches(regex: str) -> NameFilter:
    """Names that a pattern matches as a whole."""
    return NameFilter(f"matches({regex})", lambda c: c.rlike(rf"\A(?:{regex})\z"))


def custom(test: Callable[[Column], Column], label: str = "custom") -> NameFilter:
    """Any condition on the name's column."""
    return NameFilter(label, test)


def may_accept_below(prefix: str | None, name: str) -> bool:
    """Whether a filter with this prefix can accept a name that starts with ``name``."""
    return prefix is not None and (prefix.startswith(name) or name.startswith(prefix))
