"""Pages of ordered results: keyset predicates, opaque cursors that are bound to a request, and totals."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parameters import QueryError


@dataclass(frozen=True)
class Key:
    """An ordering column: ascending with nulls first, or descending with nulls last."""

    name: str
    descending: bool = False

    def order(self) -> Column:
        """The sort expression."""
        return F.desc_nulls_last(self.name) if self.descending else F.asc_nulls_first(self.name)

    def after(self, value) -> tuple[Column, Column]:
        """(rows after a value, rows at it) as predicates that treat null as the first, or last, value."""
        c = F.col(self.name)
        if value is None:
            return (F.lit(False) if self.descending else c.isNotNull()), c.isNull()
        v = F.lit(value)
        return ((c < v) | c.isNull() if self.descending else c > v), c == v


def after(keys: list[Key], values: list) -> Column:
    """Rows that follow the given key values in the order of keys."""
    found, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values, strict=True):
        beyond, at = key.after(value)
        found = found | (same & beyond)
        same = same & at
    return F.coalesce(found, F.lit(False))


@dataclass
class Page:
    """One page: rows (lazy), and how to get the total and the next page's cursor."""

    rows: DataFrame
    all_rows: DataFrame
    keys: list[Key]
    limit: int
    binding: tuple = field(default_factory=tuple)
    counted: Callable[[], int] | None = None

    def total(self) -> int:
        """The exact number of rows of all pages."""
        return self.all_rows.count() if self.counted is None else self.counted()

    def next_cursor(self) -> str | None:
        """A cursor if another row follows; collects at most one page of keys."""
        seen = self.all_rows.orderBy(*[k.order() for k in self.keys]).select(*[k.name for k in self.keys]).limit(self.limit + 1).collect()
        return encode(self.binding, list(seen[self.limit - 1])) if len(seen) > self.limit else None


def page(df: DataFrame, keys: list[Key], limit: int, binding: tuple = (), cursor: str | None = None) -> Page:
    """The page of df that follows a cursor; the total counts every page."""
    rows = df.where(after(keys, decode(binding, cursor, len(keys)))) if cursor else df
    return Page(rows.orderBy(*[k.order() for k in keys]).limit(limit), rows, keys, limit, binding, df.count)


def digest(parameters: dict) -> str:
    """128 bits that stand for normalised parameters, whatever their order; unset ones don't count."""
    set_ones = {k: v for k, v in parameters.items() if v is not None}
    return hashlib.sha256(json.dumps(set_ones, sort_keys=True, default=str).encode()).hexdigest()[:32]


def encode(binding: tuple, key: list) -> str:
    """base64url JSON of the binding (generation, kind of order, digest) and the last row's key."""
    return base64.urlsafe_b64encode(json.dumps([*binding, *key], default=str).encode()).decode().rstrip("=")


def decode(binding: tuple, cursor: str, size: int) -> list:
    """The key of a cursor; raises invalid_cursor if it belongs to another generation, order or request."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise QueryError("invalid_cursor") from e
    if not isinstance(found, list) or len(found) != len(binding) + size or found[: len(binding)] != list(binding):
        raise QueryError("invalid_cursor")
    return found[len(binding) :]
