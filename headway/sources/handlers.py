"""Callbacks on the rows of feed tables, with a result when all rows have been seen.

A handler sees the rows of each partition one after another, in tasks, and makes
one value of them; the partitions' values are merged on the way to the driver, and ``complete`` gets the
merged one, once. A task that is lost or repeated gives no second value: values
come back as task results, of which Spark takes one per partition, and not as side
effects. So a handler that counts is right after any failure; one that writes
elsewhere must itself stand being run twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row

from headway.sources import schema
from headway.sources.feed import Feed, FeedError


class Handler:
    """What to do with the rows of one table (``table``). Subclasses say what a row adds to a partition's value, and how two values become one."""

    table = ""

    def begin(self) -> Any:
        """The value of no rows."""
        raise NotImplementedError

    def row(self, value: Any, row: Row) -> Any:
        """The value with one row more; runs in a task, on a copy of the handler."""
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def complete(self, value: Any) -> None:
        """Called on the driver once all rows have been seen; ``value`` is None if the table has no partition."""

    def reset(self) -> None:
        """Called before rows are read, so that a handler can be used again."""

    def fits(self, name: str) -> bool:
        return name == self.table


class Handlers:
    """Handlers by table, run together: a table is read once for all of its handlers."""

    def __init__(self, feed: Feed):
        self.feed, self.of = feed, {}

    def register(self, handler: Handler, name: str | None = None) -> Handlers:
        name = handler.table if name is None else name
        if name not in schema.COLUMNS or not handler.fits(name):
            raise FeedError(f"{type(handler).__name__} handles {handler.table or 'no table'}, not {name}")
        self.of.setdefault(name, []).append(handler)
        return self

    def reset(self) -> None:
        for handlers in self.of.values():
            for handler in handlers:
                handler.reset()

    def read(self, columns: str = "all") -> None:
        """Resets all handlers, reads every table that has some, and completes them. A table that the feed lacks completes with None."""
        self.reset()
        for name, handlers in self.of.items():
            values = handled(self.feed.table(name, columns), handlers) if self.feed.has(name) else [None] * len(handlers)
            for handler, value in zip(handlers, values, strict=True):
                handler.complete(value)


def handled(rows: DataFrame, handlers: list[Handler]) -> list[Any]:
    """The merged value of each handler over the rows."""

    def run(part: Iterator[Row]) -> Iterator[list[Any]]:
        values = [h.begin() for h in handlers]
        for row in part:
            values = [h.row(v, row) for h, v in zip(handlers, values, strict=True)]
        yield values

    def both(a: list[Any], b: list[Any]) -> list[Any]:
        return [h.merge(x, y) for h, x, y in zip(handlers, a, b, strict=True)]

    parts = rows.rdd.mapPartitions(run)
    return parts.treeReduce(both) if parts.getNumPartitions() else [None] * len(handlers)


class Counting(Handler):
    """Rows, and distinct values of a column of few values."""

    def __init__(self, table: str, column: str):
        self.table, self.column, self.counts = table, column, None

    def reset(self) -> None:
        self.counts = None

    def begin(self) -> dict[str, int]:
        return {}

    def row(self, value: dict[str, int], row: Row) -> dict[str, int]:
        value[row[self.column]] = value.get(row[self.column], 0) + 1
        return value

    def merge(self, a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
        return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}

    def complete(self, value: dict[str, int] | None) -> None:
        self.counts = value or {}
