"""A source of pages behind cursors, as a Spark data source for batches and streams.

A journal, feed or any other partition of an API gives a page for a cursor, and with it the next cursor or none at the
end. A batch reads each partition from where it is told to its end, partitions side by side. A stream's offset is the
cursor reached in every partition, kept in its checkpoint, so that a restarted stream goes on at the cursor where it stopped.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

Fetch = Callable[[dict, str, str], tuple[list[tuple], str | None]]


def page_file(options: dict, partition: str, cursor: str) -> tuple[list[tuple], str | None]:
    """The page ``<path>/<partition>/<cursor>.json`` of a folder that all executors see: ``{"rows": [[...]], "next": cursor or null}``.

    A page that is not there yet has no rows and stays the next one.
    """
    try:
        with open(f"{options['path']}/{partition}/{cursor}.json", encoding="utf-8") as f:
            page = json.load(f)
    except FileNotFoundError:
        return [], cursor
    return [tuple(r) for r in page["rows"]], page["next"]


def fetcher(options: dict) -> Fetch:
    """The function that the option ``fetch`` names as ``module:function``; :func:`page_file` by default."""
    name = options.get("fetch")
    if not name:
        return page_file
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Pages(InputPartition):
    """Pages of one partition from a cursor up to, and without, another; None as the end: all there are."""

    partition: str
    start: str
    end: str | None


def read_pages(options: dict, part: Pages, most: int) -> Iterator[tuple]:
    fetch, cursor = fetcher(options), part.start
    for _ in range(most):
        rows, following = fetch(options, part.partition, cursor)
        yield from ((part.partition, cursor, *r) for r in rows)
        if following is None or following in (cursor, part.end):
            return
        cursor = following
    raise RuntimeError(f"{part.partition} has more than {most} pages, or its cursors form a ring")


class PagedSource(DataSource):
    """Format ``kelpgrid_pages``. Options: ``partitions`` (comma-separated), ``first`` (cursor of the first page, ``*``), ``cursors``
    (JSON of partition to the cursor to begin at), ``fetch``, ``pages_per_batch`` (10), ``most_pages`` (1,000,000, more raise),
    and what the fetcher reads. The schema is ``partition string, cursor string`` and then the page's columns."""

    @classmethod
    def name(cls) -> str:
        return "kelpgrid_pages"

    def schema(self) -> str:
        return "partition string, cursor string, id string, title string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(dict(self.options))


def first_cursors(options: dict) -> dict[str, str]:
    given = json.loads(options.get("cursors", "{}"))
    names = [p.strip() for p in options["partitions"].split(",") if p.strip()]
    return {p: given.get(p, options.get("first", "*")) for p in names}


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Pages]:
        return [Pages(p, c, None) for p, c in first_cursors(self.options).items()]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return read_pages(self.options, partition, int(self.options.get("most_pages", 1_000_000)))


class PagedStream(DataSourceStreamReader):
    """Offsets are ``{partition: cursor}`` of the next page; an ended partition has the cursor None and gets no more pages."""

    def __init__(self, options: dict):
        self.options = options
        self.reached: dict[str, str | None] | None = None

    def initialOffset(self) -> dict:
        return first_cursors(self.options)

    def latestOffset(self) -> dict:
        """Up to ``pages_per_batch`` pages further in every partition; the driver keeps only their cursors."""
        fetch = fetcher(self.options)
        reached = dict(self.reached or self.initialOffset())
        for p, cursor in reached.items():
            for _ in range(int(self.options.get("pages_per_batch", 10))):
                if cursor is None:
                    break
                _, following = fetch(self.options, p, cursor)
                if following == cursor:
                    break
                cursor = following
            reached[p] = cursor
        self.reached = reached
        return reached

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.reached = dict(end)  # after a restart the offset is the checkpoint's
        return [Pages(p, c, end.get(p)) for p, c in start.items() if c is not None and c != end.get(p)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return read_pages(self.options, partition, int(self.options.get("most_pages", 1_000_000)))
