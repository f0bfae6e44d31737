"""Paged services and polled feeds as Spark data sources, over recorded responses.

A recorded service is a folder with `slices.json`: how it pages (`offset` or `token`), and slices by date, each with its
first and last day. Pages of a slice are files below the slice's name: by offset, `<offset>.json` for each page of
`page_size` out of `total` records; by token, `first.json` and from there on the file that the page before names, up
to a page without a token or without records. Fetching is one method, `PageStore.get`.

Offsets are known beforehand, so pages are dealt to partitions, several to one if there are many; a chain of tokens can
only be walked, so a slice is a partition. Comparisons of `first_day` and `last_day` with a date are pushed into the
source, and slices outside them are never opened. A page that is missing or broken fails its task, which Spark repeats.

A recorded feed is a folder of polls, files that are one JSON list of entries each, in order of their names. As a
stream its offset is the number of polls taken; a query that is started again from its checkpoint reads on from there.
The driver only counts polls; tasks read them, `polls_per_task` each.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Pages by offset that a partition takes, where there are more than `MOST_PARTITIONS` of them.
MOST_PARTITIONS = 10_000
PAGE_SCHEMA = "slice string, first_day date, last_day date, page int, token string, n_records int, body string"
_FIRST = "first"


class PageStore:
    """Recorded responses by name."""

    def __init__(self, path: str):
        self.path = re.sub(r"^file:/+", "/", path)

    def get(self, name: str) -> str:
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{name}") as f:
            return f.read().decode()

    def names(self) -> list[str]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.endswith(".json"))


def _at(body: object, path: str) -> object:
    for name in filter(None, path.split(".")):
        body = body.get(name) if isinstance(body, dict) else None
    return body


@dataclass
class PagesOf(ds.InputPartition):
    """Pages of one slice: those of the given offsets, or, without any, the chain from the first page on."""

    slice: str
    first_day: dt.date | None
    last_day: dt.date | None
    offsets: list[int] | None


_TESTS = {
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.EqualTo: lambda a, b: a == b,
}


class PagedReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.store = PageStore(options["path"])
        self.records, self.next = options.get("records", ""), options.get("next", "nextPageToken")
        self.tests: list[tuple[type, str, dt.date]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Takes comparisons of a slice's days with a date; hands the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in ("first_day", "last_day") and isinstance(f.value, dt.date):
                self.tests.append((type(f), name, f.value))
            else:
                yield f

    def partitions(self) -> list[PagesOf]:
        index = json.loads(self.store.get("slices.json"))
        size = int(index.get("page_size", 100))
        known = []
        for s in index["slices"]:
            first, last = (dt.date.fromisoformat(s[k]) if s.get(k) else None for k in ("from", "to"))
            days = {"first_day": first, "last_day": last}
            if all(days[name] is not None and _TESTS[kind](days[name], value) for kind, name, value in self.tests):
                offsets = list(range(0, int(s["total"]), size)) if index["paging"] == "offset" else None
                known.append(PagesOf(s["slice"], first, last, offsets))
        step = max(1, -(-sum(len(p.offsets or [0]) for p in known) // MOST_PARTITIONS))
        out = []
        for p in known:
            if p.offsets is None:
                out.append(p)
            else:
                out += [PagesOf(p.slice, p.first_day, p.last_day, p.offsets[i : i + step]) for i in range(0, len(p.offsets), step)]
        return out or [PagesOf("", None, None, [])]

    def _pages(self, part: PagesOf) -> Iterator[tuple[str, str]]:
        if part.offsets is not None:
            for offset in part.offsets:
                yield str(offset), self.store.get(f"{part.slice}/{offset}.json")
            return
        token, seen = _FIRST, set()
        while token and token not in seen:
            seen.add(token)
            body = self.store.get(f"{part.slice}/{token}.json")
            if not _at(json.loads(body), self.records):
                return
            yield token, body
            token = _at(json.loads(body), self.next)

    def read(self, partition: PagesOf) -> Iterator[tuple]:
        for i, (token, body) in enumerate(self._pages(partition)):
            found = _at(json.loads(body), self.records)
            page = i if partition.offsets is None else int(token)
            yield partition.slice, partition.first_day, partition.last_day, page, token, len(found or []), body


class PagedSource(ds.DataSource):
    """One row a page. Options: path, records (where the list is in a body), next (where the next token is)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def pages(spark: SparkSession, path: str, *, records: str, next_token: str = "nextPageToken") -> DataFrame:
    """The pages of a recorded service; filters on first_day and last_day are pushed into it."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(path=path, records=records, next=next_token).load()


ENTRY_SCHEMA = "poll int, id string, title string, link string, summary string, published timestamp"


@dataclass
class PollsOf(ds.InputPartition):
    """Polls by their numbers."""

    start: int
    end: int


class FeedReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.store, self.most = PageStore(options["path"]), int(options.get("polls_per_task", "100"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polls": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"polls": len(self.store.names())}

    def partitions(self, start: dict, end: dict) -> list[PollsOf]:
        return [PollsOf(i, min(i + self.most, end["polls"])) for i in range(start["polls"], end["polls"], self.most)]

    def read(self, partition: PollsOf) -> Iterator[tuple]:
        for i, name in enumerate(self.store.names()[partition.start : partition.end], partition.start):
            for e in json.loads(self.store.get(name)):
                when = e.get("published")
                text = (None if e.get(k) is None else str(e[k]) for k in ("id", "title", "link", "summary"))
                yield i, *text, dt.datetime.fromisoformat(when) if when else None

    def commit(self, end: dict) -> None:
        """Polls stay where they are, so there is nothing to let go."""


class FeedSource(ds.DataSource):
    """Entries of polls as a stream. Options: path, polls_per_task."""

    @classmethod
    def name(cls) -> str:
        return "polled_feed"

    def schema(self) -> str:
        return ENTRY_SCHEMA

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(dict(self.options))


def polled(spark: SparkSession, path: str, polls_per_task: int = 100) -> DataFrame:
    """A recorded feed as a stream of entries; `events.new_entries` drops those seen before."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("polled_feed").options(path=path, polls_per_task=str(polls_per_task)).load()
