"""A source of paged feeds: folders of pages that name the page to go on with.

``<path>/author=<author>/page=<number>/`` holds one page, a JSON line
``{"cursor": number of the next older page or null, "items": [...]}`` with the newest
item first; newer pages have higher numbers. An author is a partition. A scan begins at the newest
page, or at a ``cursor``, and follows the cursors until one is null, ``most`` items are
read, or, where ``seq`` is asked to be above a number, a page has come down to it:
what lies behind isn't read. A filter on ``author`` reads that author's folder only.

As a stream the source gives the items of pages that have come since, by page number.

Pages are read by the executors with ``pyarrow.fs``, which must know the store of the path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Feed(InputPartition):
    """Pages of one author: from ``newest`` on along the cursors, or just those of some numbers."""

    folder: str
    author: str
    pages: tuple[int, ...] = ()
    cursor: int | None = None


def _opened(path: str):
    return fs.FileSystem.from_uri(path)


def _numbered(store, folder: str, name: str) -> list[tuple[str, str]]:
    """(value, path) of the subfolders name=value."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((x.base_name.partition("=")[2], x.path) for x in found if x.type == fs.FileType.Directory and x.base_name.startswith(f"{name}="))


def _page(store, folder: str, number: int) -> dict:
    """One page; a number without a page is an error."""
    found = store.get_file_info(fs.FileSelector(f"{folder}/page={number:08d}"))
    files = [x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
    with store.open_input_stream(files[0]) as f:
        return json.loads(f.read().decode())


class _Rows:
    def __init__(self, schema: StructType, options: dict):
        self.path, self.names = options["path"], schema.names
        self.most = int(options.get("most", 0)) or None
        self.cursor = int(options["cursor"]) if "cursor" in options else None

    def row(self, author: str, page: int, item: dict) -> tuple:
        return tuple(author if n == "author" else page if n == "page" else item.get(n) for n in self.names)

    def authors(self, only: str | None = None) -> list[Feed]:
        store, root = _opened(self.path)
        return [Feed(path, a, cursor=self.cursor) for a, path in _numbered(store, root, "author") if only is None or a == only]


class FeedReader(_Rows, DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.author: str | None = None
        self.above: int | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("author",):
                self.author = str(f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("seq",):
                self.above = max(self.above if self.above is not None else f.value, f.value)
            yield f  # pages are left out by it; rows are still Spark's to filter

    def partitions(self) -> list[Feed]:
        return self.authors(self.author)

    def read(self, partition: Feed | None) -> Iterator[tuple]:
        if partition is None:  # Spark's, where there are no authors
            return
        store, _ = _opened(self.path)
        number, n = partition.cursor, 0
        if number is None:
            pages = _numbered(store, partition.folder, "page")
            number = int(pages[-1][0]) if pages else None
        while number is not None:
            page = _page(store, partition.folder, number)
            for item in page["items"]:
                yield self.row(partition.author, number, item)
                n += 1
                if n == self.most:
                    return
            if self.above is not None and page["items"] and page["items"][-1]["seq"] < self.above:
                return
            number = page["cursor"]


class FeedStream(_Rows, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        store, root = _opened(self.path)
        return {"page": max((int(p) for _, a in _numbered(store, root, "author") for p, _ in _numbered(store, a, "page")), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        store, root = _opened(self.path)
        wanted = lambda folder: tuple(int(p) for p, _ in _numbered(store, folder, "page") if start["page"] < int(p) <= end["page"])
        return [Feed(folder, a, pages) for a, folder in _numbered(store, root, "author") if (pages := wanted(folder))]

    def read(self, partition: Feed) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for number in partition.pages:
            for item in _page(store, partition.folder, number)["items"]:
                yield self.row(partition.author, number, item)


class PagedFeed(DataSource):
    """Format ``paged_feed``; options path, most, cursor. The schema may name author, page, and what items hold."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "author string, page long, seq long, uri string, text string"

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> FeedStream:
        return FeedStream(schema, self.options)


def feed(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Items of all feeds under a path, each author's newest first. Filters reach the source: the session is set to push them down."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PagedFeed)
    reader = spark.read.format("paged_feed").options(path=path, **options)
    return (reader.schema(schema) if schema else reader).load()
