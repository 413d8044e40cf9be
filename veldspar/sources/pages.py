"""Paged services as a Spark source (SRC-08): ``spark.read.format("veldspar_pages")``.

Options: ``fetch``, the importable ``module:function`` that gives the records (dicts) of a page, called
as fetch(base, page, page_size) on the executors; ``base``, what it reads from; ``page_size``;
``pages_per_task``; ``max_pages``, an error if there are more; ``retries`` of a failing page, each after
twice the wait of the one before (``wait`` seconds).  The columns are those of the stated schema and
``page``.

The number of pages is not known beforehand: planning doubles a page number until that page is short
(its records are not kept), and the pages up to there are dealt out in ranges.  A task reads its range
in order and stops at the first short page; ranges past the end see one empty page.  A page that still fails after its retries fails the task, which Spark runs again.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "veldspar_pages"


class Pages(InputPartition):
    """Pages first .. last of a service."""

    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def attempt(call: Callable[[], list[dict]], retries: int, wait: float) -> list[dict]:
    """The call's answer, tried again after a failure with growing waits; the last failure is raised."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    raise AssertionError


class PageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.fetch, self.base = options["fetch"], options.get("base", "")
        self.size, self.per_task = int(options.get("page_size", 100)), int(options.get("pages_per_task", 16))
        self.most = int(options.get("max_pages", 300))
        self.retries, self.wait = int(options.get("retries", 3)), float(options.get("wait", 0.5))
        if min(self.size, self.per_task, self.most) < 1 or self.retries < 0:
            raise ValueError("page_size, pages_per_task and max_pages are at least 1, retries at least 0")

    def get(self, page: int) -> list[dict]:
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        got = attempt(lambda: fetch(self.base, page, self.size), self.retries, self.wait)
        if len(got) > self.size:
            raise ValueError(f"page {page} holds more than page_size records")
        return got

    def partitions(self) -> list[Pages]:
        # One page past the most is asked for, to see whether there are more.
        last = 1
        while last <= self.most and len(self.get(last)) == self.size:
            last *= 2
        last = min(last, self.most + 1)
        return [Pages(a, min(a + self.per_task - 1, last)) for a in range(1, last + 1, self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            got = self.get(page)
            if got and page > self.most:
                raise ValueError(f"more than max_pages ({self.most}) pages")
            for record in got:
                yield tuple(page if c == "page" else record.get(c) for c in self.names)
            if len(got) < self.size:
                return


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page long"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema, self.options)


def read_pages(spark: SparkSession, fetch: str, schema: str, **options) -> DataFrame:
    """The records of all pages, with their ``page`` (SRC-08)."""
    spark.dataSource.register(PageSource)
    return spark.read.format(NAME).schema(f"{schema}, page long").option("fetch", fetch).options(**{k: str(v) for k, v in options.items()}).load()


def parquet_page(base: str, page: int, size: int) -> list[dict]:
    """A page of the rows of a Parquet file, or of a folder of them by name; only the row groups that hold it are read."""
    from pyarrow import fs, parquet

    system, path = fs.FileSystem.from_uri(base) if ":/" in base else (fs.LocalFileSystem(), base)
    whole = system.get_file_info(path)
    inside = system.get_file_info(fs.FileSelector(path)) if whole.type == fs.FileType.Directory else [whole]
    first, out = (page - 1) * size, []
    for name in sorted(i.path for i in inside if i.path.endswith(".parquet")):
        with system.open_input_file(name) as f:
            file = parquet.ParquetFile(f)
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if first < n and len(out) < size:
                    out += file.read_row_group(g).slice(max(first, 0), size - len(out)).to_pylist()
                first -= n
    return out
