"""Rows that Python generates, as a Spark data source: in partitions, by batch or as a stream with offsets.

A generator is a function (first, last) -> rows numbered first to last - 1; it is sent to the executors.  A row depends on its number
alone, so that a lost partition, or a stream that goes on from its checkpoint, gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    """The numbers of a partition."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def spans(first: int, last: int, parts: int) -> list[Span]:
    """At most `parts` spans, whose sizes differ by one at most."""
    edges = [first + (last - first) * k // parts for k in range(parts + 1)]
    return [Span(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def register(spark: SparkSession, name: str, schema: str, generate: Callable[[int, int], Iterator[tuple]]) -> None:
    """Makes spark.read.format(name) and spark.readStream.format(name) give the generator's rows.

    Options: rows (how many there are) and partitions (8).  A stream that is started again with more rows gives those that are new."""

    class Batch(DataSourceReader):
        def __init__(self, rows, parts):
            self.rows, self.parts = rows, parts

        def partitions(self):
            return spans(0, self.rows, self.parts) or [Span(0, 0)]

        def read(self, partition):
            yield from generate(partition.first, partition.last)

    class Stream(DataSourceStreamReader):
        def __init__(self, rows, parts):
            self.rows, self.parts = rows, parts

        def initialOffset(self):
            return {"row": 0}

        def latestOffset(self):
            return {"row": self.rows}

        def partitions(self, start, end):
            return spans(start["row"], end["row"], self.parts) or [Span(0, 0)]

        def read(self, partition):
            yield from generate(partition.first, partition.last)

    class Generated(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def settings(self):
            return int(self.options["rows"]), int(self.options.get("partitions", 8))

        def reader(self, schema):
            return Batch(*self.settings())

        def streamReader(self, schema):
            return Stream(*self.settings())

    spark.dataSource.register(Generated)
