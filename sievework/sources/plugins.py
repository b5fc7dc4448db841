"""Sources of cases as plug-ins: an adapter becomes a format of spark.read."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Adapter(ABC):
    """Reads the records of one kind of source.

    ``name`` is the format's name and ``schema`` its columns. The options of the
    read, ``path`` among them, are in ``options``. Each of ``parts()`` is read by a
    task of its own, so a large source should have many.
    """

    name: str
    schema: str

    def __init__(self, options: dict[str, str]):
        self.options = options

    def parts(self) -> list:
        return [None]

    @abstractmethod
    def records(self, part) -> Iterator[dict]: ...


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


def register(spark: SparkSession, kind: type[Adapter]) -> None:
    """Makes ``spark.read.format(kind.name)`` read through an adapter; fields that a record lacks are null."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str], names: list[str]):
            self.adapter, self.names = kind(options), names

        def partitions(self):
            return [_Part(p) for p in self.adapter.parts()]

        def read(self, partition):
            for record in self.adapter.records(partition.value):
                yield tuple(record.get(n) for n in self.names)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind.name

        def schema(self) -> str:
            return kind.schema

        def reader(self, schema):
            return Reader(dict(self.options), schema.names)

    spark.dataSource.register(Source)
