"""HTTP bodies as a Spark data source: one partition a request, read on the executors under the same policy.

    spark.dataSource.register(BodySource)
    spark.read.format("planwright_bodies").option("urls", json.dumps([...])).load()   # request, url, body
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import PlanError
from .records import MOST_REQUESTS, check_url, fetch


class Request(InputPartition):
    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class BodyReader(DataSourceReader):
    get = staticmethod(fetch)
    check = staticmethod(check_url)

    def __init__(self, options: dict):
        self.urls = list(dict.fromkeys(json.loads(options.get("urls", "[]"))))  # one request an address
        if len(self.urls) > MOST_REQUESTS:
            raise PlanError("BAD_SOURCE", f"over {MOST_REQUESTS} requests")

    def partitions(self) -> list[Request]:
        return [Request(i, u) for i, u in enumerate(self.urls)]

    def read(self, partition: Request) -> Iterator[tuple]:
        self.check(partition.url)
        yield partition.number, partition.url, self.get(partition.url)


class BodySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "planwright_bodies"

    def schema(self) -> str:
        return "request int, url string, body string"

    def reader(self, schema: object) -> BodyReader:
        return BodyReader(self.options)
