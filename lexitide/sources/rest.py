"""A Python Data Source for a paginated works API with pushed filters.

    spark.dataSource.register(WorksSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("works_api").options(endpoint=..., subfields="1,2").load().where("year = 2024")

Every shard (year, subfield, access status) is a partition; a shard of more
than ``split_at`` records is split by topic.  ``opener`` names a module-level
function (module:function) that maps an address to its decoded JSON answer; by
default the address is fetched over HTTP.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

STATUSES = ("diamond", "gold", "green", "hybrid", "bronze")


def fetch(address: str) -> dict:
    from urllib.request import urlopen

    with urlopen(address, timeout=60) as answer:
        return json.load(answer)


@dataclass
class Shard(InputPartition):
    year: int
    subfield: str
    status: str
    topic: str | None
    records: int


class WorksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "works_api"

    def schema(self) -> str:
        return "year int, subfield string, oa_status string, topic string, record string"

    def reader(self, schema) -> WorksReader:
        return WorksReader(self.options)


class WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint = options.get("endpoint", "https://api.openalex.org").rstrip("/")
        self.page, self.split_at = int(options.get("page", 200)), int(options.get("split_at", 10_000))
        self.opener = options.get("opener", "")
        self.retries, self.wait = int(options.get("retries", 5)), float(options.get("wait", 1.0))
        # None stands for no restriction, an empty set for nothing
        self.wanted: dict[str, set | None] = {
            "year": set(range(int(options.get("last_year", 2025)), int(options.get("first_year", 2019)) - 1, -1)),
            "subfield": set(filter(None, options.get("subfields", "").split(","))) or None,
            "oa_status": set(options.get("statuses", ",".join(STATUSES)).split(",")),
        }
        self.domain = options.get("domain", "2")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows the shards; every filter goes back to Spark too, which applies it to the rows."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.wanted:
                values, have = {f.value} if isinstance(f, EqualTo) else set(f.value), self.wanted[column]
                self.wanted[column] = values if have is None else have & values
            yield f

    def _open(self) -> Callable[[str], dict]:
        if not self.opener:
            return fetch
        module, function = self.opener.split(":")
        return getattr(importlib.import_module(module), function)

    def _get(self, address: str) -> dict:
        """An answer; failures that may pass (429, 5xx, broken connections) are tried again, each time after twice the wait or what the answer asks for."""
        get = self._open()
        for turn in range(self.retries + 1):
            try:
                return get(address)
            except OSError as error:  # HTTPError and URLError are such
                code = getattr(error, "code", None)
                if turn == self.retries or code is not None and code != 429 and code < 500:
                    raise
                asked = (getattr(error, "headers", None) or {}).get("Retry-After", "")
                time.sleep(max(self.wait * 2**turn, float(asked) if str(asked).isdigit() else 0))
        raise AssertionError("not reached")

    def _list(self, kind: str, filters: str) -> Iterator[dict]:
        get, cursor = self._get, "*"
        while cursor:
            answer = get(f"{self.endpoint}/{kind}?{urlencode({'filter': filters, 'per-page': self.page, 'cursor': cursor})}")
            yield from answer["results"]
            cursor = answer["meta"].get("next_cursor") if answer["results"] else None

    @staticmethod
    def _filter(year: int, subfield: str, status: str, topic: str | None) -> str:
        place = f"primary_topic.id:{topic}" if topic else f"primary_topic.subfield.id:{subfield}"
        return f"has_abstract:true,{place},publication_year:{year},open_access.oa_status:{status}"

    def _count(self, filters: str) -> int:
        return self._get(f"{self.endpoint}/works?{urlencode({'filter': filters, 'per-page': 1})}")["meta"]["count"]

    def partitions(self) -> list[Shard]:
        subfields = self.wanted["subfield"]
        if subfields is None:
            subfields = {s["id"].rsplit("/", 1)[-1] for s in self._list("subfields", f"domain.id:{self.domain}")}
        topics: dict[str, list[str]] = {}
        out = []
        for year in sorted(self.wanted["year"], reverse=True):
            for subfield in sorted(subfields):
                for status in sorted(self.wanted["oa_status"]):
                    n = self._count(self._filter(year, subfield, status, None))
                    if n > self.split_at:
                        if subfield not in topics:
                            topics[subfield] = [t["id"].rsplit("/", 1)[-1] for t in self._list("topics", f"subfield.id:{subfield}")]
                        for topic in topics[subfield]:
                            m = self._count(self._filter(year, subfield, status, topic))
                            if m:
                                out.append(Shard(year, subfield, status, topic, m))
                    elif n:
                        out.append(Shard(year, subfield, status, None, n))
        return out

    def read(self, shard: Shard | None) -> Iterator[tuple]:
        if shard is None:  # no partitions
            return
        for record in self._list("works", self._filter(shard.year, shard.subfield, shard.status, shard.topic)):
            yield shard.year, shard.subfield, shard.status, shard.topic, json.dumps(record)
