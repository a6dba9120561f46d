"""A cursor-paged API as a Python data source: a partition per topic, pages until the end, a limit or a time bound.

The transport is injected as ``client(topic, cursor) -> (items, next_cursor, has_next)``, an importable "module:function".
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES = 100


class NotThere(Exception):
    """The page does not exist (404): no second try."""


class TooMany(Exception):
    """Too many requests (429): the next try waits ``PAUSE`` seconds."""


PAUSE = 30.0


def fetch(client: Callable, topic: str, cursor: str | None, tries: int = 3, delay: float = 0.0, pause: float = PAUSE):
    """One page, tried up to ``tries`` times with growing delays; a page that is not there is not tried again."""
    for k in range(tries):
        try:
            return client(topic, cursor)
        except NotThere:
            raise
        except Exception as e:
            if k + 1 == tries:
                raise
            time.sleep(pause if isinstance(e, TooMany) else delay * 2**k)


class _Topic(InputPartition):
    def __init__(self, topic: str):
        super().__init__(topic)
        self.topic = topic


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.topics = [t.strip() for t in options.get("topics", "").split(",") if t.strip()]
        self.client = options["client"]
        self.limit = int(options.get("limit", 1 << 60))
        self.since = options.get("since")
        self.pages = int(options.get("pages", MAX_PAGES))
        self.cursors = json.loads(options.get("cursors", "{}"))

    def partitions(self):
        return [_Topic(t) for t in self.topics]

    def read(self, partition) -> Iterator[tuple]:
        module, name = self.client.split(":")
        client = getattr(importlib.import_module(module), name)
        cursor, sent = self.cursors.get(partition.topic), 0
        for _ in range(self.pages):
            items, cursor, more = fetch(client, partition.topic, cursor)
            for item in items:
                # Pages run from new to old: the first older item ends the scan.
                if self.since and str(item.get("inserted", "")) < self.since:
                    return
                yield partition.topic, cursor, json.dumps(item, ensure_ascii=False)
                sent += 1
                if sent >= self.limit:
                    return
            if not more:
                return
        # Pages are left: a row without a value says where the next scan has to go on.
        yield partition.topic, cursor, None


class PagedSource(DataSource):
    """format("tidewire_paged").option("topics", "A,B").option("client", "module:function")[.option("limit")][.option("since")]
    [.option("pages", most pages a topic)][.option("cursors", JSON of topics to the cursors to resume at)]; a topic with pages left
    ends with a row of a null value and the cursor to resume at."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_paged"

    def schema(self) -> str:
        return "topic string, cursor string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
