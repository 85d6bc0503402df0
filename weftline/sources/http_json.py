"""Paged JSON over HTTP as a Spark data source: records at a JSON Pointer, by page, offset or cursor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.files import strict_json


def pointer(value: object, path: str) -> object:
    """The value at a JSON Pointer; a missing step is an error."""
    for part in path.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        value = value[int(name)] if isinstance(value, list) else value[name]
    return value


def pages(fetch: Callable[[str], str], url: str, records: str, mode: str = "page", size: int = 100, cursor: str = "", most_pages: int = 1000) -> Iterator[dict]:
    """Records page by page; an empty page or a blank cursor ends, a cursor that comes again or too many pages fail."""
    seen: set[str] = set()
    token = ""
    for n in range(most_pages):
        asked = {"page": {"page": n + 1, "size": size}, "offset": {"offset": n * size, "limit": size}, "cursor": {"cursor": token, "size": size} if token else {"size": size}}[mode]
        body = strict_json(fetch(f"{url}{'&' if '?' in url else '?'}{urlencode(asked)}"))
        found = pointer(body, records) if records else body
        if not found:
            return
        yield from found
        if mode == "cursor":
            token = str(pointer(body, cursor) or "")
            if not token.strip():
                return
            if token in seen:
                raise ValueError("a cursor came again")
            seen.add(token)
    raise ValueError("more pages than allowed")


def fetch_https(url: str) -> str:
    from urllib.request import urlopen

    if not url.startswith("https://"):
        raise ValueError("https only")
    with urlopen(url, timeout=30) as reply:
        return reply.read().decode("utf-8")


class HttpJson(DataSource):
    """spark.read.format("weftline_http_json").option("url", ...).option("records", "/items").load(): record_number, record (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "weftline_http_json"

    def schema(self) -> str:
        return "record_number long, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["url"].split()]

    def read(self, partition: InputPartition):
        o = self.options
        found = pages(fetch_https, partition.value, o.get("records", ""), o.get("mode", "page"), int(o.get("size", 100)), o.get("cursor", ""), int(o.get("most_pages", 1000)))
        for n, record in enumerate(found, 1):
            yield n, json.dumps(record, ensure_ascii=False)
