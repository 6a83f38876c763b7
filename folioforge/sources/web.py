"""Web pages as a data source: spark.read.format("web_pages").option("urls", json of addresses).load()."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .readers import FetchConfig, fetched, html_text

#: Partitions at most; hosts are dealt to them by hash.
PARTITIONS = 200


def host_of(url: str) -> str:
    """Name and port, in lower case."""
    return urlsplit(url if "://" in url else f"https://{url}").netloc.rpartition("@")[2].lower()


@dataclass
class Hosts(InputPartition):
    """Addresses of some hosts, each host's together and in their order."""

    urls: list[str]


class PageSource(DataSource):
    """url, status, content_type, html, text of pages, null status for those that could not be fetched.

    Options: urls, a JSON array of addresses; pause, seconds between two requests to a host; timeout, retries, backoff,
    user_agent as in FetchConfig; partitions. All addresses of a host are in one partition and are asked for one after the other, so
    no host has two requests at a time. A schema with fewer columns makes rows of those alone: without text, pages are not parsed.
    Cases: blank addresses are left out, repeated ones are fetched once; no address gives no row; text is null for what is no HTML.
    """

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return "url string, status int, content_type string, html string, text string"

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(schema.names, dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, names: list[str], options: dict[str, str]):
        unknown = set(names) - {"url", "status", "content_type", "html", "text"}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.names, given = names, {k.lower(): v for k, v in options.items()}
        self.urls = [u.strip() for u in json.loads(given.get("urls", "[]")) if u and u.strip()]
        self.pause, self.many = float(given.get("pause", 1.0)), int(given.get("partitions", PARTITIONS))
        self.config = FetchConfig(float(given.get("timeout", 20)), int(given.get("retries", 2)), float(given.get("backoff", 1.2)), given.get("user_agent", FetchConfig.user_agent))

    def partitions(self) -> list[Hosts]:
        by_host: dict[str, list[str]] = {}
        for u in dict.fromkeys(u if u.startswith(("http://", "https://")) else f"https://{u}" for u in self.urls):
            by_host.setdefault(host_of(u), []).append(u.partition("#")[0])
        many = max(1, min(self.many, len(by_host)))
        # A few hosts have a partition each; many are dealt by hash.
        place = (lambda k, host: k) if len(by_host) <= many else (lambda k, host: int(hashlib.md5(host.encode()).hexdigest(), 16) % many)
        parts: list[list[str]] = [[] for _ in range(many)]
        for k, (host, urls) in enumerate(sorted(by_host.items())):
            parts[place(k, host)] += dict.fromkeys(urls)
        return [Hosts(p) for p in parts if p] or [Hosts([])]

    def read(self, partition: Hosts) -> Iterator[tuple]:
        last: tuple[str, float] = ("", 0.0)
        for url in partition.urls:
            host = host_of(url)
            if host == last[0]:
                time.sleep(max(0.0, last[1] + self.pause - time.monotonic()))
            status, kind, html = fetched(url, self.config)
            last = (host, time.monotonic())
            row = {"url": url, "status": status, "content_type": kind, "html": html}
            if "text" in self.names:
                row["text"] = html_text(html) if status is not None and "html" in kind.lower() else None
            yield tuple(row[n] for n in self.names)


def web_pages(spark: SparkSession, urls: list[str], schema: str | None = None, **options) -> DataFrame:
    """Pages of a list of addresses by the data source, which is registered with the session."""
    spark.dataSource.register(PageSource)
    reader = spark.read.format(PageSource.name()).options(urls=json.dumps(urls), **{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load()
