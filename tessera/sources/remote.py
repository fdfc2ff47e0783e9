"""Search servers as a data source: one task asks one server, and whatever keeps it from answering is a row with a status.

The protocol is JSON over HTTP: POST /search with query, limit and, where given, path_prefix and exts, under a bearer token; the answer is {"hits": [...]}.
"""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessera.functions.paths import extension, in_scope, is_mail_path, normalize_extensions
from tessera.operators.federation import remote_limit

FORMAT = "search_servers"
LEAST_TIMEOUT_MS, TIMEOUT_MS = 500, 3000
#: An answer of at most 50 hits with their texts is far smaller; more is not read.
MOST_BYTES = 64 << 20
SCHEMA = (
    "server string, status string, error string, id string, path string, title string, snippet string, doc_kind string, score double, match_count long, ext string, "
    "paragraphs array<struct<nth: int, id: string, label: string, snippet: string, score: double>>"
)


class Server(InputPartition):
    """A server to ask."""

    def __init__(self, url: str):
        self.url = url


def _extension(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    at = name.rfind(".")
    return name[at + 1 :].lower() if 0 < at < len(name) - 1 else ""


def ask(url: str, token: str, body: dict, timeout_ms: int) -> dict:
    """The answer to one request."""
    head = {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}
    request = urllib.request.Request(url, json.dumps(body).encode(), head, method="POST")
    with urllib.request.urlopen(request, timeout=max(LEAST_TIMEOUT_MS, timeout_ms) / 1000) as answer:
        raw = answer.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError("the answer is too large")
    return json.loads(raw)


def failure(why: Exception) -> str:
    """What a request's failure is called: unauthorized, http NNN, timeout, unreachable or malformed."""
    if isinstance(why, urllib.error.HTTPError):
        return "unauthorized" if why.code == 401 else f"http {why.code}"
    if isinstance(why, TimeoutError) or isinstance(getattr(why, "reason", None), (TimeoutError, socket.timeout)):
        return "timeout"
    return "unreachable" if isinstance(why, OSError) else "malformed"


class ServerReader(DataSourceReader):
    """Asks each server once. A filter on `ext` goes along with the request, and Spark applies it again, as servers may not know it."""

    def __init__(self, options: dict[str, str]):
        self.servers = list(dict.fromkeys(u.strip().rstrip("/") for u in options.get("urls", "").split(",") if u.strip()))
        self.token, self.query = options.get("token", "").strip(), options.get("query", "")
        if not self.servers or not self.token:
            raise ValueError("urls and token are needed")
        self.limit, self.timeout_ms = int(options.get("limit", 10)), int(options.get("timeout_ms", TIMEOUT_MS))
        self.scope, self.exts = options.get("scope", "").strip(), normalize_extensions(options.get("exts", "").split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ext",):
                named = list(f.value) if isinstance(f, In) else [f.value]
                if all(isinstance(e, str) and e for e in named):  # an empty extension cannot be asked for
                    self.exts = [e for e in self.exts if e in named] if self.exts else named
            yield f

    def partitions(self) -> list[Server]:
        return [Server(u) for u in self.servers]

    def read(self, partition: Server) -> Iterator[tuple]:
        url = partition.url
        body = {"query": self.query, "limit": self.limit} | ({"path_prefix": self.scope} if self.scope else {}) | ({"exts": self.exts} if self.exts else {})
        try:
            rows = [self._row(url, h) for h in ask(f"{url}/search", self.token, body, self.timeout_ms)["hits"][: self.limit]]
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as why:  # no connection, or no answer of this form
            yield (url, failure(why), str(why)[:500], *[None] * 9)
            return
        yield from rows or [(url, "answered", None, *[None] * 9)]

    @staticmethod
    def _row(url: str, h: dict) -> tuple:
        path, score = str(h["path"]), float(h["score"])
        parts = [(i, str(p.get("id", "")), p.get("label") or p.get("unit_label") or "", p.get("snippet") or "", float(p.get("score", score))) for i, p in enumerate(h.get("paragraphs") or [], 1)]
        kind = h.get("doc_kind") or "file"
        return url, "answered", None, str(h["id"]), path, h.get("title") or "", h.get("snippet") or "", kind, score, int(h.get("match_count") or 0), _extension(path), parts


class SearchServers(DataSource):
    """spark.read.format("search_servers") with the options urls (by commas), token, query, limit, scope, exts (by commas) and timeout_ms (at least 500).

    A row per hit; a server without one has a row with its status and else nulls.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ServerReader:
        return ServerReader(dict(self.options))


class NoServerAnswered(ConnectionError):
    """All servers of a remote side failed."""


@dataclass
class RemoteServers:
    """Servers that together are a remote side of a search."""

    spark: SparkSession
    urls: list[str]
    token: str
    timeout_ms: int = TIMEOUT_MS

    def asked(self, query: str, limit: int, scope: str | None = None, exts: list[str] | None = None) -> DataFrame:
        """All rows of all servers for a query, failures included. Under a scope or extensions four times as many hits, at most 50, are asked for. Mail is left out, and so are hits outside of the scope or of other
        types, which servers that do not know these give too."""
        kinds = normalize_extensions(exts or [])
        self.spark.dataSource.register(SearchServers)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        options = {"urls": ",".join(self.urls), "token": self.token, "query": query, "limit": remote_limit(limit, bool(scope or kinds)), "timeout_ms": self.timeout_ms, "scope": scope or "", "exts": ",".join(kinds)}
        rows = self.spark.read.format(FORMAT).options(**options).load()
        inside = (F.col("doc_kind") != "email") & ~is_mail_path(F.col("path"))
        if scope:
            inside &= in_scope(F.col("path"), scope)
        if kinds:
            inside &= extension(F.col("path")).isin(kinds)
        return rows.where(F.col("path").isNull() | inside)

    def hits(self, query: str, limit: int, scope: str | None = None, exts: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        """The best hits of the servers that answer, and each server's status. Servers are asked once: their answers, at most 50 hits each, pass through the driver. Raises NoServerAnswered."""
        rows = self.asked(query, limit, scope, exts)
        kept = self.spark.createDataFrame(rows.collect(), rows.schema)
        status = {u: "answered" for u in (x.strip().rstrip("/") for x in self.urls) if u} | {r["server"]: r["status"] for r in kept.where("status != 'answered'").select("server", "status").collect()}
        if all(s != "answered" for s in status.values()):
            raise NoServerAnswered(", ".join(f"{u}: {s}" for u, s in status.items()))
        return kept.where("path is not null").orderBy(F.desc("score"), "path", "server").limit(limit), status
