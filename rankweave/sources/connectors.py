"""Connectors to web services: a contract, a registry, paging and page-to-record functions.

A connector fetches through an injected function fetch(path, params) -> dict, so paging and parsing
run without a network. `register` makes it a Spark data source: spark.read.format("connector").
"""

from __future__ import annotations

import json
import os
import random
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .relational import identifier

Fetch = Callable[[str, dict], dict]
SCHEMA = "stream string, id string, content string, mime_type string, url string, metadata map<string,string>, action string, emitted_at string"


@dataclass
class Record:
    stream: str
    id: str
    content: str = ""
    url: str = ""
    mime_type: str = "text/plain"
    metadata: dict[str, str] = field(default_factory=dict)
    action: str = "upsert"
    emitted_at: str = ""


class Connector(ABC):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch
        #: Where the next run begins, by stream, if the service names it itself; set when a read has come to its end.
        self.cursors: dict[str, str] = {}

    @classmethod
    def spec(cls) -> dict:
        """What the connector needs, and what its records look like."""
        return {"required": list(cls.required()), "schema": SCHEMA}

    def discover(self) -> list[dict]:
        return [{"stream": s, "schema": SCHEMA, "modes": ["full_refresh", "incremental"]} for s in self.streams()]

    def close(self) -> None:
        """Give back what the connector holds; nothing by default."""

    def validate(self) -> None:
        missing = [k for k in self.required() if not self.options.get(k)]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")

    @classmethod
    def required(cls) -> tuple[str, ...]:
        return ()

    @abstractmethod
    def streams(self) -> list[str]: ...

    @abstractmethod
    def read(self, stream: str, cursor: str | None) -> Iterator[Record]: ...


REGISTRY: dict[str, type[Connector]] = {}


def connector(name: str):
    def add(cls):
        REGISTRY[name] = cls
        return cls

    return add


def load_plugins(group: str = "rankweave.connectors") -> None:
    for point in entry_points(group=group):
        REGISTRY.setdefault(point.name, point.load())


def with_retry(call: Callable[[], tuple[int, dict]], attempts: int = 4, base: float = 0.5, refresh: Callable[[], None] | None = None, sleep=time.sleep) -> dict:
    """Repeat on 429, 5xx and, after a refresh of the login, 401 and 403; waits grow as powers of two with jitter."""
    for n in range(1, attempts + 1):
        status, body = call()
        if status < 400:
            return body
        if n == attempts or not (status in (401, 403, 429) or status >= 500):
            raise OSError(f"request failed with status {status}")
        if status in (401, 403) and refresh:
            refresh()
        sleep(base * 2 ** (n - 1) + random.uniform(0, base))
    raise OSError("no attempt was made")


def cursor_pages(fetch: Callable[[str | None], dict], items: str, following: Callable[[dict], str | None]) -> Iterator[dict]:
    at: str | None = None
    while True:
        page = fetch(at)
        yield from page.get(items) or []
        at = following(page)
        if not at:
            return


def offset_pages(fetch: Callable[[int], dict], items: str, size: int) -> Iterator[dict]:
    start = 0
    while True:
        found = fetch(start).get(items) or []
        yield from found
        start += len(found)
        if len(found) < size:
            return


@connector("confluence")
class Confluence(Connector):
    @classmethod
    def required(cls):
        return ("base_url",)

    def streams(self):
        return ["pages", "blogposts"]

    def read(self, stream, cursor):
        spaces = [s for s in str(self.options.get("spaces", "")).split(",") if s] or [None]
        for space in spaces:
            params = {"space-id": space} if space else {}
            pages = cursor_pages(lambda at, p=params: self.fetch(f"/api/v2/{stream}", p | ({"cursor": at} if at else {})), "results", lambda page: (page.get("_links") or {}).get("next"))
            for p in pages:
                made = p.get("createdAt") or ""
                if cursor and made <= cursor:
                    continue
                body = ((p.get("body") or {}).get("storage") or {}).get("value", "")
                yield Record(stream, str(p["id"]), f"<h1>{p['title']}</h1>{body}", f"{self.options['base_url']}{(p.get('_links') or {}).get('webui', '')}", "text/html", {"title": p["title"]}, emitted_at=made)


def document_text(node) -> str:
    """Plain text of a rich-text tree of Jira."""
    if isinstance(node, str):
        return node
    if not isinstance(node, dict):
        return ""
    inner = "".join(document_text(c) for c in node.get("content") or [])
    return node.get("text", "") + inner + ("\n" if node.get("type") in ("paragraph", "heading", "listItem", "codeBlock") else "")


@connector("jira")
class Jira(Connector):
    @classmethod
    def required(cls):
        return ("base_url", "project")

    def streams(self):
        return ["issues"]

    def query(self, cursor):
        where = [f'project = "{self.options["project"]}"'] + ([f'updated > "{cursor}"'] if cursor else [])
        return " AND ".join(where) + " ORDER BY updated ASC"

    def read(self, stream, cursor):
        size = int(self.options.get("page_size", 50))
        for issue in offset_pages(lambda at: self.fetch("/rest/api/3/search", {"jql": self.query(cursor), "startAt": at, "maxResults": size}), "issues", size):
            f = issue["fields"]
            comments = [document_text(c.get("body")).strip() for c in (f.get("comment") or {}).get("comments") or []]
            content = "\n\n".join(filter(None, [f"# {f['summary']}", document_text(f.get("description")).strip(), *comments]))
            yield Record(stream, issue["key"], content, f"{self.options['base_url']}/browse/{issue['key']}", "text/markdown", {"status": (f.get("status") or {}).get("name", "")}, emitted_at=f["updated"])


@connector("drive")
class Drive(Connector):
    """Full list without a cursor, else the change list; removals become deletes. The token of the next run is
    asked for before the first list and comes with the last page of changes."""

    def streams(self):
        return ["files"]

    def read(self, stream, cursor):
        if cursor:
            token = cursor

            def following(page):
                nonlocal token
                token = page.get("newStartPageToken") or token
                return page.get("nextPageToken")

            for c in cursor_pages(lambda at: self.fetch("/changes", {"pageToken": at or cursor}), "changes", following):
                if c.get("removed") or (c.get("file") or {}).get("trashed"):
                    yield Record(stream, c["fileId"], action="delete", emitted_at=c.get("time", ""))
                else:
                    yield self._record(stream, c["file"])
            self.cursors[stream] = token
            return
        token = self.fetch("/changes/startPageToken", {})["startPageToken"]
        for f in cursor_pages(lambda at: self.fetch("/files", {"pageToken": at} if at else {}), "files", lambda p: p.get("nextPageToken")):
            yield self._record(stream, f)
        self.cursors[stream] = token

    def _record(self, stream, f):
        export = f["mimeType"].startswith("application/vnd.google-apps")
        body = self.fetch(f"/files/{f['id']}" + ("/export" if export else ""), {"mimeType": "text/plain"} if export else {"alt": "media"})
        return Record(stream, f["id"], body.get("text", ""), f.get("webViewLink", ""), "text/plain" if export else f["mimeType"], {"name": f.get("name", "")}, emitted_at=f.get("modifiedTime", ""))


@connector("salesforce")
class Salesforce(Connector):
    @classmethod
    def required(cls):
        return ("base_url", "object", "fields")

    def streams(self):
        return [self.options["object"]]

    def query(self, cursor):
        fields = [identifier(f.strip(), True) for f in self.options["fields"].split(",")]
        names = list(dict.fromkeys(["Id", *fields, "SystemModstamp"]))
        where = f" WHERE SystemModstamp > {cursor}" if cursor else ""
        return f"SELECT {', '.join(names)} FROM {identifier(self.options['object'], True)}{where} ORDER BY SystemModstamp ASC"

    def read(self, stream, cursor):
        pages = cursor_pages(lambda at: self.fetch(at or "/services/data/query", {} if at else {"q": self.query(cursor)}), "records", lambda p: p.get("nextRecordsUrl"))
        for r in pages:
            text = "\n".join(f"{k}: {v}" for k, v in r.items() if v not in (None, "") and k not in ("attributes", "Id", "SystemModstamp"))
            yield Record(stream, r["Id"], text, f"{self.options['base_url']}/{r['Id']}", emitted_at=r["SystemModstamp"])


@connector("sharepoint")
class SharePoint(Connector):
    def streams(self):
        return [d for d in str(self.options.get("drives", "")).split(",") if d]

    def read(self, stream, cursor):
        link = cursor

        def following(page):
            nonlocal link
            link = page.get("@odata.deltaLink") or link
            return page.get("@odata.nextLink")

        for item in cursor_pages(lambda at: self.fetch(at or cursor or f"/drives/{stream}/root/delta", {}), "value", following):
            if "deleted" in item:
                yield Record(stream, item["id"], action="delete")
            elif "file" in item:
                body = self.fetch(f"/drives/{stream}/items/{item['id']}/content", {})
                yield Record(stream, item["id"], body.get("text", ""), item.get("webUrl", ""), item["file"].get("mimeType", ""), {"name": item.get("name", "")}, emitted_at=item.get("lastModifiedDateTime", ""))
        if link:
            self.cursors[stream] = link


@connector("slack")
class Slack(Connector):
    SKIP = ("channel_join", "channel_leave")

    def streams(self):
        return [c for c in str(self.options.get("channels", "")).split(",") if c]

    def read(self, stream, cursor):
        following = lambda p: (p.get("response_metadata") or {}).get("next_cursor")
        for m in cursor_pages(lambda at: self.fetch("/conversations.history", {"channel": stream, "oldest": cursor or "0"} | ({"cursor": at} if at else {})), "messages", following):
            if m.get("subtype") in self.SKIP or (cursor and m["ts"] == cursor):
                continue
            texts = [m.get("text", "")]
            if m.get("reply_count"):
                replies = cursor_pages(lambda at, ts=m["ts"]: self.fetch("/conversations.replies", {"channel": stream, "ts": ts} | ({"cursor": at} if at else {})), "messages", following)
                texts += [r.get("text", "") for r in replies if r["ts"] != m["ts"]]
            yield Record(stream, f"{stream}-{m['ts']}", "\n---\n".join(filter(None, texts)), metadata={"user": m.get("user", "")}, emitted_at=m["ts"])


@connector("twitter")
class Twitter(Connector):
    # Where each kind of stream is read.
    KINDS = {"users": ("timeline", "/users/{}/tweets"), "searches": ("search", "/tweets/search/recent"), "lists": ("list", "/lists/{}/tweets")}

    def streams(self):
        return [f"{kind}:{s}" for option, (kind, _) in self.KINDS.items() for s in str(self.options.get(option, "")).split(",") if s]

    def read(self, stream, cursor):
        kind, _, name = stream.partition(":")
        path = next(p for k, p in self.KINDS.values() if k == kind)
        params = ({"query": name} if kind == "search" else {}) | ({"since_id": cursor} if cursor else {})
        for t in cursor_pages(lambda at: self.fetch(path.format(name), params | ({"pagination_token": at} if at else {})), "data", lambda p: (p.get("meta") or {}).get("next_token")):
            yield Record(stream, t["id"], t["text"], f"https://twitter.com/i/status/{t['id']}", emitted_at=t["id"])


def next_cursor(records: Iterable[Record], before: str | None, numeric: bool = False) -> str | None:
    key = (lambda c: int(c)) if numeric else (lambda c: c)
    return max([c for c in [before, *(r.emitted_at for r in records)] if c], key=key, default=before)


def sync(source: Connector, stream: str, state: dict, sink: Callable[[list[Record]], None], mode: str = "incremental", collection: str | None = None, batch: int = 500) -> int:
    """Validate, read, sink in batches, then save the cursor: only after all of it went well."""
    source.validate()
    cursor = state.get(stream) if mode == "incremental" else None
    held, n, latest = [], 0, cursor
    for r in source.read(stream, cursor):
        if collection:
            r.metadata["_collection_id"] = collection
        held.append(r)
        n += 1
        if len(held) >= batch:
            latest = next_cursor(held, latest, isinstance(source, Twitter))
            sink(held)
            held = []
    if held:
        latest = next_cursor(held, latest, isinstance(source, Twitter))
        sink(held)
    state[stream] = source.cursors.get(stream, latest)  # the service's own cursor, where it names one
    return n


class Jobs:
    """Sync jobs with their state in one JSON file: cursors by stream, status, last run and error. A job is due
    when its interval has passed; one without an interval runs once."""

    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.path, self.clock = path, clock
        try:
            with open(path) as f:
                self.state = json.load(f)
        except FileNotFoundError:
            self.state = {}

    def _store(self) -> None:
        with open(f"{self.path}.new", "w") as f:
            json.dump(self.state, f, sort_keys=True)
        os.replace(f"{self.path}.new", self.path)

    def due(self, name: str, interval: float | None = None) -> bool:
        last = self.state.get(name, {}).get("at")
        return last is None or (interval is not None and self.clock() - last >= interval)

    def run(self, name: str, source: Connector, sink: Callable[[list[Record]], None], mode: str = "incremental", collection: str | None = None) -> int:
        """All streams of a source. A stream's cursor is stored once all of it went well; a failure ends the run
        and leaves the cursors of the streams before it."""
        job = self.state.setdefault(name, {"cursors": {}})
        job |= {"status": "running", "at": self.clock(), "error": None}
        self._store()
        n = 0
        try:
            for stream in source.streams():
                n += sync(source, stream, job["cursors"], sink, mode, collection)
                self._store()
            job["status"] = "done"
        except Exception as e:
            job |= {"status": "failed", "error": str(e)}
            raise
        finally:
            source.close()
            self._store()
        return n


class Pacer:
    """At most `rate` calls a second."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1.0 / rate, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


@dataclass
class _Stream(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _connector(self) -> Connector:
        kind = REGISTRY[self.options["kind"]]
        if "pages" in self.options:  # recorded answers: {path: [page, ...]}
            pages = {k: iter(v) for k, v in json.loads(self.options["pages"]).items()}
            return kind(dict(self.options), lambda path, params: next(pages[path]))
        return kind(dict(self.options), _http(self.options))

    def partitions(self):
        return [_Stream(s) for s in self._connector().streams()]

    def read(self, partition):
        for r in self._connector().read(partition.name, self.options.get("cursor")):
            yield (r.stream, r.id, r.content, r.mime_type, r.url, r.metadata, r.action, r.emitted_at)


def _http(options: dict) -> Fetch:
    import urllib.error
    import urllib.parse
    import urllib.request

    pace = Pacer(float(options.get("requests_per_second", 10)))
    login = {"token": options.get("token")}

    def call(path: str, params: dict) -> tuple[int, dict]:
        pace.wait()
        url = path if path.startswith("http") else options["base_url"] + path
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params) if params else ""
        head = {"Authorization": f"Bearer {login['token']}"} if login["token"] else {}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=30) as answer:
                body = answer.read().decode("utf-8", "replace")
                return answer.status, json.loads(body) if body.lstrip()[:1] == "{" else {"text": body}
        except urllib.error.HTTPError as e:
            return e.code, {}

    def refresh() -> None:
        """A new token by client credentials, where the options name where to ask."""
        if options.get("token_url"):
            form = {"grant_type": "client_credentials", "client_id": options["client_id"], "client_secret": options["client_secret"]}
            with urllib.request.urlopen(urllib.request.Request(options["token_url"], urllib.parse.urlencode(form).encode()), timeout=30) as answer:
                login["token"] = json.loads(answer.read())["access_token"]

    return lambda path, params: with_retry(lambda: call(path, params), refresh=refresh)


class ConnectorSource(DataSource):
    @classmethod
    def name(cls):
        return "connector"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConnectorSource)
