"""RSS and Atom feeds as a Spark data source: ``spark.read.format("feeds").option("paths", ...)``.

One partition per feed, so a feed that fails costs its own rows alone; it yields one row
with the error instead. Paths are http(s) addresses, or files or folders of any store. With
``seen`` (a JSON object of path to validator) a feed whose content has not changed yields
nothing.

``spark.readStream.format("feeds")`` is the collector: each batch asks the next
``feedsPerBatch`` feeds, ``AT_ONCE`` of them at a time, on condition that they changed. Its
offsets hold what every feed last answered with (ETag and Last-Modified, or a digest where
a feed has neither), so a server's 304, or the same content again, makes no rows, and a
poll without news makes no batch. A feed that fails gives one row with the error and keeps
the validators of its last good answer. A batch that is run again asks on its old
conditions: it may see newer entries, which the next batch tells too, but loses none.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "feed string, external_id string, url string, title string, body string, published timestamp, validator string, error string"
#: A date without a zone is Indian time.
LOCAL = timezone(timedelta(hours=5, minutes=30))


def entry_date(text: str | None) -> datetime | None:
    """RFC 822 or ISO dates; without a zone they are Indian time; null if neither."""
    if not text or not text.strip():
        return None
    for parse in (parsedate_to_datetime, lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))):
        try:
            at = parse(text.strip())
            return at if at.tzinfo else at.replace(tzinfo=LOCAL)
        except (ValueError, TypeError):
            continue
    return None


def entries(feed: str, raw: bytes):
    """The rows of one feed document, RSS items or Atom entries."""
    name = lambda e: e.tag.rpartition("}")[2]
    validator = hashlib.sha1(raw).hexdigest()
    for item in (e for e in ET.fromstring(raw).iter() if name(e) in ("item", "entry")):
        field = {}
        for child in item:
            value = child.get("href") if name(child) == "link" and child.get("href") else (child.text or "").strip()
            field.setdefault(name(child), value)
        url = field.get("link", "")
        body = field.get("description") or field.get("summary") or field.get("content") or ""
        at = entry_date(field.get("pubDate") or field.get("published") or field.get("updated"))
        yield feed, field.get("guid") or field.get("id") or url, url, field.get("title", ""), body, at, validator, None


def _told(feed: str, raw: bytes):
    """``entries``, or one row with what was wrong."""
    try:
        yield from list(entries(feed, raw))
    except Exception as e:  # noqa: BLE001 - one feed's failure is a row, not the job's end
        yield feed, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


def parsed(feeds: DataFrame) -> DataFrame:
    """The entries of feed documents that are rows already: (feed, content)."""

    def run(batches):
        for pdf in batches:
            rows = [r for feed, content in zip(pdf["feed"], pdf["content"], strict=True) for r in _told(feed, (content or "").encode())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return feeds.select("feed", "content").mapInPandas(run, SCHEMA)


class FeedPartition(InputPartition):
    def __init__(self, path: str, seen: str | None):
        self.path, self.seen = path, seen


AT_ONCE = 8
#: A validator's header in the answer, and the header that makes a request depend on it.
CONDITIONS = {"ETag": "If-None-Match", "Last-Modified": "If-Modified-Since"}


def fetched(path: str, seen: dict | None = None, timeout: float = 30) -> tuple[bytes | None, dict]:
    """(content, validators) of a feed; no content if it is as it was when it had ``seen``."""
    seen = seen or {}
    if path.startswith(("http://", "https://")):
        asked = urllib.request.Request(path, headers={ask: seen[tell] for tell, ask in CONDITIONS.items() if seen.get(tell)})  # noqa: S310 - the caller names the feeds
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:  # noqa: S310
                raw = answer.read()
                now = {name: answer.headers[name] for name in CONDITIONS if answer.headers[name]}
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return None, seen
            raise
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        found = store.get_file_info(at)
        inside = store.get_file_info(fs.FileSelector(at)) if found.type == fs.FileType.Directory else [found]
        raw = b"".join(store.open_input_stream(f.path).read() for f in sorted(inside, key=lambda f: f.path) if not f.base_name.startswith(("_", ".")))
        now = {}
    if not now:  # nothing to ask by: tell by the content
        now = {"digest": hashlib.sha1(raw).hexdigest()}
        if now == seen:
            return None, seen
    return raw, now


def _wrong(path: str, e: Exception) -> tuple:
    return path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.seen = json.loads(options.get("seen", "{}"))

    def partitions(self):
        return [FeedPartition(p, self.seen.get(p)) for p in self.paths]

    def read(self, partition):
        try:
            raw, _ = fetched(partition.path)
        except Exception as e:  # noqa: BLE001 - one feed's failure is a row, not the job's end
            yield _wrong(partition.path, e)
            return
        if hashlib.sha1(raw).hexdigest() != partition.seen:
            yield from _told(partition.path, raw)


class FeedCollector(SimpleDataSourceStreamReader):
    """Offsets: ``seen`` (feed to validators), ``next`` (the feed to ask first), ``told`` (polls with rows)."""

    def __init__(self, options):
        self.paths = sorted({p for p in options.get("paths", "").split(",") if p})
        self.per_batch = int(options.get("feedsPerBatch", "64"))
        self.timeout = float(options.get("timeout", "30"))

    def initialOffset(self):
        return {"seen": {}, "next": 0, "told": 0}

    def _ask(self, path, seen):
        try:
            raw, now = fetched(path, seen, self.timeout)
            rows = [] if raw is None else list(_told(path, raw))
            # what can't be parsed is asked for again
            return rows, seen if any(r[-1] for r in rows) else now
        except Exception as e:  # noqa: BLE001 - one feed's failure is a row, not the job's end
            return [_wrong(path, e)], seen

    def read(self, start):
        n = min(self.per_batch, len(self.paths))
        asked = [self.paths[(start["next"] + i) % len(self.paths)] for i in range(n)]
        with ThreadPoolExecutor(AT_ONCE) as pool:
            answers = list(pool.map(lambda p: self._ask(p, start["seen"].get(p, {})), asked))
        seen = start["seen"] | {p: now for p, (_, now) in zip(asked, answers, strict=True) if now}
        rows = [r for some, _ in answers for r in some]
        after = (start["next"] + n) % max(1, len(self.paths)) if n < len(self.paths) else 0
        return iter(rows), {"seen": seen, "next": after, "told": start["told"] + bool(rows)}

    def readBetweenOffsets(self, start, end):
        return self.read(start)[0]


class FeedSource(DataSource):
    @classmethod
    def name(cls):
        return "feeds"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FeedReader(self.options)

    def simpleStreamReader(self, schema):
        return FeedCollector(self.options)
