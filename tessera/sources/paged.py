"""A source over a paged REST interface, in batches and as a stream, as a Python data source."""

from __future__ import annotations

import glob
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def fetch(url: str) -> dict:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return json.loads(answer.read())


class PagedStudies(DataSource):
    """Format "paged_studies": rows (query string, page int, study string), pages followed by their tokens.

    Options: url, query (several joined by `;`), status, page_size, sleep, mode ("permissive": a failing page ends
    the scan of its query and keeps what was read; "failfast": it raises), pages_per_batch (streams only: pages of a
    query in a run's first batch; while a batch is full, the next takes twice as many, up to `max_pages_per_batch`).
    url may be a folder of pages that driver and executors see (a path or file://), named page-N.json or, for each query, query=Q/page=N/part-*.

    As a batch, a query is a partition, since only a page tells where the next one is. As a stream, the driver walks the
    tokens, asking for as little of each page as the interface gives, and a partition is a run of pages of one query; the offset holds each
    query's next page and token, so a restarted stream goes on at the page at which it stopped. A page that fails ends
    the batch before it: in permissive mode it is tried again with the next batch, in failfast mode the stream fails there.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_studies"

    def schema(self) -> str:
        return "query string, page int, study string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(Pages(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(Pages(dict(self.options)))


class Pages:
    """The pages of an interface by query, number and token."""

    def __init__(self, options: dict):
        self.options = options
        self.strict = options.get("mode", "permissive") == "failfast"
        self.queries = [q.strip() for q in options.get("query", "").split(";")]
        self.sleep = float(options.get("sleep", "0.3"))

    def get(self, query: str, page: int, token: str | None, fields: str | None = None) -> dict:
        base = self.options["url"].rstrip("/")
        if base.startswith(("file:", "/")):
            folder = urllib.parse.unquote(urllib.parse.urlparse(base).path) if base.startswith("file:") else base
            found = sorted(glob.glob(f"{glob.escape(folder)}/query={glob.escape(query)}/page={page}/part-*"))
            return fetch(f"file://{urllib.parse.quote(found[0] if found else f'{folder}/page-{page}.json')}")
        values = {"query.cond": query, "filter.overallStatus": self.options.get("status", "RECRUITING"), "pageSize": self.options.get("page_size", "1000"), "format": "json"}
        values |= ({"pageToken": token} if token else {}) | ({"fields": fields} if fields else {})
        return fetch(f"{base}?{urllib.parse.urlencode(values)}")

    def studies(self, query: str, page: int, answer: dict) -> Iterator[tuple]:
        for study in answer.get("studies", []):
            if isinstance(study, dict):
                yield query, page, json.dumps(study)


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.pages.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token, page = None, 0
        while True:
            try:
                answer = self.pages.get(partition.value, page, token)
            except Exception:
                if self.pages.strict:
                    raise
                return
            yield from self.pages.studies(partition.value, page, answer)
            token, page = answer.get("nextPageToken"), page + 1
            if not token:
                return
            time.sleep(self.pages.sleep)


_PARTITIONS = 64  # that the pages of a batch are dealt to, about


class PagedStream(DataSourceStreamReader):
    def __init__(self, pages: Pages):
        self.pages = pages
        self.most = int(pages.options.get("pages_per_batch", "100"))
        self.ceiling = max(self.most, int(pages.options.get("max_pages_per_batch", "1024")))
        self.at: dict | None = None  # query: next page, its token, whether there is one
        self.steps: list[list] = []  # query, page and token of what no finished batch has

    def initialOffset(self) -> dict:
        return {"at": {q: [0, None, True] for q in self.pages.queries}, "steps": []}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()["at"]
        full = False
        for query, (page, token, more) in list(self.at.items()):
            first = page
            for _ in range(self.most):
                if not more:
                    break
                try:
                    answer = self.pages.get(query, page, token, self.pages.options.get("token_fields", "NCTId"))
                except Exception:
                    if self.pages.strict:
                        raise
                    break
                self.steps.append([query, page, token])
                page, token = page + 1, answer.get("nextPageToken")
                more = bool(token)
                time.sleep(self.pages.sleep if more else 0)
            self.at[query] = [page, token, more]
            full = full or more and page - first == self.most
        self.most = min(2 * self.most, self.ceiling) if full else self.most  # the interface is ahead
        return {"at": {q: list(x) for q, x in self.at.items()}, "steps": [list(s) for s in self.steps]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.at is None:  # a restarted stream plans its last batch first
            self.at = {q: list(end["at"].get(q, [0, None, True])) for q in self.pages.queries}
        steps = [s for s in end["steps"] if start["at"].get(s[0], [0])[0] <= s[1] < end["at"][s[0]][0]]
        each = -(-len(steps) // _PARTITIONS) or 1
        return [InputPartition(steps[low : low + each]) for low in range(0, len(steps), each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for query, page, token in partition.value:
            yield from self.pages.studies(query, page, self.pages.get(query, page, token))  # what fails here is tried again by Spark

    def commit(self, end: dict) -> None:
        self.steps = [s for s in self.steps if s[1] >= end["at"].get(s[0], [0])[0]]
