"""Metadata sources: rows of the services' JSON as one schema, and plain retry and pacing around whatever fetches them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirelake.functions import text as T

CROSSREF = (
    "title array<string>, author array<struct<given:string,family:string>>, DOI string, publisher string, `container-title` array<string>, abstract string, URL string, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>"
)
S2 = (
    "paperId string, title string, year int, abstract string, citationCount long, url string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>, "
    "references array<struct<paperId:string,externalIds:struct<DOI:string,ArXiv:string>>>"
)
OPENALEX = "id string, title string, publication_year int, doi string, cited_by_count long, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
DBLP = "title string, year string, venue string, doi string, url string, authors struct<author:variant>"


def crossref(item: Column) -> Column:
    """The metadata struct; the year is that of print, online publication, or deposit."""
    r = F.from_json(item, CROSSREF)
    year = lambda c: F.get(F.get(r[c]["date-parts"], 0), 0)
    return F.struct(
        F.get(r["title"], 0).alias("title"), F.transform(r["author"], lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))).alias("authors"),
        F.coalesce(year("published-print"), year("published-online"), year("created")).cast("string").alias("year"), r["DOI"].alias("doi"),
        F.get(r["container-title"], 0).alias("venue"), r["abstract"].alias("abstract"), r["URL"].alias("url"),
    )


def semantic_scholar(item: Column) -> Column:
    r = F.from_json(item, S2)
    target = lambda t: F.struct(t["externalIds"]["DOI"].alias("doi"), t["externalIds"]["ArXiv"].alias("arxiv_id"), F.lit(None).cast("string").alias("openalex_id"), t["paperId"].alias("semantic_scholar_id"))
    targets = F.filter(F.transform(r["references"], target), lambda t: F.coalesce(t["doi"], t["arxiv_id"], t["semantic_scholar_id"]).isNotNull())
    return F.struct(
        r["title"].alias("title"), F.transform(r["authors"], lambda a: a["name"]).alias("authors"), r["year"].cast("string").alias("year"), r["externalIds"]["DOI"].alias("doi"), r["externalIds"]["ArXiv"].alias("arxiv_id"),
        r["paperId"].alias("semantic_scholar_id"), r["abstract"].alias("abstract"), r["citationCount"].alias("citation_count"), r["url"].alias("url"), targets.alias("reference_targets"),
    )


def openalex(item: Column) -> Column:
    r = F.from_json(item, OPENALEX)
    return F.struct(
        r["title"].alias("title"), F.transform(r["authorships"], lambda a: a["author"]["display_name"]).alias("authors"), r["publication_year"].cast("string").alias("year"), T.doi_norm(r["doi"]).alias("doi"),
        T.openalex_norm(r["id"]).alias("openalex_id"), T.abstract_from_index(r["abstract_inverted_index"]).alias("abstract"), r["cited_by_count"].alias("citation_count"),
        F.transform(r["referenced_works"], T.openalex_norm).alias("targets"),
    )


def dblp(item: Column) -> Column:
    """``author`` may be one object or a list; a final full stop of the title goes."""
    r = F.from_json(item, DBLP)
    listed = F.try_variant_get(r["authors"]["author"], "$", "array<struct<text:string>>")
    one = F.try_variant_get(r["authors"]["author"], "$.text", "string")
    return F.struct(
        F.regexp_replace(r["title"], r"\.$", "").alias("title"), F.coalesce(F.transform(listed, lambda a: a["text"]), F.array_compact(F.array(one))).alias("authors"), r["year"].alias("year"),
        r["venue"].alias("venue"), r["doi"].alias("doi"), r["url"].alias("url"),
    )


def arxiv_year(published: Column) -> Column:
    return F.nullif(F.regexp_extract(published, r"^(\d{4})", 1), F.lit(""))


@dataclass
class Retry:
    """Attempts with exponential back-off on listed statuses and connection errors; other errors fail at once."""

    attempts: int = 3
    first_wait: float = 0.5
    statuses: tuple[int, ...] = (429, 500, 502, 503, 504)
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, op: Callable[[], object]) -> tuple[bool, object]:
        """(True, result) or (False, error); never raises."""
        error: Exception | None = None
        for attempt in range(self.attempts):
            try:
                return True, op()
            except Exception as e:  # the caller gets it back
                error = e
                status = getattr(getattr(e, "response", None), "status_code", getattr(e, "code", None))
                if not (isinstance(e, (ConnectionError, TimeoutError)) or status in self.statuses):
                    break
                if attempt + 1 < self.attempts:
                    self.sleep(self.first_wait * 2**attempt)
        return False, error


@dataclass
class Pace:
    """A least interval between calls, across threads."""

    interval: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def wait(self) -> None:
        with self._lock:
            now = self.clock()
            if now < self._next:
                self.sleep(self._next - now)
            self._next = max(now, self._next) + self.interval


_PACES: dict[tuple, Pace] = {}


def worker_pace(*key) -> Pace:
    """The pace of a service in this worker; its last part is the interval."""
    return _PACES.setdefault(key, Pace(key[-1]))


class ServiceSource(DataSource):
    """``spark.read.format("metadata_service")``: JSON replies of a fetch function, one partition for each query.

    Options ``module`` and ``function`` name a function of a query that returns JSON texts; ``queries``
    are separated by line ends; ``attempts`` and ``interval`` (least seconds between the calls of a worker, 0 for none)
    pace them. A query that fails for good is one row with ``error`` and without ``item``; one without replies has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "metadata_service"

    def schema(self) -> str:
        return "query string, pos int, item string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ServiceReader(dict(self.options))


class ServiceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.options["queries"].split("\n") if q.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        pace = worker_pace(self.options["module"], self.options["function"], float(self.options.get("interval", 0)))

        def call() -> list:
            pace.wait()
            return list(fetch(partition.value))

        ok, found = Retry(int(self.options.get("attempts", 3)))(call)
        if not ok:
            yield partition.value, None, None, f"{type(found).__name__}: {found}"
            return
        for i, item in enumerate(found):
            yield partition.value, i, item, None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ServiceSource)


def dispatch(tables: dict[str, DataFrame], wanted: list[str], fallback: list[str]) -> DataFrame:
    """The union of the wanted sources' rows; where they have none, the first fallback source with rows; none at all is an error."""
    chosen = [tables[s] for s in wanted if s in tables]
    rows = None
    for t in chosen:
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    if rows is not None and not rows.isEmpty():
        return rows
    for s in fallback:
        if s in tables and not tables[s].isEmpty():
            return tables[s]
    raise LookupError("no source has rows")
