"""Paginated JSON sources as a Spark data source, and their normalisation to canonical postings."""

from __future__ import annotations

import json
import logging
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera import tables

log = logging.getLogger("tessera.http")

# The addresses and limits of the two public services.
COUNTRIES = ("us", "gb", "de", "fr", "it", "nl", "ca", "au")
ADZUNA_URL = "https://api.adzuna.com/v1/api/jobs"
USAJOBS_URL = "https://data.usajobs.gov/api/search"
PAGE_SIZE, TIMEOUT = 50, 30


class Throttle:
    """Keeps calls at least interval seconds apart."""

    def __init__(self, interval: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def __call__(self) -> None:
        if self.interval:
            if self.last is not None and (left := self.interval - (self.clock() - self.last)) > 0:
                self.sleep(left)
            self.last = self.clock()


@dataclass(frozen=True)
class Service:
    """How one service's pages are asked for and read."""

    name: str
    request: Callable[[dict, int], tuple[str, dict]]
    results: Callable[[dict], list]
    total: Callable[[dict], int | None]


def adzuna_request(options: dict, page: int) -> tuple[str, dict]:
    country = (options.get("country") or "").strip().lower()
    if country not in COUNTRIES:
        raise ValueError(f"country must be one of {', '.join(COUNTRIES)}, not {country!r}")
    query = {
        "app_id": options.get("app_id"), "app_key": options.get("app_key"), "what": options.get("query"),
        "results_per_page": PAGE_SIZE, "sort_by": "date",
    }
    if options.get("location"):
        query["where"] = options["location"]
    return f"{ADZUNA_URL}/{country}/search/{page}?{urlencode({k: v for k, v in query.items() if v is not None})}", {}


def usajobs_request(options: dict, page: int) -> tuple[str, dict]:
    query = {"Keyword": options.get("query"), "Page": page}
    if options.get("location"):
        query["LocationName"] = options["location"]
    headers = {"Host": "data.usajobs.gov", "User-Agent": options.get("user_agent", ""), "Authorization-Key": options.get("app_key", "")}
    return f"{USAJOBS_URL}?{urlencode({k: v for k, v in query.items() if v is not None})}", headers


SERVICES = {
    "adzuna": Service("adzuna", adzuna_request, lambda d: d.get("results") or [], lambda d: d.get("count")),
    "usajobs": Service(
        "usajobs", usajobs_request, lambda d: (d.get("SearchResult") or {}).get("SearchResultItems") or [],
        lambda d: (d.get("SearchResult") or {}).get("SearchResultCountAll", d.get("count")),
    ),
}


def http_get(url: str, headers: dict) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers), timeout=TIMEOUT) as answer:  # noqa: S310
        return json.loads(answer.read())


def fetch_pages(service: Service, options: dict, get: Callable[[str, dict], dict] = http_get, throttle: Callable[[], None] | None = None) -> Iterator[dict]:
    """Results page by page, until an empty page, max_pages, or the pages that the first page's total asks for."""
    most, page = int(options.get("max_pages") or 0) or math.inf, 1
    while page <= most:
        if throttle:
            throttle()
        data = get(*service.request(options, page))
        results = service.results(data)
        log.info("%s: page %d has %d records", service.name, page, len(results))
        if not results:
            return
        if page == 1 and (total := service.total(data)):
            most = min(most, math.ceil(total / len(results)))
        yield from results
        page += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # one rate-limited service: its pages come in order

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service = SERVICES[self.options.get("service", "adzuna")]
        get = http_get
        if fixture := self.options.get("fixture"):  # pages given as JSON: {"1": {...}, "2": {...}}
            pages = json.loads(fixture)
            get = lambda url, headers: pages.get(headers["page"], {})
            service = Service(service.name, lambda o, p: ("", {"page": str(p)}), service.results, service.total)
        wait = Throttle(float(self.options.get("min_interval_seconds") or 0))
        for item in fetch_pages(service, self.options, get, wait):
            yield (service.name, json.dumps(item, ensure_ascii=False))


class PostingsSource(DataSource):
    """spark.dataSource.register(PostingsSource); spark.read.format("postings").options(service=..., query=..., country=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return "source string, raw_payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


_ADZUNA = (
    "id string, title string, company struct<display_name:string>, redirect_url string, location struct<display_name:string>, "
    "description string, contract_time string, contract_type string, salary_min double, salary_max double, created string"
)
_USAJOBS = (
    "MatchedObjectDescriptor struct<PositionID:string, PositionTitle:string, OrganizationName:string, PositionLocationDisplay:string, "
    "PositionURI:string, UserArea:struct<Details:struct<JobSummary:string>>, PositionSchedule:array<struct<Name:string>>, "
    "PositionRemuneration:array<struct<MinimumRange:double, MaximumRange:double>>, PublicationStartDate:string>"
)


def normalize_records(df: DataFrame) -> DataFrame:
    """(source, raw_payload) to the envelope's payload; what a record lacks is null."""
    a, u = F.from_json("raw_payload", _ADZUNA), F.from_json("raw_payload", _USAJOBS)["MatchedObjectDescriptor"]
    first = lambda c: F.try_element_at(c, F.lit(1))
    fields = {
        "source_job_id": (a["id"], u["PositionID"]),
        "job_title_raw": (a["title"], u["PositionTitle"]),
        "company_raw": (a["company"]["display_name"], u["OrganizationName"]),
        "location_raw": (a["location"]["display_name"], u["PositionLocationDisplay"]),
        "description_raw": (a["description"], u["UserArea"]["Details"]["JobSummary"]),
        "url": (a["redirect_url"], u["PositionURI"]),
        "employment_type_raw": (a["contract_time"], first(u["PositionSchedule"])["Name"]),
        "contract_type_raw": (a["contract_type"], F.lit(None).cast("string")),
        "salary_min_raw": (a["salary_min"], first(u["PositionRemuneration"])["MinimumRange"]),
        "salary_max_raw": (a["salary_max"], first(u["PositionRemuneration"])["MaximumRange"]),
        "currency_raw": (F.lit(None).cast("string"), F.lit("USD")),
        "posted_at_raw": (a["created"], u["PublicationStartDate"]),
    }
    cols = [F.when(F.col("source") == "usajobs", of_u).otherwise(of_a).alias(name) for name, (of_a, of_u) in fields.items()]
    payload = F.struct(F.col("source").alias("source"), *cols)
    assert [f.name for f in tables.CANONICAL] == ["source", *fields]
    return df.withColumn("payload", payload)


def envelope(df: DataFrame, run_id: str, query: str, location: str | None, started_at: str, version: str = "v1") -> DataFrame:
    """Normalised records with the metadata of their run."""
    meta = F.struct(
        F.lit(run_id).alias("run_id"), F.col("source"), F.lit(query).alias("query"), F.lit(location).cast("string").alias("location"),
        F.lit(started_at).alias("started_at"), F.lit(version).alias("canonical_schema_version"),
    )
    return normalize_records(df).select(meta.alias("ingestion_metadata"), "raw_payload", "payload")
