"""Generic readers of raw pages: JSON paths, delimited text, HTML metadata, feeds; content-addressed archives; a paged connector."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import first_filled


def json_records(raw: DataFrame, path: str, body: str = "body") -> DataFrame:
    """body's items at a path such as $.data.items, one JSON text a row, with their ordinal."""
    items = F.variant_get(F.try_parse_json(body), path, "array<variant>")
    return raw.select("*", F.posexplode(items).alias("ordinal", "_v")).withColumn("record", F.to_json("_v")).drop("_v")


def csv_records(raw: DataFrame, schema: str, body: str = "body", delimiter: str = ",") -> DataFrame:
    """The lines of each body after its header, parsed by schema."""
    line = raw.select("*", F.posexplode(F.split(F.col(body), r"\r?\n")).alias("ordinal", "_l")).where("ordinal > 0 and trim(_l) <> ''")
    return line.withColumn("_r", F.from_csv("_l", schema, {"delimiter": delimiter})).select("*", "_r.*").drop("_l", "_r")


def html_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, description, canonical: of a page's head; the Open Graph title wins over the title element."""
    h = F.coalesce(F.col(html), F.lit(""))
    meta = lambda key, name: F.regexp_extract(h, rf'(?is)<meta[^>]*{key}\s*=\s*["\']{name}["\'][^>]*content\s*=\s*["\']([^"\']*)', 1)
    title = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("*", first_filled(meta("property", "og:title"), title).alias("title"), first_filled(meta("name", "description"), meta("property", "og:description")).alias("description"), first_filled(F.regexp_extract(h, r'(?is)<link[^>]*rel\s*=\s*["\']canonical["\'][^>]*href\s*=\s*["\']([^"\']*)', 1)).alias("canonical"), first_filled(F.regexp_extract(h, r'(?is)<html[^>]*\slang\s*=\s*["\']?([A-Za-z-]+)', 1)).alias("lang"))


def feed_records(raw: DataFrame, body: str = "body") -> DataFrame:
    """title, link, published of the items of RSS and Atom bodies, with their ordinal."""
    item = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))
    tag = lambda names: F.regexp_extract("_i", rf"(?is)<(?:{names})(?:\s[^>]*)?(?<!/)>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</", 1)
    rows = raw.select("*", F.posexplode(item).alias("ordinal", "_i"))
    return rows.select("*", first_filled(tag("title")).alias("title"), first_filled(tag("link"), F.regexp_extract("_i", r"(?is)<link[^>]*href\s*=\s*[\"']([^\"']*)", 1)).alias("link"), first_filled(tag("pubDate|published|updated")).alias("published")).drop("_i")


def archive(spark: SparkSession, source: str) -> DataFrame:
    """digest, path, length, content of raw files: content-addressed, one row for each distinct body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return files.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("path").alias("path"), F.first("length").alias("length"), F.first("content").alias("content"))


def normal_record(df: DataFrame, ids: list[str], titles: list[str]) -> DataFrame:
    """record_key, title: the first filled candidate of each; a row without id is keyed by its digest."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return df.select("*", F.coalesce(first_filled(*map(F.col, ids)), digest).alias("record_key"), first_filled(*map(F.col, titles)).alias("normal_title"))


def keyset_page(df: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next rows in text order of the key, strictly after the cursor."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def source_contracts(text: str) -> dict[str, dict]:
    """id -> contract from registry JSON; an incomplete or repeated one is refused."""
    doc = json.loads(text)
    if doc.get("schema_version") != 1 or not isinstance(doc.get("sources"), list):
        raise ValueError("the registry needs schema_version 1 and a list of sources")
    need = ("id", "identifier", "record_schema", "license", "storage_policy", "redistribution_policy", "freshness_policy", "identifier_rules", "mapping_rules")
    out: dict[str, dict] = {}
    for s in doc["sources"]:
        checks = s.get("data_quality_checks")
        if any(not isinstance(s.get(k), str) or not s[k] for k in need) or not isinstance(checks, list) or not checks or any(not isinstance(c, str) or not c.strip() for c in checks):
            raise ValueError(f"contract {s.get('id')!r} is incomplete")
        if s["id"] in out:
            raise ValueError(f"contract {s['id']} is repeated")
        out[s["id"]] = s
    return out


class _Page(InputPartition):
    def __init__(self, number: int):
        self.value = number


class PagedSource(DataSource):
    """A paged connector as a data source: `fetch(page) -> iterable of (record_id, body)`, one partition a page. Subclass to set it.

    Options: pages, the number of pages; the schema is fixed, so a changed mapping never meets old columns.
    """

    fetch: Callable[[int], Iterator[tuple[str, str]]] | None = None

    @classmethod
    def name(cls) -> str:
        return "factloom_pages"

    def schema(self) -> str:
        return "page int, record_id string, body string"

    def reader(self, schema) -> DataSourceReader:
        source, pages = type(self).fetch, int(self.options.get("pages", 1))

        class Reader(DataSourceReader):
            def partitions(self):
                return [_Page(i) for i in range(pages)]

            def read(self, partition):
                for record_id, body in source(partition.value):
                    yield partition.value, record_id, body

        return Reader()
