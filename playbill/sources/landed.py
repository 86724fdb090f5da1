"""Landed API pages, page snapshots, catalogue tables, state tables and parsed-URL documents."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.functions.dates import iso_timestamp, modified_after
from playbill.operators.quality import coerce_list
from playbill.schemas import API_POST, VIDEO_FILE
from playbill.session import computed, written

_ENTRY = "struct<url string, lastmod string, api_id bigint>"
_SNAPSHOT = "path string, modificationTime timestamp, length bigint, content binary, content_type string"
_KINDS = ["movies", "shows", "series", "tvshows", "episodes"]


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """API posts landed as JSON lines, with the file (result page) of each. A line that is no
    JSON keeps its text in ``corrupt``."""
    reader = spark.read.schema(API_POST + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt")
    return reader.json(path).withColumn("page", F.input_file_name())


def parse_posts(df: DataFrame, body: str = "body") -> DataFrame:
    """API posts held as JSON text in a column."""
    kept = [c for c in df.columns if c != body]
    # Generator output: filters on the fields do not parse the text a second time.
    return df.select(*kept, F.inline(F.array(F.from_json(F.col(body), API_POST))))


def modified_posts(posts: DataFrame, since: Column) -> DataFrame:
    """Posts changed after ``since``; those with a missing or bad time stay."""
    return posts.filter(modified_after(iso_timestamp(F.col("modified_gmt")), since, on_unparsed=True))


def split_corrupt(df: DataFrame, required: list[str], corrupt: str = "corrupt") -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantine of unreadable rows and of rows that lack a required key."""
    bad = F.col(corrupt).isNotNull()
    for name in required:
        bad = bad | F.col(name).isNull()
    return df.filter(~bad).drop(corrupt), df.filter(bad)


def newest_valid(rows: DataFrame, required: list[str], version: str = "version", corrupt: str = "corrupt") -> tuple[DataFrame, DataFrame]:
    """Of state kept in versions, the rows of the newest one that is whole, and the bad rows of the newer ones that were passed over.

    A version is whole if none of its rows is unreadable or lacks a required key; one without rows holds nothing to go
    back to and is passed over too. Bad rows come with the ``reason``. Without a whole version there are no rows."""
    missing = [F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in required]
    reason = F.coalesce(F.when(F.col(corrupt).isNotNull(), F.lit("unreadable")), *missing)
    marked = computed(rows, {"reason": reason})
    # A row for each version; versions are partitions of a folder, so the chosen one prunes the second scan.
    whole = marked.groupBy(version).agg(F.count("reason").alias("bad")).filter("bad = 0")
    newest = whole.agg(F.max(version).alias("_newest"))
    good = rows.filter(F.col(version) == newest.scalar()).drop(corrupt)
    later = F.coalesce(F.col(version) > newest.scalar(), F.lit(True))
    return good, marked.filter(F.col("reason").isNotNull() & later)


def read_versions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """State files ``version=<n>/`` of JSON lines with ``version``; a line that is no JSON keeps its text in ``corrupt``."""
    layout = f"{schema}, corrupt string, version bigint"
    return spark.read.schema(layout).option("columnNameOfCorruptRecord", "corrupt").json(path)


def decode_page(content: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def read_snapshots(
    spark: SparkSession, path: str, kinds: list[str] | None = None, since: str | None = None, plain: bool = False
) -> DataFrame:
    """Cached page files ``content_type=<type>/<name>.html``, or with ``plain`` ``<type>/<name>.html``, as
    ``(content_type, file, html, fetched_at)``.

    ``kinds`` and ``since`` (a timestamp as text) reach the scan: files in the folders of other types are not read, and of
    files written before no bytes are. Empty files hold no page and are left out."""
    reader = spark.read.format("binaryFile")
    if plain:
        named = F.element_at(F.split("path", "/"), -2)
        folders = path if kinds is None else [f"{path}/{kind}" for kind in kinds]
        files = reader.option("recursiveFileLookup", "true").load(folders).withColumn("content_type", named)
    else:
        files = reader.schema(_SNAPSHOT).load(path)
        if kinds is not None:
            files = files.filter(F.col("content_type").isin(kinds))
    if since is not None:
        files = files.filter(F.col("modificationTime") >= F.lit(since).cast("timestamp"))
    return files.select(
        "content_type",
        F.element_at(F.split("path", "/"), -1).alias("file"),
        decode_page(F.col("content")).alias("html"),
        F.col("modificationTime").alias("fetched_at"),
    )


def write_snapshots(pages: DataFrame, path: str) -> DataFrame:
    """Pages ``(content_type, file, content)`` as one file each under ``content_type=<type>/``, written by the tasks that hold them;
    gives ``(content_type, file, bytes)`` of what was written. A page that is written again replaces its file, so a repeated
    task does no harm. The result is a table of its own: reading it writes nothing again."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for kind, name, content in zip(*(batch.column(c).to_pylist() for c in ("content_type", "file", "content")), strict=True):
                folder = f"{root}/content_type={quote(kind, safe='')}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            sizes = pc.binary_length(batch.column("content")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("content_type"), batch.column("file"), sizes], names=["content_type", "file", "bytes"])

    rows = pages.select("content_type", "file", "content").filter("content is not null")
    return written(rows.mapInArrow(save, "content_type string, file string, bytes bigint"), "snapshots")


def with_cache_file(df: DataFrame, nfkc: bool = True) -> DataFrame:
    """Add the cache file name of each URL, the join key to ``read_snapshots``."""
    return df.withColumn("file", F.concat(urls.cache_key(F.col("url"), nfkc), F.lit(".html")))


def decode_lists(df: DataFrame, lists: list[str], videos: str | None = None) -> DataFrame:
    """Catalogue rows with their JSON text fields as arrays; undecodable text is an empty list."""
    new = {name: coerce_list(F.col(name)) for name in lists}
    if videos:
        kind = f"array<{VIDEO_FILE}>"
        new[videos] = F.coalesce(F.from_json(F.col(videos), kind), F.expr(f"cast(array() as {kind})"))
    return df.withColumns(new)


def parsed_url_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """Entries of parsed-URL JSON documents, in either layout: entries are objects or plain URLs,
    the show list may be called ``series``, and ``modified_*`` lists hold the modified ones. A document is parsed once."""
    names = [(kind, modified) for kind in _KINDS for modified in (False, True)]
    schema = ", ".join(f"{'modified_' if modified else ''}{kind} array<string>" for kind, modified in names)
    kept = [c for c in documents.columns if c != body]
    parsed = documents.select(*kept, F.from_json(F.col(body), schema).alias("d"))
    lists = F.array(
        *[
            F.struct(
                urls.canonical_type(F.lit(kind)).alias("category"),
                F.lit(modified).alias("is_modified"),
                F.col(f"d.{'modified_' if modified else ''}{kind}").alias("entries"),
            )
            for kind, modified in names
        ]
    )
    rows = parsed.select(*kept, F.inline(lists)).filter("entries is not null")
    rows = rows.select(*kept, "category", "is_modified", F.posexplode("entries").alias("pos", "entry"))
    entry = F.when(F.col("entry").startswith("{"), F.from_json("entry", _ENTRY))
    return rows.select(
        *kept,
        "category",
        "is_modified",
        "pos",
        F.coalesce(entry["url"], F.when(~F.col("entry").startswith("{"), F.col("entry"))).alias("url"),
        entry["lastmod"].alias("lastmod"),
        entry["api_id"].alias("api_id"),
    )
