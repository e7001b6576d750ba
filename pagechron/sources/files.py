"""Readers and writers of manifests, answer rows, seeds, captures and page folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim

MANIFEST = (
    "id string, url string, snapshot string, captureLagDays int, archiveUrl string, "
    "label struct<published:string,precision:string,source:string,tier:string,evidence:string>, holdOut array<string>, "
    "strata struct<host:string,tld:string,era:int,lang:string,pageType:string,signals:array<string>,labelInPage:boolean>, "
    "http struct<status:int,mime:string,digest:string,length:bigint>, fetch struct<at:string,bytes:bigint,sha256:string>"
)
ANSWERS = "tool string, file string, gold string, found string, ms double"
EXPECTED = "url string, capturedAt string, notes string, fetchedFeedUrl string, knownMiss string, expect struct<published:string,modified:string,conflict:string>"
CDX = "original string, timestamp string, status string, mime string, digest string, length string"


#: The file in a manifest's folder that names the version in force.
POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):
    """The store behind a path, and a function from names in it to its own paths."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: jvm.org.apache.hadoop.fs.Path(at, name)


def _version(spark: SparkSession, path: str) -> str | None:
    """The name of the version in force, or None where nothing has been written."""
    store, under = _store(spark, path)
    if not store.exists(under(POINTER)):
        return None
    return spark.read.text(f"{path}/{POINTER}").first().value


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Corpus entries, one JSON object a line; blank lines are dropped.

    A folder that write_manifest has made is read at the version in force; any
    other path is read as it is.
    """
    version = _version(spark, path)
    return spark.read.schema(MANIFEST).json(f"{path}/{version}" if version else path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Replace a manifest: readers see the old one until the new one is whole.

    The entries go to a folder of their own; only when Spark has committed it does
    a small file that names it take the old one's place, by one rename. A job that
    fails or is killed before leaves the old manifest in force. The version before
    stays, for those still reading it; older ones are deleted.
    """
    spark, name = entries.sparkSession, f"v-{uuid.uuid4().hex}"
    before = _version(spark, path)
    entries.write.json(f"{path}/{name}")
    store, under = _store(spark, path)
    jvm = spark.sparkContext._jvm
    out = store.create(under(f".{name}"), True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(under(f".{name}")), store.makeQualified(under(POINTER)), options)
    for found in store.listStatus(under(".")):
        if found.getPath().getName().startswith("v-") and found.getPath().getName() not in (name, before):
            store.delete(found.getPath(), True)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tools' answers: tool, file, gold, found, ms."""
    return spark.read.schema(ANSWERS).json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Lines without comments and white space; empty ones are dropped."""
    return spark.read.text(path).select(trim(F.regexp_replace("value", "#.*$", "")).alias("seed")).filter("seed != ''")


def unseen(seeds: DataFrame, attempted: DataFrame, key: str = "seed") -> DataFrame:
    """Seeds that no earlier run has tried, each once."""
    return seeds.dropDuplicates([key]).join(attempted.select(key), key, "left_anti")


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a CDX listing as JSON arrays, one a line, the header row dropped."""
    row = F.from_json(F.regexp_replace(F.regexp_replace("value", "^\\[\\[", "["), "\\]?,?$", "]"), "array<string>")
    names = [c.split()[0] for c in CDX.split(", ")]
    rows = spark.read.text(path).select(row.alias("r")).filter("size(r) >= 6 AND r[0] != 'original'")
    return rows.select(*(F.col("r")[k].alias(n) for k, n in enumerate(names)))


def read_page_folders(spark: SparkSession, path: str) -> DataFrame:
    """slug, url, expected fields, html and optional headers, feed and sitemap of folders of pages.

    A folder without its page or its expectations is dropped.
    """
    slug = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)

    def text(name: str, column: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True).select(slug.alias("slug"), F.col("value").alias(column))

    expected = text("expected.json", "json").select("slug", F.from_json("json", EXPECTED).alias("e")).select("slug", "e.*")
    headers = text("headers.json", "json").select("slug", F.from_json("json", "map<string,string>").alias("headers"))
    rows = expected.join(text("page.html", "html"), "slug").join(headers, "slug", "left")
    return rows.join(text("feed.xml", "feed"), "slug", "left").join(text("sitemap.xml", "sitemap"), "slug", "left")


def side_documents(pages: DataFrame) -> DataFrame:
    """url, body and headers of what read_page_folders found beside its pages."""
    origin = F.regexp_extract("url", "^[A-Za-z]+://[^/]+", 0)
    none = F.lit(None).cast("map<string,string>")
    feeds = pages.filter("feed IS NOT NULL AND fetchedFeedUrl IS NOT NULL").select(F.col("fetchedFeedUrl").alias("url"), F.col("feed").alias("body"), none.alias("headers"))
    maps = pages.filter("sitemap IS NOT NULL").select(F.concat(origin, F.lit("/sitemap.xml")).alias("url"), F.col("sitemap").alias("body"), none.alias("headers"))
    own = pages.filter("headers IS NOT NULL").select("url", F.lit(None).cast("string").alias("body"), "headers")
    return feeds.unionByName(maps).unionByName(own)


def slug_of(url):
    """A folder name for a URL."""
    bare = F.regexp_replace(F.lower(url), "^[a-z]+://(?:www\\.)?", "")
    return F.left(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))


def is_redirect_stub(html):
    """A short page that only sends its reader elsewhere."""
    jumps = "(?i)http-equiv\\s*=\\s*[\"']?refresh|location\\.(?:replace|href)|const target"
    return (F.length(html) <= 4096) & html.rlike(jumps)
