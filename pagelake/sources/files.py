"""File sources and sinks with fixed schemas (S2-S9, S16, S20).  Stored pages are rows of
Parquet tables, one page a row; the crawlers' file per page is the row's name.

Every scan passes an explicit ``StructType``: no inference pass over the
data, and a malformed row is kept in a corrupt-record column instead of
failing the job (PERMISSIVE).
"""

from __future__ import annotations

import itertools
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import scratch_path, ship_package

CRAWLED_PAGES_SCHEMA = T.StructType([
    T.StructField("URL", T.StringType()), T.StructField("Domain", T.StringType()),
    T.StructField("Crawl_Depth", T.IntegerType()), T.StructField("Timestamp", T.LongType())])

DISCOVERED_IMAGES_SCHEMA = T.StructType([
    T.StructField("Domain", T.StringType()), T.StructField("Image_URL", T.StringType()),
    T.StructField("Image_Type", T.StringType()), T.StructField("Size_KB", T.IntegerType()),
    T.StructField("Timestamp", T.LongType())])

#: Headers of the metadata files of stored pages and images
CONTENT_METADATA_HEADER = "URL,Filename,Title,Timestamp"
IMAGE_METADATA_HEADER = "URL,Filename,Alt,Timestamp"
METADATA_RE = r'^(.*?),([^,"]*),"(.*)",(\d+)$'

IMAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("vec_id", T.LongType()),
    T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("confidence", T.ArrayType(T.FloatType())),
    T.StructField("ocr_text", T.StringType()), T.StructField("objects", T.ArrayType(T.StringType())),
    T.StructField("is_nsfw", T.BooleanType())])

PAGE_FILE_RE = r"([^/]+)_(\d+)_(\d+)\.html$"


def append_csv(df: DataFrame, path: str) -> None:
    """S2/S3 append: each appended part carries its own header line, which
    the header-aware scan skips (the single-file "header only when empty"
    rule of the source becomes a per-part header)."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))


def write_metadata_lines(df: DataFrame, path: str, url: str, filename: str, title: str, ts: str,
                         header: str = CONTENT_METADATA_HEADER) -> None:
    """``URL,Filename,"Title",Timestamp`` with the title quoted but
    inner quotes left unescaped, as raw text lines; every part file starts
    with the header line."""
    row = F.concat(F.col(url), F.lit(","), F.col(filename), F.lit(',"'), F.col(title), F.lit('",'), F.col(ts).cast("string"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    df.select(F.when(first, F.concat(F.lit(header + "\n"), row)).otherwise(row).alias("value")).write.mode("append").text(path)


def read_metadata(spark: SparkSession, path: str, header: str = CONTENT_METADATA_HEADER) -> DataFrame:
    """S4/S5 scan: header lines are skipped; the quoted field runs from the
    quote behind the file name to the last quote of the line, so inner quotes
    and commas are kept; a line of another shape is kept in ``_corrupt_record``."""
    names = header.split(",")
    lines = spark.read.text(path).where(F.col("value") != header)
    ok = F.col("value").rlike(METADATA_RE)
    part = lambda k: F.when(ok, F.regexp_extract("value", METADATA_RE, k))
    return lines.select(part(1).alias(names[0]), part(2).alias(names[1]), part(3).alias(names[2]),
                        part(4).cast("long").alias(names[3]), F.when(~ok, F.col("value")).alias("_corrupt_record"))


def write_images(images: DataFrame, path: str) -> None:
    """The image table with its parallel arrays."""
    images.select(*[F.col(f.name).cast(f.dataType) for f in IMAGE_SCHEMA]).write.mode("overwrite").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMAGE_SCHEMA).parquet(path)


def write_page_files(pages: DataFrame, path: str, salts: int = 16) -> None:
    """Page corpus sink partitioned by host directory, one
    ``{domain}_{depth}_{id}.html`` name per page kept in the row.  Rows are
    dealt by host and salt first, so a host has at most ``salts`` files and a
    host with a third of all pages is written by many tasks."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("file_name"), F.lit(salts))
    pages.repartition(n, F.col("domain"), salt).write.mode("overwrite").partitionBy("domain").parquet(path)


def decode_page_file_name(path_col) -> tuple:
    """``{domain}_{depth}_{n}.html`` back to (domain, depth, n)."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    return (F.regexp_extract(p, PAGE_FILE_RE, 1), F.regexp_extract(p, PAGE_FILE_RE, 2).try_cast("int"),
            F.regexp_extract(p, PAGE_FILE_RE, 3).try_cast("long"))


def write_page_folders(pages: DataFrame, path: str, unique: bool = False) -> None:
    """S6 as the crawlers store it, one file a page: rows (file_name, html) become
    files of that name, so that a listing shows it.  For corpora that other tools read
    file by file; ``write_page_files`` is the form to query.

    The time goes into making files, not into bytes, so pages are dealt to all tasks by
    name, however few bytes they are; ``unique`` names are written where the pages are
    read, if that is in all tasks.  In a shared folder each task writes its files itself
    (``part-<n>/<name>``): Spark's writer needs some ten milliseconds of a core for each and
    commits them one by one in the driver.  Other file systems get
    ``file_name=<name>/part-*.txt`` from it."""
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = _local(spark, path)
    rows = pages.select("file_name", "html")
    if folder is None:
        rows.repartition(n, "file_name").write.mode("overwrite").partitionBy("file_name").text(path)
        return
    if not unique or rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(n, "file_name")
    if not unique:
        rows = rows.sortWithinPartitions("file_name")
    where, fs = _hadoop(spark, path)
    fs.delete(where, True)
    fs.mkdirs(where)
    ship_package(spark)
    rows.select("file_name", F.col("html").cast("binary")).mapInArrow(_file_writer(folder), "files long").agg(F.sum("files")).collect()


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _local(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python opens it, if it is in a folder that all machines share."""
    where, fs = _hadoop(spark, path)
    uri = fs.makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


#: Characters that a folder or file name has as %XX, as in Spark's partition folders
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}


def _file_writer(folder: str):
    """Rows (file_name, html), equal names together, as files of one folder a task, which
    gets its name when it is whole; a second attempt of the task changes nothing then."""
    def write(batches):
        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}"
        own = os.path.join(folder, f"_{part}-{task.taskAttemptId()}")
        out, last, files = None, None, 0
        for batch in batches:
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or name != last:
                    if out is None:
                        os.makedirs(own)
                    else:
                        out.close()
                    named = name.translate(_ESCAPED) if name else "__HIVE_DEFAULT_PARTITION__"
                    if named[0] in "_.":  # readers would pass over it
                        named = f"file_name={named}"
                    # null and empty names share a file
                    out, last, files = open(os.path.join(own, named), "ab"), name, files + 1
                out.write((html or b"") + b"\n")
        if out is not None:
            out.close()
            try:
                os.rename(own, os.path.join(folder, part))
            except OSError:
                if not os.path.isdir(os.path.join(folder, part)):
                    raise
        yield pa.RecordBatch.from_pydict({"files": [files]})
    return write


LISTING = "path string, bytes long, modified long, folder string"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return ((name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))
            or name.startswith(".") or name.endswith("._COPYING_"))


def _lister(deep: bool):
    """The files (path, bytes, modified) in folders (folder); folders in these are gone
    through too, or returned (folder)."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.int64()), ("folder", pa.string())])

    def found(folder):
        todo = [folder]
        while todo:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    if _hidden(e.name):
                        continue
                    if not e.is_dir():
                        s = e.stat()
                        yield f"file:{e.path}", s.st_size, s.st_mtime_ns // 1_000_000, None
                    elif deep:
                        todo.append(e.path)
                    else:
                        yield None, None, None, e.path

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = found(folder)
                while some := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
    return run


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, bytes, modified) of the files under a shared folder.  Tasks list the folders in
    it and store what they find: no file passes through the driver, and what reads the
    listing twice does not list twice."""
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top, all_ = scratch_path(spark, "listing"), scratch_path(spark, "listing")
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).mapInArrow(_lister(False), LISTING).write.parquet(top)
    first = spark.read.schema(LISTING).parquet(top)
    below = first.where("folder IS NOT NULL").select("folder").repartition(n).mapInArrow(_lister(True), LISTING)
    found = first.where("folder IS NULL").unionByName(below)
    if pattern != "*":
        regex = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        found = found.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(f"(?s)^(?:{regex})$"))
    found.select("path", "bytes", "modified").write.parquet(all_)
    return spark.read.schema("path string, bytes long, modified long").parquet(all_).withColumn("modified", F.timestamp_millis("modified"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, modified) of all files under ``path``, from the file system's
    listing alone: no content is read.  The folder of a page written by
    Spark's writer (``write_page_folders``) counts as its name."""
    folder = _local(spark, path)
    if folder is not None:
        listed = _listed(spark, folder, pattern)
    else:
        listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
                  .select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))
    name = F.regexp_extract("path", r"([^/=]+)(?:/part-[^/]*)?$", 1)
    return listed.select("path", name.alias("name"), "bytes", "modified")


def list_pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(domain, depth, n, name, bytes, modified) of the page files under ``path``,
    decoded from their names; files with other names are left out."""
    listed = list_files(spark, path, pattern)
    domain, depth, n = decode_page_file_name("name")
    return listed.where(F.col("name").rlike(PAGE_FILE_RE)).select(
        domain.alias("domain"), depth.alias("depth"), n.alias("n"), "name", "bytes", "modified")
