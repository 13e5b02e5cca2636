"""Source/sink round trips (S2-S12, S14-S16, S20, F14-F16, F23): each query
writes a table derived from the driver data to the shared checkpoint folder
and reads it back with a fixed schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import crawled_pages as CP
from pagelake.catalog._sql import discovered_images as DI
from pagelake.catalog._sql import url_log as UL
from pagelake.catalog.extraction import _KEY_SQL
from pagelake.functions import http as HT
from pagelake.functions import urls as U
from pagelake.operators.limits import retention
from pagelake.operators.page_index import PageIndex
from pagelake.plans import fixtures as FX
from pagelake.session import scratch_path, table
from pagelake.sources import config as CFG
from pagelake.sources import files as FS
from pagelake.sources import logs as LG
from pagelake.sources import sitemap as SM

# Event type -> log level for the rendered level log
LEVEL_OF_TYPE = {"error": "ERROR", "purchase": "WARNING", "signup": "INFO", "click": "DEBUG", "view": "DEBUG"}
CONFIG = {
    "crawler": {"max_depth": 3, "max_pages": 1000, "max_file_size_mb": 0.01},
    "filters": {"allowed_domains": ["example.com", "example.org"],
                "excluded_paths": ["/fr/", "/de/"],
                "allowed_extensions": [".html", ".htm", ".php"],
                "image_extensions": [".jpg", ".jpeg", ".png", ".gif"]},
}


@register("crawled_pages_csv", f"""
SELECT url AS URL, domain AS Domain, crawl_depth AS Crawl_Depth, ts_epoch AS Timestamp FROM {CP()}
""")
def crawled_pages_csv(spark, sf_dir):
    """Crawled-pages CSV append + scan with the fixed header schema."""
    path = scratch_path(spark, "crawled_pages_csv")
    cp = FX.crawled_pages(spark, sf_dir).select(
        F.col("url").alias("URL"), F.col("domain").alias("Domain"),
        F.col("crawl_depth").alias("Crawl_Depth"), F.col("ts_epoch").alias("Timestamp"))
    FS.append_csv(cp, path)
    return FS.read_csv(spark, path, FS.CRAWLED_PAGES_SCHEMA)


@register("discovered_images_csv", f"""
SELECT domain AS Domain, image_url AS Image_URL, image_type AS Image_Type, CAST(size_kb AS INTEGER) AS Size_KB,
       ts_epoch AS Timestamp FROM {DI()}
""")
def discovered_images_csv(spark, sf_dir):
    """S3: discovered-images CSV append + scan."""
    path = scratch_path(spark, "discovered_images_csv")
    di = FX.discovered_images(spark, sf_dir).select(
        F.col("domain").alias("Domain"), F.col("image_url").alias("Image_URL"),
        F.col("image_type").alias("Image_Type"), F.col("size_kb").cast("int").alias("Size_KB"),
        F.col("ts_epoch").alias("Timestamp"))
    FS.append_csv(di, path)
    return FS.read_csv(spark, path, FS.DISCOVERED_IMAGES_SCHEMA)


def _meta_sql(ext: str, name: str, title: str) -> str:
    return (f"SELECT url AS URL, substr({_KEY_SQL}, 7) || '{ext}' AS Filename, {title} AS {name}, "
            f"CAST({FX.EPOCH0} + page_id AS BIGINT) AS Timestamp, false AS corrupt FROM pages")


def _metadata(spark, sf_dir, title, ext: str, header: str, name: str):
    from pagelake.operators.extract import sanitized_key
    path = scratch_path(spark, "metadata")
    t = table(spark, sf_dir, "pages").select(
        "url", F.concat(sanitized_key("url"), F.lit(ext)).alias("file"), title.alias("title"),
        (F.lit(FX.EPOCH0) + F.col("page_id")).alias("ts"))
    FS.write_metadata_lines(t, path, "url", "file", "title", "ts", header)
    m = FS.read_metadata(spark, path, header)
    return m.select("URL", "Filename", name, "Timestamp", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@register("content_metadata_csv", _meta_sql(
    ".html", "Title", """'A "' || regexp_extract(html, '<title>([^<]+)</title>', 1) || '", quoted'"""))
def content_metadata_csv(spark, sf_dir):
    """Metadata lines of stored pages, header first, the title with inner
    quotes and commas left as they are; written, appended and read back."""
    from pagelake.functions.html import TITLE_RE
    title = F.concat(F.lit('A "'), F.regexp_extract("html", TITLE_RE, 1), F.lit('", quoted'))
    return _metadata(spark, sf_dir, title, ".html", FS.CONTENT_METADATA_HEADER, "Title")


@register("image_metadata_csv", _meta_sql(".png", "Alt", "'alt ' || CAST(page_id AS VARCHAR)"))
def image_metadata_csv(spark, sf_dir):
    """The same lines for images, with the alternative text."""
    alt = F.concat(F.lit("alt "), F.col("page_id").cast("string"))
    return _metadata(spark, sf_dir, alt, ".png", FS.IMAGE_METADATA_HEADER, "Alt")


@register("image_sink_by_domain", f"""
SELECT domain, 'img_' || CAST(pos AS VARCHAR) || '_' || CAST(page_id AS VARCHAR) || '.' || image_type AS file_name,
       CAST(size_kb AS INTEGER) AS size_kb FROM (
  SELECT *, ts_epoch - {FX.EPOCH0} - page_id * 60 AS pos FROM {DI()})
""")
def image_sink_by_domain(spark, sf_dir):
    """Image sink, one folder per domain, ``img_{{i}}_{{n}}.{{type}}`` names."""
    path = scratch_path(spark, "image_sink")
    di = FX.discovered_images(spark, sf_dir)
    pos = F.col("ts_epoch") - FX.EPOCH0 - F.col("page_id") * 60
    rows = di.select("domain", F.concat(F.lit("img_"), pos.cast("string"), F.lit("_"), F.col("page_id").cast("string"),
                                        F.lit("."), F.col("image_type")).alias("file_name"), F.col("size_kb").cast("int").alias("size_kb"))
    FS.write_page_files(rows, path)
    return spark.read.schema("file_name string, size_kb int, domain string").parquet(path).select("domain", "file_name", "size_kb")


@register("page_table_shapes", f"""
WITH c AS (SELECT c.*, p.html, regexp_extract(p.html, '<title>([^<]+)</title>', 1) AS title FROM {CP()} c JOIN pages p USING (page_id, url))
SELECT 'content' AS shape, page_id AS id, url, title, md5(html) AS content_md5, NULL AS depth, NULL AS visited FROM c
UNION ALL SELECT 'depth', page_id, url, title, NULL, CAST(crawl_depth AS INTEGER), NULL FROM c
UNION ALL SELECT 'file', page_id, url, title, md5(html), NULL, NULL FROM c
UNION ALL SELECT 'state', page_id, url, NULL, NULL, CAST(crawl_depth AS INTEGER), page_id % 2 = 0 FROM c
""")
def page_table_shapes(spark, sf_dir):
    """The four shapes of the page table (with content, with depth, with
    a file path, URL state), each written with its schema and read back."""
    cp = FX.crawled_pages(spark, sf_dir).select("page_id", "url", "crawl_depth", F.timestamp_seconds("ts_epoch").alias("ts"))
    p = cp.join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select(
        F.col("page_id").alias("id"), "url", F.regexp_extract("html", "<title>([^<]+)</title>", 1).alias("title"),
        F.col("html").alias("content"), F.col("crawl_depth").cast("int").alias("depth"), "ts",
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("file_path"), (F.col("page_id") % 2 == 0).alias("visited"))
    shapes = {"content": "id url title content ts", "depth": "id url title depth ts", "file": "id url title content file_path",
              "state": "id url depth visited"}
    out = None
    for shape, names in shapes.items():
        path = scratch_path(spark, f"pages_{shape}")
        rows = p.select(*names.split())
        rows.write.parquet(path)
        back = spark.read.schema(rows.schema).parquet(path)
        one = back.select(F.lit(shape).alias("shape"), *[F.col(c) for c in back.columns if c not in ("ts", "file_path")])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("shape", "id", "url", "title", F.md5("content").alias("content_md5"), "depth", "visited")


@register("content_by_url", f"""
SELECT w.url, md5(p.html) AS content_md5, CAST(strlen(p.html) AS BIGINT) AS bytes
FROM (SELECT url FROM {UL()} UNION SELECT url FROM pages UNION SELECT image_url FROM {DI()}) w JOIN pages p USING (url)
""")
def content_by_url(spark, sf_dir):
    """Stored content of every URL that the crawl tables mention (requests,
    pages, images), loaded from the page index; unknown URLs have no row."""
    pages = table(spark, sf_dir, "pages")
    index = PageIndex(spark, scratch_path(spark, "page-store"))
    index.add(pages.select("url", "html"))
    wanted = (FX.url_log(spark, sf_dir).select("url").unionByName(pages.select("url"))
              .unionByName(FX.discovered_images(spark, sf_dir).select(F.col("image_url").alias("url"))))
    return index.load(wanted).select("url", F.md5("html").alias("content_md5"),
                                     F.octet_length("html").cast("bigint").alias("bytes"))


@register("page_corpus_by_host", f"""
SELECT domain, CAST(crawl_depth AS INTEGER) AS depth, page_id AS n, bytes,
       domain || '_' || CAST(crawl_depth AS VARCHAR) || '_' || CAST(page_id AS VARCHAR) || '.html' AS file_name
FROM {CP()}
""")
def page_corpus_by_host(spark, sf_dir):
    """Page corpus sink partitioned by host (real host, not
    the scheme prefix the source used); S7 decodes the
    ``{{domain}}_{{depth}}_{{n}}.html`` name back into columns."""
    path = scratch_path(spark, "page_corpus")
    cp = FX.crawled_pages(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    corpus = cp.join(pages, "page_id").select(
        "domain", F.format_string("%s_%d_%d.html", "domain", "crawl_depth", "page_id").alias("file_name"),
        "url", "html")
    FS.write_page_files(corpus, path)
    back = spark.read.parquet(path)
    d, depth, n = FS.decode_page_file_name("file_name")
    return back.select(d.alias("domain"), depth.alias("depth"), n.alias("n"),
                       F.octet_length("html").cast("bigint").alias("bytes"), "file_name")


@register("page_file_listing", f"""
SELECT domain, CAST(crawl_depth AS INTEGER) AS depth, page_id AS n, bytes,
       domain || '_' || CAST(crawl_depth AS VARCHAR) || '_' || CAST(page_id AS VARCHAR) || '.html' AS name
FROM {CP()}
""")
def page_file_listing(spark, sf_dir):
    """One file a page, written under its name; domain, depth, number and size
    come from the listing, the files are not opened."""
    path = _stored_pages(spark, sf_dir)
    # a text file ends with a line feed
    return FS.list_pages(spark, path).select("domain", "depth", "n", (F.col("bytes") - 1).alias("bytes"), "name")


def _stored_pages(spark, sf_dir) -> str:
    path = scratch_path(spark, "page_files")
    name = F.format_string("%s_%d_%d.html", "domain", "crawl_depth", "page_id").alias("file_name")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    unique = pages.groupBy("page_id").count().where("count > 1 AND page_id IS NOT NULL").isEmpty()
    if unique:  # a page's name is made of its own row, so nothing is joined
        FS.write_page_folders(FX.crawled_pages(spark, sf_dir, "html").where("page_id IS NOT NULL").select(name, "html"), path, unique=True)
    else:
        names = FX.crawled_pages(spark, sf_dir).select("page_id", name)
        FS.write_page_folders(names.join(pages, "page_id"), path)
    return path


@register("file_retention", f"""
SELECT 'an hour old' AS age, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS bytes_freed, count(*) AS kept FROM {CP()}
UNION ALL SELECT 'two days old', count(*), CAST(coalesce(sum(bytes + 1), 0) AS BIGINT), 0 FROM {CP()}
""")
def file_retention(spark, sf_dir):
    """A24 over real files: a day's retention by the modification times of the
    listing, an hour and two days after the newest file."""
    listed = FS.list_pages(spark, _stored_pages(spark, sf_dir)).select(F.unix_timestamp("modified").alias("modified"), "bytes")
    newest = listed.agg(F.max("modified")).first()[0] or 0
    return (retention(listed, "modified", "bytes", newest + 3600, 86_400).select(F.lit("an hour old").alias("age"), "*")
            .unionByName(retention(listed, "modified", "bytes", newest + 2 * 86_400, 86_400).select(F.lit("two days old").alias("age"), "*")))


_BUSY = f"(SELECT to_timestamp({FX.EPOCH0} + event_id // 3 + event_id // 100 * 5)::TIMESTAMP AS ts, CAST(user_id % 8 AS VARCHAR) AS thread FROM events)"


@register("log_lines_per_second", f"""
WITH c AS (SELECT ts AS second, count(*) AS lines FROM {_BUSY} GROUP BY ts)
SELECT strftime(second, '%Y-%m-%d %H:%M:%S') AS second, coalesce(lines, 0) AS lines
FROM (SELECT unnest(generate_series((SELECT min(second) FROM c), (SELECT max(second) FROM c), INTERVAL 1 SECOND)) AS second)
LEFT JOIN c USING (second)
""")
def log_lines_per_second(spark, sf_dir):
    """Lines of the processing log per second, seconds without a line included."""
    path = scratch_path(spark, "busy_log")
    FX.crawl_log_lines(spark, sf_dir, busy=True).write.text(path)
    per = LG.lines_per_second(LG.parse_processing_log(spark.read.text(path)))
    return per.select(F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"), "lines")


@register("log_worker_sessions", f"""
WITH d AS (SELECT *, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY thread ORDER BY ts), ts) > 3, true) AS starts FROM {_BUSY}),
s AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY thread ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM d)
SELECT thread, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS lines
FROM s GROUP BY thread, session
""")
def log_worker_sessions(spark, sf_dir):
    """Stretches of work per worker thread, split at pauses of over three seconds."""
    path = scratch_path(spark, "busy_log")
    FX.crawl_log_lines(spark, sf_dir, busy=True).write.text(path)
    sessions = LG.worker_sessions(LG.parse_processing_log(spark.read.text(path)))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions.select("thread", stamp("first_ts"), stamp("last_ts"), "lines")


def _level_case(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in LEVEL_OF_TYPE.items()) + " END"


@register("processing_log_stats", """
SELECT CAST(user_id % 6 AS INTEGER) AS depth, CAST(user_id % 8 AS VARCHAR) AS thread,
       count(*) AS lines, count(DISTINCT 'https://h' || CAST(user_id AS VARCHAR) || '.example.com/' || event_type) AS urls
FROM events GROUP BY 1, 2
""")
def processing_log_stats(spark, sf_dir):
    """S10 + A19: simulator-format log written as text, scanned and parsed;
    lines and distinct URLs per depth and worker thread."""
    path = scratch_path(spark, "processing_log")
    FX.crawl_log_lines(spark, sf_dir).write.mode("overwrite").text(path)
    parsed = LG.parse_processing_log(spark.read.text(path))
    return parsed.groupBy("depth", "thread").agg(F.count("*").alias("lines"), F.countDistinct("url").alias("urls"))


@register("level_log_counts", f"""
SELECT level, CAST(rank AS INTEGER) AS level_rank, count(*) AS lines, count(DISTINCT hour) AS hours FROM (
  SELECT {_level_case('event_type')} AS level,
         list_position(['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL'], {_level_case('event_type')}) - 1 AS rank,
         date_trunc('hour', ts) AS hour FROM events)
WHERE rank >= 2 GROUP BY 1, 2
""")
def level_log_counts(spark, sf_dir):
    """S11 + F18: level-format log, lines at WARNING or above per level."""
    path = scratch_path(spark, "level_log")
    e = table(spark, sf_dir, "events")
    lvl = F.create_map(*[F.lit(x) for kv in LEVEL_OF_TYPE.items() for x in kv])[F.col("event_type")]
    lines = e.select(F.format_string("%s [%s] %s event %d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), lvl,
                                     "event_type", "event_id").alias("value"))
    lines.write.mode("overwrite").text(path)
    parsed = LG.at_least(LG.parse_level_log(spark.read.text(path)), "WARNING")
    return parsed.groupBy("level", "level_rank").agg(
        F.count("*").alias("lines"), F.countDistinct(F.date_trunc("hour", "ts")).alias("hours"))


@register("ctime_error_log", """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1
""")
def ctime_error_log(spark, sf_dir):
    """``[Www Mmm d hh:mm:ss yyyy] ERROR: msg`` lines (ctime pads the
    day with a space), parsed back; errors per day."""
    path = scratch_path(spark, "ctime_log")
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    stamp = F.concat_ws(" ", F.date_format("ts", "EEE MMM"), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
                        F.date_format("ts", "HH:mm:ss yyyy"))
    lines = e.select(F.concat(F.lit("["), stamp, F.lit("] "),
                              F.when(F.col("event_type") == "error", F.lit("ERROR: ")).otherwise(F.lit("")),
                              F.col("event_type")).alias("value"))
    lines.write.mode("overwrite").text(path)
    parsed = LG.parse_ctime_log(spark.read.text(path)).where("is_error")
    return parsed.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("errors"))


@register("sitemap_entries", f"""
SELECT domain, url AS loc, strftime(to_timestamp(ts_epoch), '%Y-%m-%d %H:%M:%S') AS last_modified,
       CAST(CASE WHEN crawl_depth = 0 THEN 1.0 ELSE round(1.0 / (crawl_depth + 1), 1) END AS FLOAT) AS priority,
       'daily' AS change_frequency FROM {CP()}
""")
def sitemap_entries(spark, sf_dir):
    """Per-host sitemap documents built from the crawl table, parsed
    back with ``from_xml``; entries of all hosts in one table."""
    cp = FX.crawled_pages(spark, sf_dir)
    entries = cp.select("domain", F.col("url").alias("loc"),
                        F.date_format(F.timestamp_seconds("ts_epoch"), "yyyy-MM-dd'T'HH:mm:ss").alias("lastmod"),
                        F.lit("daily").alias("changefreq"),
                        F.round(F.lit(1.0) / (F.col("crawl_depth") + 1), 1).alias("priority"))
    out = SM.parse_sitemaps(SM.build_sitemaps(entries))
    return out.select("domain", "loc", F.date_format("last_modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"),
                      "priority", "change_frequency")


_ALLOWED = ", ".join(f"'{d}'" for d in CONFIG["filters"]["allowed_domains"])
_EXCL = " OR ".join(f"prefix(path, '{p}')" for p in CONFIG["filters"]["excluded_paths"])
_EXTS = ", ".join(f"'{e}'" for e in CONFIG["filters"]["allowed_extensions"])
_IMGS = " OR ".join(f"suffix(lower(url), '{e}')" for e in CONFIG["filters"]["image_extensions"])
_MAXB = int(CONFIG["crawler"]["max_file_size_mb"] * 1024 * 1024)


_CONFIG_SQL = f"""
  FROM (SELECT page_id, url, html, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
         regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path FROM pages)
WHERE EXISTS (SELECT 1 FROM (SELECT unnest([{_ALLOWED}]) AS d) WHERE host = d OR suffix(host, '.' || d))
  AND NOT ({_EXCL})
  AND (regexp_extract(path, '\\.[^./]*$', 0) = '' OR lower(regexp_extract(path, '\\.[^./]*$', 0)) IN ({_EXTS}))
  AND NOT ({_IMGS})"""


def _config_pages(spark, sf_dir):
    """S15 + F2 + F14 + F15 + F23: a JSON config read back as filter tables;
    pages from allowed domains, not under an excluded path, with an allowed or
    no extension, not images (should-index), and whether they fit the size cap."""
    from pagelake.plans.crawl import domain_filter
    path = scratch_path(spark, "config")
    CFG.write_config(spark, path, CONFIG)
    cfg = CFG.read_config(spark, path)
    lists = CFG.filter_lists(cfg)  # one config document: bounded
    max_bytes = int(cfg.select("crawler.max_file_size_mb").first()[0] * 1024 * 1024)
    pages = table(spark, sf_dir, "pages").withColumn("path", U.urlparse_path("url"))
    excluded = F.lit(False)
    for prefix in lists["excluded_paths"]:
        excluded = excluded | F.col("path").startswith(prefix)
    ext = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    is_img = F.lit(False)
    for e in lists["image_extensions"]:
        is_img = is_img | F.lower("url").endswith(e)
    kept = domain_filter(pages, "url", CFG.filter_table(cfg, "allowed_domains"), "suffix").where(
        ~excluded & ((ext == "") | ext.isin(*lists["allowed_extensions"])) & ~is_img)
    return kept.withColumn("bytes", F.octet_length("html").cast("bigint")).withColumn("fits", F.col("bytes") <= max_bytes)


@register("config_filtered_pages", f"SELECT page_id, url {_CONFIG_SQL} AND strlen(html) <= {_MAXB}")
def config_filtered_pages(spark, sf_dir):
    """F16: the configured pages within the size cap."""
    return _config_pages(spark, sf_dir).where("fits").select("page_id", "url")


@register("config_refused_pages", f"SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS bytes {_CONFIG_SQL} AND strlen(html) > {_MAXB}")
def config_refused_pages(spark, sf_dir):
    """F16: the side table of the pages that the size cap refuses."""
    return _config_pages(spark, sf_dir).where("NOT fits").select("page_id", "url", "bytes")
