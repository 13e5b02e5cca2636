"""Keyed-table queries (W1-W5, J1-J12, O1, B1, B2, B4, B5 exact)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.catalog import register
from pagelake.catalog._sql import crawled_pages as CP
from pagelake.catalog._sql import discovered_images as DI
from pagelake.catalog._sql import pre_sql, q, search_domain
from pagelake.catalog._sql import url_log as UL
from pagelake.catalog.extraction import _KEY_SQL, _resolve_strict_sql
from pagelake.functions.html import LINK_ANY_QUOTE_RE
from pagelake.functions.text import SPAM_TERMS
from pagelake.functions import urls as U
from pagelake.operators import tables as T
from pagelake.operators import visited as V
from pagelake.operators.extract import link_edges, page_records, page_titles
from pagelake.plans import fixtures as FX
from pagelake.session import table


@register("conversation_first_turn", """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1
""")
def conversation_first_turn(spark, sf_dir):
    """W1 insert-or-ignore: the first row per key (by turn) wins."""
    c = table(spark, sf_dir, "conversations")
    return T.insert_or_ignore(c, "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("conversation_last_turn", """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1
""")
def conversation_last_turn(spark, sf_dir):
    """W2 upsert: the last row per key wins."""
    c = table(spark, sf_dir, "conversations")
    return T.upsert_last(c, "conv_id", "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@register("url_first_seen", f"""
SELECT url, event_id AS first_event, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS rn FROM {UL()}) WHERE rn = 1
""")
def url_first_seen(spark, sf_dir):
    """W1/B4/ST1 batch: URL table keyed by URL, first visit wins."""
    log = FX.url_log(spark, sf_dir).select("url", "event_id", "event_type")
    return T.insert_or_ignore(log, "url", "event_id").select("url", F.col("event_id").alias("first_event"), "event_type")


@register("conversation_row_ids", """
SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) AS BIGINT) AS id, conv_id, turn FROM conversations
""")
def conversation_row_ids(spark, sf_dir):
    """W3 autoincrement ids in (conv_id, turn) order, computed distributed."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return T.with_global_rank(c, ["conv_id", "turn"], "id").select(F.col("id").cast("bigint"), "conv_id", "turn")


_ALLOWED_HOSTS = ["example.com", "example.org"]
_HOST_OK = " OR ".join(f"contains({search_domain('target')}, {q(d)})" for d in _ALLOWED_HOSTS)
_RESOLVED_LINKS = f"""(SELECT page_id, url, pos, {_resolve_strict_sql('href')} AS target
    FROM (SELECT page_id, url, unnest(l) AS href, unnest(range(len(l))) AS pos
          FROM (SELECT page_id, url, regexp_extract_all(html, {q(LINK_ANY_QUOTE_RE)}, 1) AS l FROM pages)))"""


@register("fanout_first5", f"""
SELECT page_id, CAST(pos AS BIGINT) AS pos, target FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM {_RESOLVED_LINKS}
  WHERE (prefix(target, 'http://') OR prefix(target, 'https://')) AND strlen(target) > 8
    AND target NOT IN (SELECT url FROM pages) AND ({_HOST_OK}))
WHERE rn <= 5
""")
def fanout_first5(spark, sf_dir):
    """Per page, the first 5 resolved links that are valid, not visited
    yet and on an allowed domain, in document order: row_number <= 5 runs as a
    WindowGroupLimit before the window sort."""
    from pyspark.sql import Window
    from pagelake.plans.crawl import domain_filter
    pages = table(spark, sf_dir, "pages")
    ok = link_edges(pages, "strict").select("page_id", "pos", "target").where(U.prefix_valid("target"))
    ok = T.not_in(ok, pages.select(F.col("url").alias("target")), "target")
    ok = domain_filter(ok, "target", _ALLOWED_HOSTS, "substring")
    w = Window.partitionBy("page_id").orderBy("pos")
    return (ok.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
            .select("page_id", F.col("pos").cast("bigint").alias("pos"), "target"))


@register("known_urls", f"""
SELECT l.url, l.url IN (SELECT url FROM pages) AS is_page,
       l.url IN (SELECT image_url FROM {DI()}) AS is_image,
       l.url IN (SELECT url FROM pages UNION ALL SELECT image_url FROM {DI()}) AS known,
       coalesce(t.title, '') AS title
FROM (SELECT DISTINCT url FROM (SELECT url FROM {UL()} UNION ALL SELECT url FROM pages
                                UNION ALL SELECT image_url AS url FROM {DI()})) l
LEFT JOIN (SELECT url, min(regexp_extract(html, '<title>([^<]+)</title>', 1)) AS title FROM pages GROUP BY url) t
  USING (url)
""")
def known_urls(spark, sf_dir):
    """J1 existence (page / image), B1 any-known = page ∪ image, J2 title
    lookup with default "" — over every URL the crawl tables mention."""
    pages = table(spark, sf_dir, "pages")
    imgs = FX.discovered_images(spark, sf_dir).select(F.col("image_url").alias("url"))
    urls = (FX.url_log(spark, sf_dir).select("url").union(pages.select("url")).union(imgs)).distinct()
    page_keys = pages.select("url").distinct().withColumn("is_page", F.lit(True))
    img_keys = imgs.distinct().withColumn("is_image", F.lit(True))
    titles = (page_titles(pages, keep=("url",)).groupBy("url")
              .agg(F.min(F.when(F.col("title_plain") != "", F.col("title_plain"))).alias("title")))
    out = (urls.join(page_keys, "url", "left").join(img_keys, "url", "left")
           .withColumns({"is_page": F.coalesce("is_page", F.lit(False)),
                         "is_image": F.coalesce("is_image", F.lit(False))}))
    out = out.withColumn("known", F.col("is_page") | F.col("is_image"))
    return T.lookup(out, titles, "url", "title", "")


@register("mark_visited_urls", f"""
SELECT u.url, u.url IN (SELECT url FROM pages) AS visited FROM (SELECT DISTINCT url FROM {UL()}
  UNION SELECT url FROM pages) u
""")
def mark_visited_urls(spark, sf_dir):
    """URL state table (every URL seen, visited = false) updated by the
    fetched pages; rows not in the table are not created."""
    pages = table(spark, sf_dir, "pages")
    urls = (FX.url_log(spark, sf_dir).select("url").union(pages.select("url")).distinct()
            .withColumn("visited", F.lit(False)))
    updated, _ = T.mark_visited(urls, pages.select("url"))
    return updated.select("url", "visited")


@register("mark_visited_outcomes", f"""
WITH known AS (SELECT DISTINCT target AS url FROM {_RESOLVED_LINKS} UNION SELECT url FROM pages WHERE page_id % 2 = 0),
done AS (SELECT url FROM pages UNION SELECT url FROM {UL()})
SELECT url, CASE WHEN url IN (SELECT url FROM done) THEN 'marked' ELSE 'untouched' END AS outcome FROM known
UNION ALL SELECT url, 'unmatched' FROM done WHERE url NOT IN (SELECT url FROM known)
""")
def mark_visited_outcomes(spark, sf_dir):
    """J3 in full: what marking did to each row of a URL table (link targets and
    half of the pages), and the finished URLs that the table does not have."""
    pages = table(spark, sf_dir, "pages")
    known = (link_edges(pages, "strict").select(F.col("target").alias("url"))
             .unionByName(pages.where("page_id % 2 = 0").select("url")).distinct().withColumn("visited", F.lit(False)))
    done = pages.select("url").unionByName(FX.url_log(spark, sf_dir).select("url"))
    updated, unmatched = T.mark_visited(known, done)
    return (updated.select("url", F.when(F.col("visited"), "marked").otherwise("untouched").alias("outcome"))
            .unionByName(unmatched.select("url", F.lit("unmatched").alias("outcome"))))


@register("url_lookups", f"""
WITH asked AS (SELECT DISTINCT url FROM (SELECT url FROM {UL()} UNION ALL SELECT url FROM pages UNION ALL SELECT image_url FROM {DI()})),
page AS (SELECT url, min({_KEY_SQL}) AS path FROM pages GROUP BY url),
image AS (SELECT image_url AS url, min('images/' || md5(image_url) || '.' || image_type) AS path FROM {DI()} GROUP BY image_url)
SELECT a.url, coalesce(p.path, '') AS path, coalesce(i.path, '') AS image_path, p.url IS NOT NULL AS visited
FROM asked a LEFT JOIN page p USING (url) LEFT JOIN image i USING (url)
""")
def url_lookups(spark, sf_dir):
    """Page path, image path and visited flag of every URL mentioned, with the
    defaults "" and false for unknown ones."""
    pages = table(spark, sf_dir, "pages")
    images = FX.discovered_images(spark, sf_dir)
    asked = (FX.url_log(spark, sf_dir).select("url").unionByName(pages.select("url"))
             .unionByName(images.select(F.col("image_url").alias("url"))).distinct())
    paths = page_records(pages).groupBy("url").agg(F.min("file_path").alias("path"))
    stored = F.concat(F.lit("images/"), F.md5("image_url"), F.lit("."), "image_type")
    image_paths = images.select(F.col("image_url").alias("url"), stored.alias("image_path")).groupBy("url").agg(F.min("image_path").alias("image_path"))
    out = T.lookup(asked, paths, "url", "path", "")
    out = T.lookup(out, image_paths, "url", "image_path", "")
    return T.lookup(out, pages.select("url").distinct().withColumn("visited", F.lit(True)), "url", "visited", False)


@register("unvisited_first100", f"""
SELECT url FROM (SELECT DISTINCT url FROM {UL()}) WHERE url NOT IN (SELECT url FROM pages)
ORDER BY url LIMIT 100
""")
def unvisited_first100(spark, sf_dir):
    """O1: unvisited URLs in URL order, first 100 (top-k, no global sort)."""
    pages = table(spark, sf_dir, "pages")
    pending = T.not_in(FX.url_log(spark, sf_dir).select("url").distinct(), pages, "url")
    return pending.orderBy("url").limit(100)


_SEEN = f"(SELECT url FROM pages UNION SELECT image_url FROM {DI()})"
_ASKED = f"(SELECT target AS url FROM {_RESOLVED_LINKS} UNION SELECT url FROM {UL()} UNION SELECT url FROM pages)"


def _asked_and_seen(spark, sf_dir):
    """URLs that a crawl asks for, and the two sets it has: pages and images."""
    pages = table(spark, sf_dir, "pages")
    images = FX.discovered_images(spark, sf_dir).select(F.col("image_url").alias("url"))
    links = link_edges(pages, "strict").select(F.col("target").alias("url"))
    asked = links.unionByName(FX.url_log(spark, sf_dir).select("url")).unionByName(pages.select("url")).distinct()
    return asked, pages.select("url").distinct(), images.distinct()


def _both(pages, images):
    """Filter of both sets, merged from one of each; the size follows the total."""
    n = V.buckets_for(pages.count() + images.count())
    return V.VisitedFilter.of(pages, "url", n).merge(V.VisitedFilter.of(images, "url", n))


@register("unvisited_links", f"SELECT url FROM {_ASKED} WHERE url NOT IN (SELECT url FROM {_SEEN})")
def unvisited_links(spark, sf_dir):
    """URLs asked for and neither a page nor an image yet; the merged
    visited filter spares new URLs the anti-join."""
    asked, pages, images = _asked_and_seen(spark, sf_dir)
    return V.new_keys(asked, pages.unionByName(images), "url", _both(pages, images))


def _hex_number(e: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substring(md5({e}), {start}, {digits}) AS BIGINT)"


_PLACES = ", ".join(f"{_hex_number('url', 9 + 4 * i, 4)} % {V.BUCKET_BITS}" for i in range(V.BITS))


@register("visited_filter_report", f"""
WITH seen AS {_SEEN}, asked AS {_ASKED},
size AS (SELECT CAST(pow(2, greatest(0, ceil(log2(n * {V.BITS_PER_KEY} / {V.BUCKET_BITS})))) AS BIGINT) AS buckets
         FROM (SELECT (SELECT count(DISTINCT url) FROM pages) + (SELECT count(DISTINCT image_url) FROM {DI()}) AS n)),
bits AS (SELECT DISTINCT {_hex_number('url', 1, 8)} % buckets AS bucket, unnest([{_PLACES}]) AS place FROM seen, size),
found AS (SELECT url, count(bits.place) = {V.BITS} AS maybe FROM (
            SELECT url, {_hex_number('url', 1, 8)} % buckets AS bucket, unnest([{_PLACES}]) AS place FROM asked, size) a
          LEFT JOIN bits USING (bucket, place) GROUP BY url)
SELECT count(*) AS n_keys, count(*) FILTER (NOT maybe) AS n_passed, count(*) FILTER (maybe) AS n_checked,
       count(*) FILTER (maybe AND url NOT IN (SELECT url FROM seen)) AS n_false,
       count(*) FILTER (NOT maybe AND url IN (SELECT url FROM seen)) AS n_missed
FROM found
""")
def visited_filter_report(spark, sf_dir):
    """What the merged filter saves: keys passed without a join, keys sent on, false
    positives (counted exactly; missed keys are always 0)."""
    asked, pages, images = _asked_and_seen(spark, sf_dir)
    return V.filter_report(asked, pages.unionByName(images), "url", _both(pages, images))


@register("failed_fetches", f"""
SELECT count(*) AS failed, count(DISTINCT url) AS failed_urls
FROM {UL()} WHERE url NOT IN (SELECT url FROM pages)
""")
def failed_fetches(spark, sf_dir):
    """Requested URLs without a snapshot row are failed fetches."""
    pages = table(spark, sf_dir, "pages")
    failed = T.not_in(FX.url_log(spark, sf_dir).select("url"), pages, "url")
    return failed.agg(F.count("*").alias("failed"), F.countDistinct("url").alias("failed_urls"))


@register("child_depths", f"""
SELECT DISTINCT p.url AS parent, p.crawl_depth + 1 AS depth, l.target AS child
FROM {CP()} p JOIN {_RESOLVED_LINKS} l USING (url)
""")
def child_depths(spark, sf_dir):
    """J9 (corrected): a discovered URL's depth is its parent's depth + 1."""
    cp = FX.crawled_pages(spark, sf_dir).select("url", "crawl_depth")
    links = link_edges(table(spark, sf_dir, "pages"), "strict").select("url", "target")
    return (cp.join(links, "url")
            .select(F.col("url").alias("parent"), (F.col("crawl_depth") + 1).alias("depth"),
                    F.col("target").alias("child")).distinct())


@register("delete_spam_pages", f"""
SELECT page_id, url FROM pages WHERE url NOT IN (
  SELECT url FROM pages WHERE regexp_matches({pre_sql('html')}, '{"|".join(SPAM_TERMS)}'))
""")
def delete_spam_pages(spark, sf_dir):
    """Delete pages by URL (here: the spam-flagged ones) as an
    anti-join rewrite of the page table; J10 loads content by URL the same
    way with an inner join."""
    from pagelake.functions.text import is_spam
    pages = table(spark, sf_dir, "pages")
    doomed = pages.where(is_spam(F.col("html"))).select("url")
    return T.not_in(pages, doomed, "url").select("page_id", "url")


@register("new_images_to_store", f"""
SELECT DISTINCT image_url, md5(image_url) AS storage_key FROM {DI()}
WHERE md5(image_url) NOT IN (SELECT md5(url) FROM pages)
  AND md5(image_url) NOT IN (SELECT md5(image_url) FROM {DI()} WHERE image_type = 'png')
""")
def new_images_to_store(spark, sf_dir):
    """Skip images whose storage key is already in the store (here the
    store holds the png-typed images and every page key)."""
    imgs = FX.discovered_images(spark, sf_dir).select("image_url", "image_type",
                                                      F.md5("image_url").alias("storage_key"))
    store = (imgs.where(F.col("image_type") == "png").select("storage_key")
             .union(table(spark, sf_dir, "pages").select(F.md5("url").alias("storage_key"))))
    return T.not_in(imgs, store, "storage_key").select("image_url", "storage_key").distinct()


@register("exact_duplicate_texts", f"""
SELECT md5({pre_sql('text')}) AS text_key, count(*) AS copies, min(doc_id) AS first_doc
FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def exact_duplicate_texts(spark, sf_dir):
    """B5 exact: documents grouped by the md5 of their normalised text."""
    from pagelake.functions.text import preprocess
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(preprocess(F.col("text"))).alias("text_key"))
    return (d.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
            .where(F.col("copies") > 1))


_NEAR = f"""d AS (SELECT doc_id, md5({pre_sql('text')}) AS h,
             list_filter(string_split({pre_sql('text')}, ' '), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT h, min(doc_id) AS doc_id, arg_min(ws, doc_id) AS ws FROM d GROUP BY h),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM u WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS rep_id, b.doc_id, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


@register("near_duplicate_docs", f"""WITH {_NEAR}
SELECT d.doc_id, u.doc_id AS rep_id, 1.0::DOUBLE AS jaccard FROM d JOIN u USING (h) WHERE d.doc_id <> u.doc_id
UNION ALL
SELECT c.doc_id, c.rep_id, round(c.inter::DOUBLE / (x.n + y.n - c.inter), 6)
FROM c JOIN n x ON x.doc_id = c.rep_id JOIN n y ON y.doc_id = c.doc_id WHERE c.inter::DOUBLE / (x.n + y.n - c.inter) >= 0.8
""")
def near_duplicate_docs(spark, sf_dir):
    """B5 near: copies with their representative, and all pairs of
    representatives with a shingle Jaccard similarity of 0.8 or more."""
    from pagelake.operators.dedupe import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rep_id", F.round("jaccard", 6).alias("jaccard"))


@register("near_duplicate_clusters", f"""WITH RECURSIVE {_NEAR},
e AS (SELECT c.rep_id AS a, c.doc_id AS b FROM c JOIN n x ON x.doc_id = c.rep_id JOIN n y ON y.doc_id = c.doc_id
      WHERE c.inter::DOUBLE / (x.n + y.n - c.inter) >= 0.8),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, k.cluster_id FROM d JOIN u USING (h) JOIN (SELECT a, min(b) AS cluster_id FROM r GROUP BY a) k ON k.a = u.doc_id
""")
def near_duplicate_clusters(spark, sf_dir):
    """B5 near: one row per document with its cluster."""
    from pagelake.operators.dedupe import near_duplicate_clusters as clusters
    return clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))
