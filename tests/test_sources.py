"""Log parsers, sitemap round trip, metadata CSV, HTTP predicates."""

import os
import tempfile

from pyspark.sql import functions as F

from pagelake.functions import http as HT
from pagelake.sources import files as FS
from pagelake.sources import logs as LG
from pagelake.sources import sitemap as SM


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_processing_log(spark):
    df = lines(spark, ["2025-04-20 19:29:11 [Thread 19904] Processing URL: https://x.org/faq (depth: 2)",
                       "garbage"])
    r = LG.parse_processing_log(df).collect()
    assert len(r) == 1 and r[0].thread == "19904" and r[0].depth == 2 and r[0].url == "https://x.org/faq"


def test_level_log_threshold(spark):
    df = lines(spark, ["2025-01-01 00:00:00 [INFO] a", "2025-01-01 00:00:01 [ERROR] b",
                       "2025-01-01 00:00:02 [CRITICAL] c", "2025-01-01 00:00:03 [DEBUG] d"])
    got = [r.level for r in LG.at_least(LG.parse_level_log(df), "WARNING").orderBy("ts").collect()]
    assert got == ["ERROR", "CRITICAL"]


def test_ctime_log_space_padded_day(spark):
    df = lines(spark, ["[Sun Apr  6 19:29:11 2025] ERROR: boom", "[Sun Apr 20 09:00:00 2025] ok"])
    r = LG.parse_ctime_log(df).orderBy("ts").collect()
    assert [x.ts.day for x in r] == [6, 20] and [x.is_error for x in r] == [True, False]
    assert r[0].message == "boom"


def test_sitemap_round_trip(spark):
    e = spark.createDataFrame([("h", "http://h/a?x=1&y=2", "2024-01-01T00:00:00", "daily", 0.5)],
                              "domain string, loc string, lastmod string, changefreq string, priority double")
    r = SM.parse_sitemaps(SM.build_sitemaps(e)).first()
    assert r.loc == "http://h/a?x=1&y=2" and abs(r.priority - 0.5) < 1e-6 and r.change_frequency == "daily"


def test_metadata_csv_quoted_title(spark):
    path = os.path.join(tempfile.mkdtemp(), "meta")
    df = spark.createDataFrame([("http://h/1", "f1", "Plain, with comma", 1),
                                ("http://h/2", "f2", 'Bad "inner" quote', 2)],
                               "url string, file string, title string, ts long")
    FS.write_metadata_lines(df, path, "url", "file", "title", "ts")
    rows = {r.URL: r for r in FS.read_metadata(spark, path).collect()}
    assert rows["http://h/1"].Title == "Plain, with comma" and rows["http://h/1"]._corrupt_record is None
    assert rows["http://h/2"].Title == 'Bad "inner" quote' and len(rows) == 2
    spark.createDataFrame([("not a metadata line",)], "value string").write.mode("append").text(path)
    bad = FS.read_metadata(spark, path).where("_corrupt_record IS NOT NULL").collect()
    assert [r._corrupt_record for r in bad] == ["not a metadata line"]


def test_page_file_name_decode(spark):
    df = spark.createDataFrame([("/x/www.youtube.com_0_41.html",)], "p string")
    d, depth, n = FS.decode_page_file_name("p")
    r = df.select(d.alias("d"), depth.alias("depth"), n.alias("n")).first()
    assert (r.d, r.depth, r.n) == ("www.youtube.com", 0, 41)


def test_http_predicates(spark):
    df = spark.createDataFrame([
        (200, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", "http://h/a"),
        (404, "Content-Type: image/png\r\n", "http://h/b.PNG"),
        (200, "Content-Type: application/json\r\n", "http://h/c")], "status int, headers string, url string")
    ct = HT.header_content_type("headers")
    r = df.select(HT.is_ok_status("status").alias("ok"), ct.alias("ct"),
                  HT.accepts_body("url", ct).alias("body"), HT.is_supported_type(ct).alias("sup"),
                  HT.is_binary_type(ct).alias("bin")).collect()
    assert [x.ok for x in r] == [True, False, True]
    assert r[0].ct == "text/html; charset=utf-8"
    assert [x.body for x in r] == [True, True, False]
    assert [x.sup for x in r] == [False, False, True]
    assert [x.bin for x in r] == [False, True, False]


def test_page_files_from_the_listing(spark, tmp_path):
    import os
    for i, name in enumerate(["a.example.com_2_17.html", "b_c.org_0_3.html", "notes.txt", "x_y.html"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        f = tmp_path / "in" / name
        f.write_bytes(b"x" * (10 + i))
        os.utime(f, (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    listed = FS.list_pages(spark, str(tmp_path))
    assert sorted((r.domain, r.depth, r.n, r.bytes) for r in listed.collect()) == [("a.example.com", 2, 17, 10), ("b_c.org", 0, 3, 11)]
    scan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema:")[1].split("\n")[0]
    from pagelake.operators.limits import retention
    from pyspark.sql import functions as F
    files = FS.list_files(spark, str(tmp_path)).select(F.unix_timestamp("modified").alias("m"), "bytes")
    row = retention(files, "m", "bytes", 1_700_000_350, 200).first()
    assert (row.removed, row.bytes_freed, row.kept) == (2, 21, 2)


def test_page_folders_show_their_names(spark, tmp_path):
    pages = spark.createDataFrame([("h.org_1_5.html", "<p>é"), ("h.org_2_6.html", "")], "file_name string, html string")
    FS.write_page_folders(pages, str(tmp_path / "out"))
    assert sorted((r.name, r.bytes) for r in FS.list_pages(spark, str(tmp_path / "out")).collect()) == [("h.org_1_5.html", 6), ("h.org_2_6.html", 1)]


def test_page_folders_are_written_by_all_tasks(spark, tmp_path):
    """Few bytes, many files: they are not left to one task."""
    pages = spark.createDataFrame([(f"h.org_1_{i}.html", "x") for i in range(60)], "file_name string, html string").coalesce(1)
    FS.write_page_folders(pages, str(tmp_path / "out"))
    files = [r.path for r in FS.list_files(spark, str(tmp_path / "out")).collect() if "part-" in r.path]
    assert len(files) == 60 and len({f.split("part-")[1][:5] for f in files}) > 1


def test_page_folders_are_neither_committed_nor_listed_by_the_driver(spark, tmp_path):
    """Tasks make and list the files: rows of one name are one file, odd names are escaped."""
    rows = [("h.org:80_1_5.html", "a"), ("h.org_2_6.html", "é"), ("h.org_2_6.html", "b"), ("x/y=z_1_7.html", None), (None, "d"), (".h_1_8.html", "")]
    pages = spark.createDataFrame(rows, "file_name string, html string").repartition(3)
    out = tmp_path / "out"
    FS.write_page_folders(pages, str(out))
    assert all(x.name.startswith("part-") and len(x.name) == 10 for x in out.iterdir())
    (out / "_part-00000-9").mkdir()  # of an attempt that did not end
    (out / "_part-00000-9" / "h.org_9_9.html").write_text("x")
    files = FS.list_files(spark, str(out))
    assert "FileScan binaryFile" not in files._jdf.queryExecution().executedPlan().toString()
    want = [(".h_1_8.html", 1), ("__HIVE_DEFAULT_PARTITION__", 2), ("h.org%3A80_1_5.html", 2), ("h.org_2_6.html", 5), ("x%2Fy%3Dz_1_7.html", 1)]
    assert sorted((r.name, r.bytes) for r in files.collect()) == want
    assert sorted(r.name for r in FS.list_files(spark, str(out), "{h,x}*_[5-6].html").collect()) == [want[2][0], want[3][0]]
    assert sorted((r.domain, r.depth, r.n) for r in FS.list_pages(spark, str(out)).collect()) == [(".h", 1, 8), ("h.org", 2, 6), ("h.org%3A80", 1, 5), ("x%2Fy%3Dz", 1, 7)]
    FS.write_page_folders(pages.where("file_name = 'h.org_2_6.html'").limit(1), str(out), unique=True)  # replaces the others
    assert [r.name for r in FS.list_files(spark, str(out)).collect()] == ["h.org_2_6.html"]
    FS.write_page_folders(pages.limit(0), str(out))
    assert FS.list_pages(spark, str(out)).count() == 0


def test_seconds_without_lines(spark):
    from pagelake.sources import logs
    lines = [f"2024-01-01 00:00:{s:02d} [Thread {t}] Processing URL: http://h/{s} (depth: 1)" for s, t in
             [(1, 1), (1, 2), (2, 1), (5, 1), (9, 1), (9, 2)]] + ["other"]
    log = logs.parse_processing_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.lines for r in logs.lines_per_second(log).orderBy("second").collect()] == [2, 1, 0, 0, 1, 0, 0, 0, 2]
    got = sorted((r.thread, r.first_ts.second, r.last_ts.second, r.lines) for r in logs.worker_sessions(log).collect())
    assert got == [("1", 1, 5, 3), ("1", 9, 9, 1), ("2", 1, 1, 1), ("2", 9, 9, 1)]
    assert logs.lines_per_second(log.limit(0)).count() == 0
