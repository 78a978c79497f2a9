import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import campaigns, evaluation, facts, labels
from tallyloom.sources import feeds


def test_filter_takes_no_null_dates_and_any_text(spark):
    day = datetime.date(2024, 5, 1)
    df = spark.createDataFrame([(1, None, "active", "A", None, day, None), (2, 1, "active", "sale", "x", day, day), (3, None, "expired", "SALE", "x", day, day), (4, None, "active", None, "big Sale", None, day)], "id long, parent_id long, status string, title string, description string, start_date date, end_date date")
    ids = lambda w: [r.id for r in campaigns.campaign_filter(df, w).orderBy("id").collect()]
    assert ids(campaigns.Wanted()) == [1, 4]
    assert ids(campaigns.Wanted(search="sale", with_children=True, with_expired=True)) == [2, 3, 4]
    assert ids(campaigns.Wanted(start_after="2024-01-01")) == [1]
    assert ids(campaigns.Wanted(status="expired")) == [3]


def test_pages_beyond_the_list_are_empty_and_sizes_bounded(spark):
    df = spark.range(250)
    assert campaigns.paged(df, [F.col("id")], 9, 50).count() == 0
    rows = campaigns.paged(df, [F.col("id")], 0, 1000).collect()
    assert len(rows) == 100 and {(r.total, r.total_pages) for r in rows} == {(250, 3)}


def test_nothing_is_deleted_unverified(spark):
    df = spark.range(4).withColumnRenamed("id", "key")
    with pytest.raises(PermissionError):
        campaigns.guarded_delete({"t": df}, df, "key", verified=False)
    left, report = campaigns.guarded_delete({"t": df}, df.filter("key < 3"), "key", verified=False, dry=True)
    assert left["t"].count() == 4 and [tuple(r) for r in report.collect()] == [("t", 4, 3)]


def test_packed_sitemaps_and_references(spark):
    xml = b"<urlset><url><loc>https://a.example/x&amp;lt;</loc></url><url><loc>https://a.example/y&lt;</loc>"
    packed = gzip.compress(xml)
    df = spark.createDataFrame([(packed,), (packed[: len(packed) // 2],), (b"\x1f\x8bnone",), (xml,), (None,)], "content binary")
    got = df.select(feeds.decoded(F.col("content")).alias("xml"))
    assert [r.xml for r in got.collect()][0::3] == [xml.decode()] * 2
    assert sorted(r.url for r in feeds.sitemap_urls(got).collect()) == ["https://a.example/x&lt;", "https://a.example/y<"]


def test_robots_keep_repeated_addresses(spark):
    urls = spark.createDataFrame([("a", "/x"), ("a", "/x"), ("a", "/xy"), (None, "/x"), ("b", None)], "host string, path string")
    rules = spark.createDataFrame([("a", "/x", False), ("a", "/xy", True)], "host string, rule string, allow boolean")
    got = sorted((r.host or "", r.path or "", r.robots_allowed) for r in feeds.robots_allowed(urls, rules).collect())
    assert got == [("", "/x", True), ("a", "/x", False), ("a", "/x", False), ("a", "/xy", True), ("b", "", True)]


def test_known_keys_without_content_are_not_new(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k long, c string")
    new = spark.createDataFrame([(1, "x"), (2, "a"), (3, None), (4, None)], "k long, c string")
    assert {r.k: r.change for r in facts.change_status(old, new, ["k"], "c").collect()} == {1: "updated", 2: "unchanged", 3: "unchanged", 4: "new"}


def test_report_is_a_bounded_table(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "n long, t string")
    report = evaluation.markdown(df, "Names", ["n"], rows=2)
    assert report.splitlines()[2:] == ["| n | t |", "|-|-|", "| 1 | a\\|b |", "| 2 | — |", "", "More than 2 rows."]


def test_numbers_sms_and_coupons_in_text(spark):
    df = spark.createDataFrame([("Katılmak için “YAKIT” yazıp 6026’ya gönderin; Sepet: yaz25 kodunu girin.",), ("kodu yazıp 6026'ya gönderin",), ("bir",), (None,)], "t string")
    word, to = text.sms_entry(F.col("t"))
    assert [tuple(r) for r in df.select(word, to, text.coupon_code(F.col("t"))).collect()] == [("YAKIT", "6026", "yaz25"), (None, None, None), (None, None, None), (None, None, None)]
    said = spark.createDataFrame([("Tutar 5.000 TL, 3 ay, 48 taksit [496]", "5000 tl ve 24 ay"), ("", None), (None, "1")], "a string, c string")
    assert [r[0] for r in said.select(labels.unverified_numbers(F.col("a"), F.col("c"))).collect()] == [["48"], [], None]
