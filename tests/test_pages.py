"""The page-file data source: pushed filters, skipped pages, odd values, any session time zone."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import adapters as ad
from corpusloom.sources import pages

ROWS = "name string, full_path string, parent_path string, extension string, kind string, size long, modified_at timestamp, attributes int"


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    where = f"file://{tmp_path}/pages"
    pages.export(ad.catalog(spark, sf_dir).drop("path_key"), where, "full_path", page=40)
    return where


def test_filters_are_pushed_and_pages_skipped(spark, sf_dir, folder, capsys):
    rows = pages.read(spark, folder, "catalog", push=True)
    assert pages.read(spark, folder, "catalog").count() == ad.catalog(spark, sf_dir).count()
    wanted = rows.filter((F.col("kind") == "file") & (F.col("size") > 100) & F.col("extension").isin("md", "txt") & (F.length("name") > 3))
    wanted.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(kind,file)" in plan and "GreaterThan(size,100)" in plan and "In(extension, [md,txt])" in plan
    assert "Condition : (length(name" in plan  # all that is left for Spark
    plain = ad.catalog(spark, sf_dir).drop("path_key").filter((F.col("kind") == "file") & (F.col("size") > 100) & F.col("extension").isin("md", "txt") & (F.length("name") > 3))
    assert sorted(map(tuple, wanted.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_and_nulls_in_any_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        made = spark.createDataFrame([("a", "p\\a", "p", "", "file", 1, None, 1), ("é\n\"b", "p\\b", "p", None, "file", None, None, None), (None, "p\\c", "p", "x", "folder", 5, None, 16)], ROWS)
        made = made.withColumn("modified_at", F.when(F.col("size") == 5, F.lit("2024-03-10 02:30:00").cast("timestamp")))
        where = f"file://{tmp_path}/{zone[:2]}"
        pages.export(made, where, "full_path", page=1)
        rows = pages.read(spark, where, "catalog")
        assert sorted(map(str, rows.collect())) == sorted(map(str, made.collect()))
        for condition in ("modified_at = timestamp'2024-03-10 02:30:00'", "modified_at is null", "size is not null and size <> 5", "size <= 1", "extension = ''", "name > 'b'", "modified_at < timestamp'2024-03-10 02:30:00'", "attributes in (1, 16)", "extension is null or size = 1"):
            for frame in (rows, pages.read(spark, where, "catalog", push=True)):
                assert sorted(map(str, frame.filter(condition).collect())) == sorted(map(str, made.filter(condition).collect())), condition
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_envelopes():
    span = {"least": "b", "most": "d"}
    for kind, value, held in ((pages.EqualTo, "c", True), (pages.EqualTo, "e", False), (pages.In, ("a", "d"), True), (pages.In, (None, "a"), False), (pages.GreaterThan, "d", False), (pages.GreaterThanOrEqual, "d", True), (pages.LessThan, "b", False), (pages.LessThanOrEqual, "b", True), (pages.StringStartsWith, "dd", False), (pages.StringStartsWith, "c", True), (pages.IsNull, None, True), (pages.IsNotNull, None, True)):
        assert pages._may_hold(span, kind, value, False) is held, (kind, value)
    assert not pages._may_hold({}, pages.EqualTo, "c", False) and pages._may_hold(None, pages.EqualTo, "c", False)


def test_mailbox_and_nothing(spark, sf_dir, tmp_path):
    mails = ad.messages(spark, sf_dir).withColumns({"recipients": F.lit("a; b"), "attachment_names": F.lit(None).cast("string"), "item_class": F.lit(43)})
    where = f"file://{tmp_path}/mail"
    pages.export(mails, where, "ts")
    got = pages.read(spark, where, "mailbox")
    assert got.count() == mails.count() and got.filter("folder = 'Inbox'").count() == mails.filter("folder = 'Inbox'").count()
    pages.export(mails.limit(0), f"file://{tmp_path}/none", "ts")
    assert pages.read(spark, f"file://{tmp_path}/none", "mailbox").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        pages.read(spark, where, "other").count()
