import hashlib

import pytest
from pyspark.sql import functions as F

from sluice.functions import scalars as s
from sluice.sources import tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "repaired"),
    [("2014-05-00", "2014-05-01"), ("2014-00-00 12:30:00", "2014-01-01 12:30:00"), ("0000-00-00", "1970-01-01"), ("2014-05-20", "2014-05-20"), ("text", "text")],
)
def test_partial_dates(spark, text, repaired):
    assert one(spark, s.repair_partial_date(F.lit(text))) == repaired
    assert one(spark, s.partial_date_value(F.lit(text), True)) == (text if text == repaired else None)
    assert one(spark, s.load_value(F.lit(text), False, True)) == ("1970-01-01" if text == "0000-00-00" else text)


def test_text(spark):
    assert one(spark, s.sanitize_cell(F.lit('a\r\nb\x1f"c"^'))) == "a b 'c' "
    assert one(spark, s.ascii_fold(F.lit("“x”–y é z"))) == "'x'-y  z"
    assert one(spark, s.normalize_text(F.lit("abcdef"), 3)) == "abc"
    assert one(spark, s.stream_row([F.lit("a"), F.lit(None).cast("string")], F.lit(True))) == "a\x1f\\N\x1f1"


def test_logs_and_schedules(spark):
    lag = lambda a, b: one(spark, s.log_file_lag(F.lit(a), F.lit(b)))
    assert (lag("bin.000184", "bin.000184"), lag("bin.000181", "bin.000184"), lag("bin.000185", "bin.000184"), lag("x.1", "y.2"), lag("bin", "bin.1")) == (0, 3, 0, None, None)
    status = lambda a, n=3: one(spark, s.checkpoint_status(F.lit(a), F.lit("b.2"), F.lit("b.4"), F.lit(n)))
    assert [status("b.3"), status("b.1"), status(None), status("b.3", 0)] == ["available", "purged", "missing", "no_binlogs"]
    assert one(spark, s.jitter(F.lit("t"), 1000)) == int.from_bytes(hashlib.sha256(b"t").digest()[:8], "big") % 1000
    assert one(spark, s.retry_delay(F.lit(5), F.lit(9))) == 320
    assert one(spark, s.activity_class(F.lit(7200))) == "warm" and one(spark, s.activity_class(F.lit(None).cast("long"))) == "unknown"
    assert one(spark, s.metric_key(F.lit(" Iceberg-Sink A "))) == "iceberg_sink_a" and one(spark, s.metric_key(F.lit(" "))) == "unknown"


def test_times_and_casts(spark):
    for text in ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05.000000", "2024-01-02 03:04:05"):
        assert str(one(spark, s.parse_time(F.lit(text)))) == "2024-01-02 03:04:05"
    assert one(spark, s.parse_time(F.lit("x"))) is None
    assert one(spark, s.to_int(F.lit("12.9"))) == 12 and one(spark, s.to_bool(F.lit("2"))) is True


def test_maintenance_rules(spark):
    due = lambda *a: one(spark, s.compaction_due(*map(F.lit, a)))
    mib = 1 << 20
    assert [due(0, 0, 57, 0), due(0, 0, 0, 25), due(0, 0, 0, 24), due(200, 0, 0, 0), due(199, 0, 49, 0), due(10, 256 * mib, 0, 0)] == [True, True, False, True, False, True]
    route = lambda *a: one(spark, s.compaction_route(*map(F.lit, a)))
    assert [route(0, 400 * mib, 50), route(0, 513 * mib, 1), route(0, 0, 251), route(100, 0, 0), route(101, 0, 0)] == [None, "bytes", "files", None, "equality_deletes"]
    assert one(spark, s.escalated_profile(F.lit("small"), F.lit(True), F.lit(3))) == "large"
    assert one(spark, s.same_storage(F.lit("s3://a/x"), F.lit("s3://a/y"))) and not one(spark, s.same_storage(F.lit("s3://b/x"), F.lit("s3://a/y")))


def test_bucket_is_murmur3(spark):
    # the published test vector of the bucket transform: 34 as a long hashes to 2017239379
    assert one(spark, s.murmur3_long(F.lit(34).cast("long"))) == 2017239379
    assert one(spark, s.partition_transform("bucket", F.lit(34), 16)) == (2017239379 & 0x7FFFFFFF) % 16


def test_plain_functions(monkeypatch):
    assert [s.parse_byte_size(x) for x in ("128 MiB", "1.5kb", "7", "")] == [128 << 20, 1536, 7, 0]
    with pytest.raises(ValueError):
        s.parse_byte_size("-1")
    monkeypatch.setenv("A", "b")
    assert s.expand_environment("${A} ${NOT_SET_X}") == "b ${NOT_SET_X}"
    assert s.safe_column_names(["a b", "A_B", "**", "ok"]) == ["a_b", "A_B_2", "col_3", "ok"]
    assert s.quote_identifier("a`b") == "`a``b`" and s.quote_text("a'b") == "'a''b'"


def test_tables(spark):
    listed = {"app": ["tbl_a", "tbl_b", "other"]}
    assert tables.expand_tables(["app.tbl_*", "APP.TBL_A", "app.other"], lambda x: listed[x.lower()]) == [("app", "tbl_a"), ("app", "tbl_b"), ("app", "other")]
    with pytest.raises(ValueError):
        tables.expand_tables(["app.zzz*"], lambda x: listed[x])
    assert tables.setting_for({"app.*": 1, "app.tbl_?": 2, "tbl_b": 3}, "app", "tbl_a") == 2 and tables.setting_for({"app.*": 1, "tbl_b": 3}, "app", "tbl_b") == 3
    assert tables.warehouse_target("a", "t", {"a.*": "db.*"}, None) == ("db", "t") and tables.selection([], ["d"], ["x", "X"]) == ["d.x"]
    assert tables.truncated("a.b", ["a.*"], ["a.c"], True) and not tables.truncated("a.c", ["a.*"], ["a.c"], True)
    with pytest.raises(ValueError):
        tables.truncated("a.b", ["a.*"], [], False)
    with pytest.raises(ValueError):
        tables.base_tables([("a", "v")], lambda *_: "VIEW")
