"""The registered queries on the test tables, and their SQL.

Every time is fixed and every limit has a unique order, so that results are the
same in any engine and run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import apply as ap
from ..operators import changes as ch
from ..operators import maintenance as mt
from ..operators import metrics, ops
from ..operators.schema import sync_schema
from ..sources import snapshot as sn
from ..sources.tables import route

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OPS = "CASE event_type WHEN 'purchase' THEN 'DELETE' WHEN 'click' THEN 'UPDATE' ELSE 'INSERT' END"
FEED = f"SELECT event_id AS pos, user_id AS k, {OPS} AS op, value, ts FROM events"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("k"), F.expr(OPS).alias("op"), "value", "ts")


def moving_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh change gives its key another number."""
    f = feed(spark, sf_dir)
    return f.select("pos", F.col("k").alias("old_k"), F.expr("CASE WHEN pos % 7 = 0 THEN k + 1000 ELSE k END").alias("k"), "op", "value", "ts")


MOVING = f"SELECT pos, k AS old_k, CASE WHEN pos % 7 = 0 THEN k + 1000 ELSE k END AS k, op, value, ts FROM ({FEED})"
TOUCHES = "SELECT pos, 0 AS sub, coalesce(old_k, k) AS k, 'D' AS touch, value FROM f UNION ALL SELECT pos, 1, k, 'U', value FROM f WHERE op <> 'DELETE'"
LIVE = "SELECT k, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC, sub DESC) AS r FROM t) WHERE r = 1 AND touch = 'U'"


@query(f"WITH f AS (SELECT *, NULL::BIGINT AS old_k FROM ({FEED})), t AS ({TOUCHES}) {LIVE}")
def reduce_live_rows(spark, sf_dir):
    return ch.live_rows(feed(spark, sf_dir), ["k"]).select("k", "pos", "value")


@query(f"WITH f AS (SELECT *, NULL::BIGINT AS old_k FROM ({FEED})), t AS ({TOUCHES}) SELECT k, max(pos) AS last_pos, count(*) AS images FROM t WHERE touch = 'D' GROUP BY k")
def reduce_delete_keys(spark, sf_dir):
    return ch.delete_keys(feed(spark, sf_dir), ["k"])


@query(f"WITH f AS ({MOVING}), t AS ({TOUCHES}) {LIVE}")
def reduce_pk_change(spark, sf_dir):
    return ch.live_rows(moving_feed(spark, sf_dir), ["k"]).select("k", "pos", "value")


@query(f"""
    WITH f AS ({MOVING}), t AS ({TOUCHES}), u AS ({LIVE}),
    gone AS (SELECT k FROM t WHERE touch = 'D' UNION SELECT k FROM u)
    SELECT c_custkey AS k, c_acctbal AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.k = c_custkey)
    UNION ALL SELECT k, value FROM u""")
def apply_delta(spark, sf_dir):
    target = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    f = moving_feed(spark, sf_dir)
    return ap.apply_delta(target, ch.delete_keys(f, ["k"]), ch.live_rows(f, ["k"]), ["k"])


@query(f"SELECT k, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS r FROM ({FEED})) WHERE r = 1 AND op <> 'DELETE'")
def merge_marker_load(spark, sf_dir):
    return ch.merge_rows(feed(spark, sf_dir), ["k"]).select("k", "pos", "value")


@query(f"SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS part, k FROM ({FEED})")
def partition_delete_groups(spark, sf_dir):
    return ch.partition_groups(feed(spark, sf_dir), ["k"], s.partition_transform("day", F.col("ts")))


@query("""
    WITH p AS (
      SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
        lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, lag(o_totalprice) OVER w AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_orderkey, CASE WHEN s IS NOT DISTINCT FROM o_orderstatus AND p IS NOT DISTINCT FROM o_orderpriority AND t IS NOT DISTINCT FROM o_totalprice THEN '-' ELSE
      concat_ws(',', CASE WHEN s IS DISTINCT FROM o_orderstatus THEN 'o_orderstatus' END, CASE WHEN p IS DISTINCT FROM o_orderpriority THEN 'o_orderpriority' END, CASE WHEN t IS DISTINCT FROM o_totalprice THEN 'o_totalprice' END) END AS changed
    FROM p""")
def changed_columns(spark, sf_dir):
    from pyspark.sql import Window as W

    columns = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = t(spark, sf_dir, "orders").select("o_orderkey", *columns, *(F.lag(c).over(w).alias("old_" + c) for c in columns))
    return pairs.select("o_orderkey", ch.changed_columns(columns).alias("changed"))


@query(f"SELECT op, event_type, count(*) AS n FROM (SELECT {OPS} AS op, event_type FROM events) GROUP BY ALL")
def batch_delta_counts(spark, sf_dir):
    return t(spark, sf_dir, "events").select(F.expr(OPS).alias("op"), "event_type").groupBy("op", "event_type").agg(F.count("*").alias("n"))


@query("""
    WITH e AS (SELECT user_id AS k, max(ts) AS seen FROM events GROUP BY 1),
    r AS (SELECT k, seen, CASE WHEN k % 3 = 0 THEN seen END AS made, CASE WHEN k % 5 = 0 THEN TIMESTAMP '2019-01-01' END AS created_at FROM e),
    c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2020-01-01' + to_seconds(c_nationkey) END AS old, TIMESTAMP '2021-01-01' AS changed FROM customer WHERE c_custkey % 7 > 0)
    SELECT 'change' AS kind, r.k, CASE WHEN r.created_at IS NOT NULL THEN r.created_at ELSE c.old END AS created_at, r.seen AS updated_at FROM r LEFT JOIN c USING (k)
    UNION ALL SELECT 'snapshot', r.k, CASE WHEN r.created_at IS NOT NULL THEN r.created_at ELSE c.old END, c.changed FROM r LEFT JOIN c USING (k)
    UNION ALL SELECT 'mapped', r.k, r.made, r.seen FROM r""")
def metadata_columns(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("at"))
    rows = rows.select("k", "at", F.when(F.col("k") % 3 == 0, F.col("at")).alias("made"), F.when(F.col("k") % 5 == 0, F.expr("TIMESTAMP_NTZ '2019-01-01'")).alias("created_at"))
    there = F.expr("TIMESTAMP_NTZ '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, c_nationkey)").cast("timestamp_ntz")
    old = t(spark, sf_dir, "customer").where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 > 0, there).alias("created_at"), F.expr("TIMESTAMP_NTZ '2021-01-01'").alias("updated_at"))
    now = F.expr("TIMESTAMP_NTZ '2024-01-01'")
    kinds = {"change": (F.col("at"), None), "snapshot": (None, None), "mapped": (F.col("at"), "made")}
    out = [ap.with_metadata(rows, old, ["k"], loaded_at=now, event_time=at, created_from=made).select(F.lit(k).alias("kind"), "k", "created_at", "updated_at") for k, (at, made) in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def snapshot_scan_filtered(spark, sf_dir):
    df = t(spark, sf_dir, "orders")
    plan = sn.plan_snapshot(df, ["o_orderkey"], "WHERE o_orderstatus = 'O' AND o_totalprice > 1000;", [("o_totalprice * 2", "twice")])
    return sn.snapshot(df, plan).select("o_orderkey", "o_custkey", "o_totalprice", "twice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 50) ORDER BY o_custkey, o_orderkey LIMIT 500")
def snapshot_keyset_page(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sn.page(df, sn.plan_snapshot(df, ["o_custkey", "o_orderkey"]), 500, {"o_custkey": 100, "o_orderkey": 50})


@query("SELECT * FROM supplier ORDER BY s_suppkey, s_name, s_nationkey, s_acctbal LIMIT 20 OFFSET 10")
def snapshot_offset_page(spark, sf_dir):
    df = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return sn.page(df, sn.plan_snapshot(df, []), 20, offset=10)


@query("SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 50) ORDER BY o_custkey, o_orderkey LIMIT 500) ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 1")
def snapshot_cursor_last(spark, sf_dir):
    return sn.last_cursor(snapshot_keyset_page(spark, sf_dir), ("o_custkey", "o_orderkey"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def snapshot_count(spark, sf_dir):
    return t(spark, sf_dir, "orders").where(sn.clean_filter("where o_orderstatus = 'F';")).agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, o_totalprice, 'old' AS src FROM orders WHERE NOT coalesce(o_orderdate >= TIMESTAMP '1996-01-01', false)
    UNION ALL SELECT o_orderkey, o_totalprice + 1, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'O'""")
def replace_filter_append(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    target = orders.select("o_orderkey", "o_totalprice", F.lit("old").alias("src"), "o_orderdate")
    new = orders.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("new").alias("src"), "o_orderdate")
    return ap.replace_where(target, ap.comparison("o_orderdate", "gteq", "1996-01-01 00:00:00", "timestamp_ntz"), new).drop("o_orderdate")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5")
def truncate_append(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return ap.write_snapshot("truncate-append", c.select("c_custkey", "c_name"), c.where("c_nationkey < 5"), ["c_custkey"])


@query("SELECT c_custkey, c_name, 'old' AS src FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_nationkey < 5")
def delete_append(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("old").alias("src"), "c_nationkey")
    new = c.where("c_nationkey < 5").withColumn("src", F.lit("new"))
    return ap.write_snapshot("delete-append", c.drop("c_nationkey"), new, ["c_custkey"])


@query("""
    SELECT r_regionkey, a, b, c, CASE WHEN a THEN 'append' WHEN b THEN 'replace-filter-append' WHEN c THEN 'truncate-append' ELSE 'delete-append' END AS mode
    FROM region, (VALUES (true), (false)) x(a), (VALUES (true), (false)) y(b), (VALUES (true), (false)) z(c)""")
def write_mode_auto(spark, sf_dir):
    flags = F.explode(F.array(F.lit(True), F.lit(False)))
    df = t(spark, sf_dir, "region").select("r_regionkey", flags.alias("a")).select("*", flags.alias("b")).select("*", flags.alias("c"))
    return df.withColumn("mode", ap.write_mode(F.col("a"), F.col("b"), F.col("c")))


@query("""
    SELECT o_orderkey, CAST(64 + 5 * 32 + length('o_orderkey') + 16 + length('o_custkey') + 16 + length('o_orderstatus') + octet_length(encode(o_orderstatus))
      + length('o_totalprice') + 16 + length('o_orderdate') + 24 AS BIGINT) AS bytes FROM orders""")
def byte_estimate(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return df.select("o_orderkey", ap.row_bytes(df).alias("bytes"))


@query("""
    WITH g AS (SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) * 100 AS BIGINT) AS size FROM lineitem GROUP BY 1),
    a AS (SELECT *, CAST(ceil(size / greatest(n, 1)) AS BIGINT) AS average_bytes FROM g)
    SELECT l_returnflag, average_bytes, CASE WHEN size > 134217728 THEN 67108864 END AS group_bytes,
      CASE WHEN size > 134217728 THEN CAST(least(greatest(floor(67108864 / greatest(average_bytes, 1)), 1), 50000) AS BIGINT) ELSE 50000 END AS group_rows,
      least(1000, CASE WHEN size > 134217728 THEN CAST(least(greatest(floor(67108864 / greatest(average_bytes, 1)), 1), 50000) AS BIGINT) ELSE 50000 END) AS read_rows FROM a""")
def write_sizing(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), (F.sum("l_orderkey") * 100).alias("size"))
    return g.withColumns(ap.sizing(F.col("n"), F.col("size"), 128 << 20, 50_000)).drop("n", "size")


RULES = [("STANDARD*", "std"), ("*BRASS", "brass"), ("STANDARD ANODIZED*", "std_anodized"), ("PROMO BURNISHED NICKEL", "exact"), ("*", "other")]


@query("""
    WITH rules(pattern, target) AS (VALUES ('STANDARD*', 'std'), ('*BRASS', 'brass'), ('STANDARD ANODIZED*', 'std_anodized'), ('PROMO BURNISHED NICKEL', 'exact'), ('*', 'other')),
    m AS (SELECT p_partkey, p_type, target, row_number() OVER (PARTITION BY p_partkey ORDER BY strpos(pattern, '*') = 0 DESC, length(replace(pattern, '*', '')) DESC, pattern) AS r
      FROM part JOIN rules ON regexp_full_match(p_type, replace(pattern, '*', '.*')))
    SELECT p_partkey, p_type, coalesce(target, p_type) AS target FROM part LEFT JOIN (SELECT p_partkey, target FROM m WHERE r = 1) USING (p_partkey)""")
def route_targets(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "pattern string, target string")
    return route(t(spark, sf_dir, "part").select("p_partkey", "p_type"), rules, "p_type")


DATES = "CASE l_linenumber % 5 WHEN 0 THEN '0000-00-00' WHEN 1 THEN strftime(l_shipdate, '%Y-%m') || '-00' WHEN 2 THEN strftime(l_shipdate, '%Y') || '-00-00 12:30:00' WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'text' END"


@query(f"""
    WITH d AS (SELECT DISTINCT {DATES} AS d FROM lineitem),
    p AS (SELECT d, regexp_extract(d, '^(\\d{{4}})-(\\d{{2}})-(\\d{{2}})(.*)$', ['y', 'm', 'd', 'rest']) AS x FROM d),
    q AS (SELECT d, x, x.y = '0000' OR x.m = '00' OR x.d = '00' AS partial FROM p)
    SELECT d, partial, CASE WHEN partial THEN (CASE x.y WHEN '0000' THEN '1970' ELSE x.y END) || '-' || (CASE x.m WHEN '00' THEN '01' ELSE x.m END) || '-' || (CASE x.d WHEN '00' THEN '01' ELSE x.d END) || x.rest ELSE d END AS repaired,
      CASE WHEN NOT partial THEN d END AS nullable, d = '0000-00-00' AS zero FROM q""")
def partial_dates(spark, sf_dir):
    fmt = lambda p: F.date_format("l_shipdate", p)
    n = F.col("l_linenumber") % 5
    d = F.when(n == 0, "0000-00-00").when(n == 1, F.concat(fmt("yyyy-MM"), F.lit("-00"))).when(n == 2, F.concat(fmt("yyyy"), F.lit("-00-00 12:30:00"))).when(n == 3, fmt("yyyy-MM-dd")).otherwise("text")
    df = t(spark, sf_dir, "lineitem").select(d.alias("d")).distinct()
    c = F.col("d")
    return df.select("d", s.is_partial_date(c).alias("partial"), s.repair_partial_date(c).alias("repaired"), s.partial_date_value(c, True).alias("nullable"), s.is_zero_date(c).alias("zero"))


@query(r"""
    SELECT doc_id, substr(regexp_replace(translate(translate(regexp_replace(text, '\r\n|\n|\r', ' ', 'g'), chr(31) || '"^', ' '' '), '–—−“”‘’' || chr(160), '---'''''''' '), '[^\x00-\x7F]', '', 'g'), 1, 200) AS body FROM documents""")
def text_normalize(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", s.normalize_text(F.col("text"), 200).alias("body"))


@query("""
    WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) || '.75' WHEN 2 THEN 'text' ELSE 'true' END AS v FROM orders)
    SELECT o_orderkey, coalesce(CASE WHEN regexp_full_match(v, '\\d+') THEN TRY_CAST(v AS BIGINT) END, CAST(trunc(TRY_CAST(CASE WHEN v <> 'true' THEN v END AS DOUBLE)) AS BIGINT)) AS i,
      CASE WHEN v = 'true' THEN true WHEN v = 'text' THEN NULL ELSE TRY_CAST(v AS DOUBLE) <> 0 END AS b, TRY_CAST(v AS DOUBLE) AS d FROM x""")
def type_coercion(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    v = F.when(n == 0, F.col("o_custkey").cast("string")).when(n == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".75"))).when(n == 2, "text").otherwise("true")
    df = t(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    yes = F.col("v").isin("true", "false")
    return df.select("o_orderkey", s.to_int(F.col("v")).alias("i"), F.when(yes, F.col("v").try_cast("boolean")).otherwise(F.col("v").try_cast("double") != 0).alias("b"), F.col("v").try_cast("double").alias("d"))


@query("""
    WITH j AS (SELECT c_custkey, c_name, CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) % 3600 AS BIGINT) AS jitter FROM customer)
    SELECT c_custkey, jitter, 1700000000 + 36000 + jitter AS next_at FROM j""")
def jitter_schedule(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", s.jitter(F.col("c_name"), 3600).alias("jitter"), s.next_run(F.lit(1700000000).cast("long"), 36000, F.col("c_name")).alias("next_at"))


@query("SELECT o_orderkey, sha256('orders.' || o_custkey || '|compact|' || o_orderstatus) AS idempotency_key FROM orders")
def idempotency_keys(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", s.idempotency_key(F.concat(F.lit("orders."), F.col("o_custkey").cast("string")), F.lit("compact"), F.col("o_orderstatus")).alias("idempotency_key"))


@query("SELECT n_nationkey, CAST(500 * pow(2, least(n_nationkey % 10, 6)) AS BIGINT) AS delay_ms FROM nation")
def retry_backoff(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", s.retry_delay(F.lit(500).cast("long"), F.col("n_nationkey") % 10 + 1).alias("delay_ms"))


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'other-bin.' ELSE 'mysql-bin.' END || lpad(CAST(event_id % 500 AS VARCHAR), 6, '0') AS file FROM events)
    SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN greatest(400 - event_id % 500, 0) END AS lag,
      CASE WHEN file < 'mysql-bin.000100' OR file > 'mysql-bin.000400' THEN 'purged' ELSE 'available' END AS status FROM e""")
def binlog_lag_status(spark, sf_dir):
    name = F.concat(F.when(F.col("event_id") % 11 == 0, "other-bin.").otherwise("mysql-bin."), F.lpad((F.col("event_id") % 500).cast("string"), 6, "0"))
    df = t(spark, sf_dir, "events").select("event_id", name.alias("file"))
    first, last = F.lit("mysql-bin.000100"), F.lit("mysql-bin.000400")
    return df.select("event_id", s.log_file_lag(F.col("file"), last).alias("lag"), s.checkpoint_status(F.col("file"), first, last, F.lit(301)).alias("status"))


@query("""
    WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1), m AS (SELECT max(ts) AS now_ts FROM events),
    a AS (SELECT user_id, CAST(floor(epoch(now_ts) - epoch(last_ts)) AS BIGINT) AS age FROM l, m)
    SELECT user_id, CASE WHEN age <= 3600 THEN 'hot' WHEN age <= 86400 THEN 'warm' WHEN age <= 604800 THEN 'cold' ELSE 'stale' END AS activity FROM a""")
def activity_class(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("at"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return last.crossJoin(F.broadcast(now)).select("user_id", s.activity_class((seconds("now") - seconds("at")).cast("long")).alias("activity"))


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, max(event_id) AS most, arg_max(event_id, ts) AS last_value, max(ts) AS last_at FROM events GROUP BY ALL")
def metrics_rollup(spark, sf_dir):
    return metrics.activity(t(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts")


@query("""
    WITH w AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
    SELECT user_id, arg_max(event_id, ts) - arg_min(event_id, ts) AS increase FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def growth_topk(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since")).scalar()
    return metrics.growth(e, "user_id", "event_id", "ts", since).select("user_id", "increase")


STATE = "SELECT c_custkey AS table_key, c_nationkey AS owner, c_custkey * 37 % 1000 AS due, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 900 END AS lease_until FROM customer"
MONITORS = "SELECT n_nationkey AS owner, CASE WHEN n_regionkey < 3 THEN 'active' ELSE 'paused' END AS status FROM nation"
TASKS = "SELECT o_orderkey AS id, o_custkey AS table_key, o_orderkey % 3 AS priority, o_orderkey * 13 % 1000 AS not_before, o_orderkey % 777 AS created_at, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'retry' WHEN '5-LOW' THEN 'failed' ELSE 'succeeded' END AS status, o_orderstatus AS operation, o_custkey % 25 AS owner, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 600 END AS lease_until FROM orders"


def _sql(spark, sf_dir, text: str, name: str) -> DataFrame:
    df = t(spark, sf_dir, name)
    columns = text.removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    depth, parts, at = 0, [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return df.selectExpr(*parts)


def state(spark, sf_dir):
    return _sql(spark, sf_dir, STATE, "customer")


def monitors(spark, sf_dir):
    return _sql(spark, sf_dir, MONITORS, "nation")


def tasks(spark, sf_dir):
    return _sql(spark, sf_dir, TASKS, "orders")


@query(f"""
    WITH s AS ({STATE}), m AS ({MONITORS}), t AS ({TASKS})
    SELECT table_key, owner, due FROM s WHERE due <= 800 AND EXISTS (SELECT 1 FROM m WHERE m.owner = s.owner AND status = 'active')
      AND NOT EXISTS (SELECT 1 FROM t WHERE t.table_key = s.table_key AND status IN ('queued', 'running', 'retry')) ORDER BY due, table_key LIMIT 50""")
def due_queue(spark, sf_dir):
    return ops.due_tables(state(spark, sf_dir), monitors(spark, sf_dir), tasks(spark, sf_dir), F.lit(800), 50).select("table_key", "owner", "due")


@query(f"""
    WITH s AS ({STATE}), t AS ({TASKS})
    SELECT id, t.table_key, priority, not_before FROM t JOIN s USING (table_key)
    WHERE status IN ('queued', 'retry') AND not_before <= 500 AND (s.lease_until IS NULL OR s.lease_until < 400) ORDER BY priority, not_before, id LIMIT 40""")
def claim_topk(spark, sf_dir):
    free = state(spark, sf_dir).withColumn("lease_until", F.col("lease_until") + 100)
    return ops.claimable(tasks(spark, sf_dir), free, F.lit(500), 40).select("id", "table_key", "priority", "not_before")


@query(f"WITH t AS ({TASKS}), l AS (SELECT *, row_number() OVER (PARTITION BY table_key, operation ORDER BY id DESC) AS r FROM t) SELECT table_key, operation, id FROM l WHERE r = 1 AND status = 'failed'")
def latest_failed_tables(spark, sf_dir):
    return ops.latest(tasks(spark, sf_dir), ["table_key", "operation"]).where("status = 'failed'").select("table_key", "operation", "id")


@query(f"""
    WITH t AS ({TASKS}), l AS (SELECT *, row_number() OVER (PARTITION BY table_key, operation ORDER BY id DESC) AS r FROM t)
    SELECT count(*) AS total, count_if(status = 'queued') AS queued, count_if(status = 'running') AS running, count_if(status = 'retry') AS retry, count_if(status = 'failed') AS failed,
      min(CASE WHEN status IN ('queued', 'retry') THEN created_at END) AS oldest, greatest(coalesce(1000 - min(CASE WHEN status IN ('queued', 'retry') THEN created_at END), 0), 0) AS oldest_age,
      (SELECT count(DISTINCT table_key) FROM l WHERE r = 1 AND status = 'failed') AS failed_tables,
      count_if(status IN ('queued', 'retry')) >= 100 AND greatest(coalesce(1000 - min(CASE WHEN status IN ('queued', 'retry') THEN created_at END), 0), 0) >= 600 AS backlogged FROM t""")
def queue_summary(spark, sf_dir):
    out = ops.queue_summary(tasks(spark, sf_dir), F.lit(1000))
    return out.withColumn("backlogged", s.queue_backlogged(F.col("queued") + F.col("retry"), F.col("oldest_age"), 100, 600))


RESULTS = "SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS result FROM lineitem"


@query(f"""
    WITH p AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 DESC LIMIT 50 OFFSET 20),
    r AS (SELECT run_id, count(*) AS tasks, count_if(result = 'succeeded') AS succeeded, count_if(result = 'failed') AS failed, count_if(result = 'skipped') AS skipped FROM ({RESULTS}) GROUP BY 1)
    SELECT id, owner, coalesce(tasks, 0) AS tasks, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped FROM p LEFT JOIN r ON run_id = id""")
def runs_page(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), "o_orderstatus")
    return ops.runs_page(runs, _sql(spark, sf_dir, RESULTS, "lineitem"), F.col("o_orderstatus") == "F", 50, 20).drop("o_orderstatus")


@query(f"""
    SELECT c_nationkey AS owner, o_orderkey AS run_id, count(*) AS tasks, count_if(result = 'failed') AS failed
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN ({RESULTS}) ON run_id = o_orderkey WHERE c_nationkey = 7 GROUP BY 1, 2 ORDER BY 2 DESC LIMIT 50""")
def owner_runs(spark, sf_dir):
    runs, owners = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").where("c_nationkey = 7")
    own = runs.join(owners, runs["o_custkey"] == owners["c_custkey"]).select(F.col("c_nationkey").alias("owner"), F.col("o_orderkey").alias("run_id"))
    each = own.join(_sql(spark, sf_dir, RESULTS, "lineitem"), "run_id").groupBy("owner", "run_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("result") == "failed").alias("failed"))
    return each.orderBy(F.desc("run_id")).limit(50)


@query(f"""
    WITH t AS ({TASKS}), m AS ({MONITORS})
    SELECT id, CASE WHEN t.status IN ('queued', 'running', 'retry') AND coalesce(m.status, '') <> 'active' THEN 'cancelled' ELSE t.status END AS status FROM t LEFT JOIN m USING (owner)""")
def cancel_orphaned_tasks(spark, sf_dir):
    return ops.cancel_without_monitor(tasks(spark, sf_dir), monitors(spark, sf_dir)).select("id", "status")


@query(f"""
    WITH t AS ({TASKS}) SELECT id, CASE WHEN status = 'running' AND lease_until < 300 THEN 'retry' ELSE status END AS status,
      CASE WHEN NOT coalesce(status = 'running' AND lease_until < 300, false) THEN lease_until END AS lease_until FROM t""")
def recover_leases(spark, sf_dir):
    f = tasks(spark, sf_dir)
    return ops.recover_leases(f.withColumn("lease_until", F.coalesce("lease_until", F.lit(1 << 40))), F.lit(300)).select("id", "status", F.when(F.col("lease_until") < (1 << 40), F.col("lease_until")).alias("lease_until"))


FILES = "SELECT l_suppkey AS table_key, l_orderkey * 8 + l_linenumber AS path, CASE l_returnflag WHEN 'A' THEN 'data' WHEN 'N' THEN CASE WHEN l_quantity < 10 THEN 'position' ELSE 'data' END ELSE CASE WHEN l_quantity < 20 THEN 'equality' ELSE 'data' END END AS content, CAST(floor(l_extendedprice) AS BIGINT) * 2000 AS bytes FROM lineitem"
INVENTORY = f"""
    SELECT table_key, count_if(content = 'data') AS data_files, count_if(content = 'data' AND bytes < 67108864) AS small_files, CAST(coalesce(sum(CASE WHEN content = 'data' AND bytes < 67108864 THEN bytes END), 0) AS BIGINT) AS small_bytes,
      count_if(content = 'equality') AS equality_deletes, count_if(content = 'position') AS position_deletes FROM ({FILES}) GROUP BY 1"""


def files(spark, sf_dir):
    return _sql(spark, sf_dir, FILES, "lineitem")


@query(INVENTORY)
def inventory(spark, sf_dir):
    return mt.inventory(files(spark, sf_dir), ["table_key"], 64 << 20)


@query(f"SELECT table_key, small_files >= 200 OR (small_files >= 10 AND small_bytes >= 268435456) OR equality_deletes >= 50 OR position_deletes >= 25 AS due FROM ({INVENTORY})")
def compaction_triggers(spark, sf_dir):
    return inventory(spark, sf_dir).select("table_key", s.compaction_due(F.col("small_files"), F.col("small_bytes"), F.col("equality_deletes"), F.col("position_deletes")).alias("due"))


WORK = f"""
    SELECT table_key, count_if(content = 'data') AS files, CAST(coalesce(sum(CASE WHEN content = 'data' THEN bytes END), 0) AS BIGINT) AS bytes, count_if(content <> 'data') AS delete_files
    FROM (SELECT table_key, path, min(content) AS content, min(bytes) AS bytes FROM ({FILES}) GROUP BY 1, 2) GROUP BY 1"""


def work(spark, sf_dir):
    return mt.workload(files(spark, sf_dir), ["table_key"])


@query(WORK)
def workload(spark, sf_dir):
    return work(spark, sf_dir)


@query(f"""
    SELECT table_key, CASE WHEN delete_files > 100 THEN 'equality_deletes' WHEN bytes > 536870912 THEN 'bytes' WHEN files > 250 THEN 'files' END AS route,
      CASE WHEN bytes > 8589934592 OR files > 2000 OR delete_files > 800 THEN 'xlarge' WHEN bytes > 2147483648 OR files > 1000 OR delete_files > 400 THEN 'large'
        WHEN bytes > 536870912 OR files > 250 OR delete_files > 100 THEN 'medium' ELSE 'small' END AS profile FROM ({WORK})""")
def compaction_routing(spark, sf_dir):
    size = (F.col("bytes"), F.col("files"), F.col("delete_files"))
    return work(spark, sf_dir).select("table_key", s.compaction_route(size[2], size[0], size[1]).alias("route"), s.resource_profile(*size).alias("profile"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'waiting_for_snapshot' WHEN c_custkey % 7 = 0 THEN 'scanning' WHEN c_custkey % 5 = 0 THEN 'running' WHEN c_acctbal < 0 THEN 'error'
      WHEN c_custkey % 3 = 0 THEN 'inventory_pending' WHEN c_acctbal > 5000 THEN 'ready' ELSE 'healthy' END AS state FROM customer""")
def table_state(spark, sf_dir):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    return t(spark, sf_dir, "customer").select("c_custkey", s.table_state(k % 11 != 0, k % 7 == 0, k % 5 == 0, b < 0, k % 3 != 0, b > 5000).alias("state"))


@query("""
    SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' - INTERVAL 7 DAY AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')""")
def orphan_difference(spark, sf_dir):
    listed = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("modified"))
    used = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("path"))
    now = F.unix_seconds(F.lit("1996-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    return mt.orphaned(listed, used, now).select("path").distinct()


@query("""
    WITH v AS (SELECT DISTINCT o_orderstatus AS tbl, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS made FROM orders),
    r AS (SELECT tbl, made, row_number() OVER (PARTITION BY tbl ORDER BY made DESC) AS r FROM v)
    SELECT tbl, made AS version FROM r WHERE r > 10 AND made < 860000000 - 604800""")
def expire_snapshots(spark, sf_dir):
    at = F.unix_seconds(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    v = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tbl"), at.alias("at")).distinct().withColumn("version", F.col("at"))
    return mt.expired(v, ["tbl"], F.lit(860000000)).select("tbl", "version")


GREEDY = """
    WITH RECURSIVE o AS ({rows}),
    r AS (
      SELECT g, n, id, 0 AS chunk, 1 AS c, size AS held FROM o WHERE n = 1 UNION ALL
      SELECT o.g, o.n, o.id, CASE WHEN r.c >= {most} OR r.held + o.size > {bytes} THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.c >= {most} OR r.held + o.size > {bytes} THEN 1 ELSE r.c + 1 END,
        CASE WHEN r.c >= {most} OR r.held + o.size > {bytes} THEN o.size ELSE r.held + o.size END FROM r JOIN o ON o.g = r.g AND o.n = r.n + 1)"""
UNFIT = f"""SELECT table_key AS g, path AS id, size, row_number() OVER (PARTITION BY table_key ORDER BY size, path) AS n
    FROM (SELECT table_key, path, min(bytes) AS size FROM ({FILES}) GROUP BY ALL) WHERE size < 67108864 OR size > 241591910"""


@query(GREEDY.format(rows=UNFIT, most=1 << 30, bytes=128 << 20) + f""", u AS ({UNFIT})
    SELECT r.g AS table_key, r.id AS path, u.size AS bytes, r.chunk AS bin FROM r JOIN u ON u.g = r.g AND u.id = r.id QUALIFY count(*) OVER (PARTITION BY r.g, r.chunk) >= 10""")
def bin_pack_groups(spark, sf_dir):
    f = files(spark, sf_dir).groupBy("table_key", "path").agg(F.min("bytes").alias("bytes")).withColumn("deletes", F.lit(0))
    return mt.bin_pack(f, ["table_key"]).select("table_key", "path", "bytes", "bin")


@query(GREEDY.format(rows="SELECT o_custkey AS g, o_orderkey AS id, strlen(o_orderpriority) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", most=5, bytes=40) + " SELECT id AS o_orderkey, g AS o_custkey, chunk FROM r")
def split_rows_by_limits(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.octet_length("o_orderpriority").alias("size"))
    return ap.split_rows(df, ["o_orderkey"], "size", 5, 40, ["o_custkey"]).select("o_orderkey", "o_custkey", "chunk")


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS VARCHAR) AS p_comment FROM part")
def schema_sync(spark, sf_dir):
    from pyspark.sql import types as T

    df = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return sync_schema(df, T.StructType([T.StructField("p_partkey", T.IntegerType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.LongType()), T.StructField("p_comment", T.StringType())]))


@query(f"""
    WITH s AS (SELECT table_key, arg_max(id, not_before * 100000 + id) AS snapshot, count(*) AS added, min(not_before) AS due FROM ({TASKS}) GROUP BY 1), o AS ({STATE})
    SELECT s.table_key, snapshot, CAST(added AS BIGINT) AS added, snapshot <> 0 AND snapshot IS DISTINCT FROM o.due AS changed, least(s.due, o.due) AS due FROM s LEFT JOIN o USING (table_key)""")
def commit_signals(spark, sf_dir):
    f = tasks(spark, sf_dir).select("table_key", F.col("id").alias("snapshot"), F.lit(1).cast("long").alias("added"), F.col("not_before").alias("due"), (F.col("not_before") * 100000 + F.col("id")).alias("at"))
    return ops.commit_signals(f, state(spark, sf_dir).select("table_key", F.col("due").alias("snapshot"), "due"))


@query(f"""
    WITH t AS ({TASKS}), r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'open' END AS status FROM orders)
    SELECT id FROM r WHERE status = 'done' AND (contains(CAST(id AS VARCHAR), '77') OR EXISTS (SELECT 1 FROM t WHERE t.id = r.id AND contains(CAST(table_key AS VARCHAR), '77')))
      AND EXISTS (SELECT 1 FROM t WHERE t.id = r.id AND operation = 'F')""")
def filter_runs(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'open' END").alias("status"), F.col("o_orderkey").cast("string").alias("worker"))
    results = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("task_id"))
    return ops.filter_runs(runs, results, tasks(spark, sf_dir), status="done", search="77", operation="F").select("id")


@query("SELECT task_id, attempt, id FROM (SELECT l_orderkey AS task_id, l_linenumber AS attempt, l_partkey * 100000 + l_suppkey AS id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 100000 + l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def latest_results(spark, sf_dir):
    results = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"))
    return ops.latest_results(results)


JOBS = "SELECT c_custkey AS job_id, CASE c_nationkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'initial' WHEN 2 THEN 'snapshot-only' ELSE 'latest-offset' END AS mode, CASE WHEN c_acctbal > 3000 THEN 'DONE' ELSE 'RUNNING' END AS status FROM customer"
DONE = "SELECT o_custkey AS job_id, bool_and(o_orderstatus = 'F') AS done FROM orders GROUP BY 1"


@query(f"SELECT j.job_id, coalesce(mode IN ('latest', 'latest-offset') OR coalesce(done, mode = 'snapshot-only' AND status = 'DONE'), false) AS complete FROM ({JOBS}) j LEFT JOIN ({DONE}) d USING (job_id)")
def snapshot_complete(spark, sf_dir):
    done = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("done"))
    return ops.snapshot_complete(_sql(spark, sf_dir, JOBS, "customer"), done).select("job_id", "complete")


@query("""
    WITH f AS (SELECT o_custkey AS table_key, min(o_orderkey) AS id FROM orders GROUP BY 1)
    SELECT table_key, id FROM f WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = table_key AND c_nationkey < 10)""")
def seed_states(spark, sf_dir):
    targets = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_key"), F.col("o_orderkey").alias("id"))
    return ops.seed_states(targets, t(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("table_key")))


SAMPLES = "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'purged' ELSE 'available' END AS status, event_id % 50 AS lag, value > 50 AS waiting FROM events"


@query(f"""
    WITH s AS (SELECT *, status = 'purged' AS p, status <> 'purged' AND lag >= 30 AS l FROM ({SAMPLES})),
    b AS (SELECT *, p AND NOT coalesce(lag(p) OVER w, false) AS bp, l AND NOT coalesce(lag(l) OVER w, false) AS bl, waiting AND NOT coalesce(lag(waiting) OVER w, false) AS bw FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, 'purged' AS alert FROM b WHERE bp UNION ALL SELECT user_id, event_id, 'lag' FROM b WHERE bl UNION ALL SELECT user_id, event_id, 'back_pressure' FROM b WHERE bw""")
def health_alerts(spark, sf_dir):
    return ops.health_alerts(_sql(spark, sf_dir, SAMPLES, "events"), "user_id", "event_id", 30)


POSITIONS = "SELECT event_id AS job_id, concat('bin.', lpad(CAST(event_id % 100 AS STRING), 3, '0')) AS file, event_id * 7 % 5000 AS saved_at FROM events"


@query(f"SELECT job_id, greatest(4000 - saved_at, 0) AS age, file BETWEEN 'bin.020' AND 'bin.080' AS available FROM ({POSITIONS})")
def checkpoint_diagnostics(spark, sf_dir):
    return ops.checkpoint_diagnostics(_sql(spark, sf_dir, POSITIONS, "events"), F.lit("bin.020"), F.lit("bin.080"), F.lit(4000)).select("job_id", "age", "available")


@query(f"SELECT min(file) AS first, max(file) AS last, count(*) AS n FROM ({POSITIONS})")
def log_range(spark, sf_dir):
    return ops.log_range(_sql(spark, sf_dir, POSITIONS, "events"))


@query("""
    WITH e AS (SELECT l_returnflag, count(*) + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS expected FROM lineitem GROUP BY 1)
    SELECT l_returnflag, count(*) AS total, count_if(l_tax < 0) AS filtered, count_if(l_tax < 0) = 0 AND count(*) = count(l_orderkey) AND count(*) = max(expected) AS complete FROM lineitem JOIN e USING (l_returnflag) GROUP BY 1""")
def load_counts(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("total"), F.count("l_orderkey").alias("loaded"), F.count_if(F.col("l_tax") < 0).alias("filtered"))
    expected = F.col("total") + F.when(F.col("l_returnflag") == "A", 1).otherwise(0)  # one load is a row short
    return g.select("l_returnflag", "total", "filtered", ops.check_load(expected, F.col("total"), F.col("loaded"), F.col("filtered"), F.lit(0)).alias("complete"))


@query("""
    WITH a AS (SELECT c_custkey AS table_key, c_nationkey % 2 = 0 AS complete, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS due FROM customer),
    b AS (SELECT DISTINCT o_custkey + 100 AS table_key, o_custkey % 5 = 0 AS complete, o_custkey + 7 AS due FROM orders)
    SELECT table_key, coalesce(a.complete, false) OR coalesce(b.complete, false) AS complete, coalesce(a.due, b.due) AS due FROM a FULL JOIN b USING (table_key)""")
def upsert_state(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_key"), (F.col("c_nationkey") % 2 == 0).alias("complete"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("due"))
    b = t(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("table_key"), (F.col("o_custkey") % 5 == 0).alias("complete"), (F.col("o_custkey") + 7).alias("due")).distinct()
    return ops.upsert_state(a, b)


@query("SELECT o_custkey AS table_key, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS conflict FROM orders")
def first_owner(spark, sf_dir):
    return ops.first_owner(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_key"), F.col("o_orderkey").alias("id")))


@query("""
    WITH s AS (SELECT event_type AS role, user_id AS instance, event_id AS seen FROM events)
    SELECT r.role, 3 AS expected, coalesce(count(DISTINCT CASE WHEN seen >= 900 THEN instance END), 0) AS online
    FROM (VALUES ('view'), ('click'), ('none')) r(role) LEFT JOIN s USING (role) GROUP BY 1""")
def runtime_instances(spark, sf_dir):
    expected = spark.sql("SELECT * FROM VALUES ('view', 3), ('click', 3), ('none', 3) AS e(role, expected)")
    seen = t(spark, sf_dir, "events").select(F.col("event_type").alias("role"), F.col("user_id").alias("instance"), F.col("event_id").alias("at"))
    return ops.instances(expected, seen, F.lit(960), 60)


@query("SELECT p_partkey, p_size % 16 AS tier, (year(TIMESTAMP '1995-03-04') - 1970) * 12 + 2 AS month, substr(p_name, 1, 4) AS prefix, p_partkey - p_partkey % 10 AS tens FROM part")
def partition_values(spark, sf_dir):
    d = F.lit("1995-03-04 00:00:00").cast("timestamp_ntz")
    df = t(spark, sf_dir, "part")
    return df.select("p_partkey", (F.col("p_size") % 16).alias("tier"), s.partition_transform("month", d).alias("month"), s.partition_transform("truncate", F.col("p_name"), 4).alias("prefix"), s.partition_transform("truncate_number", F.col("p_partkey"), 10).alias("tens"))


@query("SELECT user_id, event_type, last_at FROM (SELECT user_id, event_type, max(ts) AS last_at FROM events GROUP BY 1, 2) ORDER BY last_at DESC, user_id, event_type LIMIT 100")
def activity_list(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"))
    return rows.orderBy(F.desc("last_at"), "user_id", "event_type").limit(100)


from . import control, fixtures, tables  # noqa: E402, F401 - they register their queries here
