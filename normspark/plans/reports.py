"""Statistics, inventories, listings and candidate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.functions import scalars as S
from normspark.operators import reports as R
from normspark.operators import selection as G
from normspark.operators.catalog import freshness
from normspark.plans.registry import Tables, query


def _stats(t: Tables, by: str) -> DataFrame:
    return R.catalog_stats(t.orders, by, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS with_text, count(*) FILTER (o_orderstatus = 'P') AS unavailable FROM orders GROUP BY 1")
def f1_catalog_stats(t: Tables) -> DataFrame:
    return _stats(t, "o_orderpriority")


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = o_orderstatus")
def f2_structured_articles(t: Tables) -> DataFrame:
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus"))
    return t.lineitem.join(t.orders, on).agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM lineitem) AS changes, (SELECT count(*) FROM supplier) AS sources, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS enumerated, (SELECT count(*) FROM events WHERE event_type = 'click') AS active")
def f3_scalar_totals(t: Tables) -> DataFrame:
    a = t.lineitem.agg(F.count("*").alias("changes"))
    b = t.supplier.agg(F.count("*").alias("sources"), F.count_if(F.col("s_acctbal") > 0).alias("enumerated"))
    c = t.events.agg(F.count_if(F.col("event_type") == "click").alias("active"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # single rows


@query("""
WITH s AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS with_text, count(*) FILTER (o_orderstatus = 'P') AS unavailable FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(total, 0) AS total, greatest(0, coalesce(total - with_text - unavailable, 0)) AS pending FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def f4_pending(t: Tables) -> DataFrame:
    rows = t.customer.join(_stats(t, "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return R.pending(rows).select("c_custkey", F.coalesce("total", F.lit(0)).alias("total"), F.col("pending").cast("long").alias("pending"))


@query("""
WITH k AS (SELECT l_suppkey, count(*) AS records, max(l_shipdate) AS last FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1), a AS (SELECT max(l_shipdate) AS as_of FROM lineitem)
SELECT s_suppkey, s_name, n_name, records, CASE WHEN last IS NULL THEN 'unknown' WHEN last < as_of - INTERVAL 2 DAY THEN 'stale' ELSE 'current' END AS freshness
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN k ON s_suppkey = l_suppkey, a""")
def f5_source_listing(t: Tables) -> DataFrame:
    counts = t.lineitem.where("l_suppkey % 5 <> 0").groupBy("l_suppkey").agg(F.count("*").alias("records"), F.max("l_shipdate").alias("last"))
    as_of = t.lineitem.agg(F.max("l_shipdate").alias("as_of"))
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(F.broadcast(as_of))  # one row
    return rows.select("s_suppkey", "s_name", "n_name", "records", freshness(F.col("last"), F.expr("interval 2 day"), F.col("as_of")).alias("freshness"))


@query("SELECT n_nationkey, n_name, 25 AS total, true AS has_more FROM nation WHERE n_regionkey IS NOT NULL ORDER BY n_name LIMIT 10 OFFSET 5")
def f6_jurisdiction_page(t: Tables) -> DataFrame:
    return R.page(t.nation.select("n_nationkey", "n_name"), [F.col("n_name")], 10, 5)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size > 40 DESC, p_name, p_partkey LIMIT 50")
def f7_law_listing(t: Tables) -> DataFrame:
    return t.part.orderBy(F.desc(F.col("p_size") > 40), "p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("""
SELECT o_orderkey, coalesce(articles, 0) AS articles, latest FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS articles, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_linestatus)) AS latest FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def f8_law_detail(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("articles"), F.max_by("l_linestatus", F.struct("l_shipdate", "l_linenumber", "l_linestatus")).alias("latest"))
    return t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("articles", F.lit(0)).alias("articles"), "latest")


@query("""
WITH d AS (SELECT lang AS backend, CASE WHEN source < 'src2' THEN 'keyed' ELSE 'inline' END AS pointer, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS band, n_chars AS size FROM documents)
SELECT backend, pointer, band, grouping(backend, pointer, band)::BIGINT AS level, count(*) AS n, min(size) AS smallest, max(size) AS largest, sum(size)::BIGINT AS bytes, count(*) FILTER (size > 1000) AS large
FROM d GROUP BY GROUPING SETS ((backend, pointer, band), (backend, pointer), ())""")
def f9_size_report(t: Tables) -> DataFrame:
    pointer = F.when(F.col("source") < "src2", "keyed").otherwise("inline")
    return R.size_report(t.documents, "lang", pointer, S.band(F.col("n_chars"), [(500, "small"), (5000, "medium")], "large"), "n_chars")


@query("SELECT lang, text IS NULL AS no_body, source IS NULL AS no_key, count(*) AS n, count(*) FILTER (text IS NOT NULL AND source IS NOT NULL) AS both FROM documents GROUP BY ALL")
def f10_pointer_coverage(t: Tables) -> DataFrame:
    has = lambda c: F.col(c).isNull()
    return t.documents.groupBy("lang", has("text").alias("no_body"), has("source").alias("no_key")).agg(F.count("*").alias("n"), F.count_if(~has("text") & ~has("source")).alias("both"))


_AGE = "CASE WHEN h < 24 THEN 'day' WHEN h < 168 THEN 'week' ELSE 'older' END"


def _aged(t: Tables) -> DataFrame:
    as_of = t.events.agg(F.max("ts").alias("as_of"))
    rows = t.events.join(F.broadcast(as_of))  # one row
    hours = (F.unix_seconds(F.col("as_of").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 3600
    return rows.withColumn("age", S.band(hours, [(24, "day"), (168, "week")], "older"))


@query(f"""
WITH e AS (SELECT *, (epoch(max(ts) OVER ()) - epoch(ts)) / 3600.0 AS h FROM events)
SELECT event_type, user_id % 3 AS status, {_AGE} AS age, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, count(*) FILTER (value > 50) AS leased FROM e GROUP BY ALL""")
def f11_jobs_by_age(t: Tables) -> DataFrame:
    return _aged(t).groupBy("event_type", (F.col("user_id") % 3).alias("status"), "age").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count_if(F.col("value") > 50).alias("leased"))


@query(f"""
WITH e AS (SELECT *, (epoch(max(ts) OVER ()) - epoch(ts)) / 3600.0 AS h FROM events) SELECT value > 20 AS dispatched, {_AGE} AS age, count(*) AS n FROM e GROUP BY ALL""")
def f12_outbox_by_age(t: Tables) -> DataFrame:
    return _aged(t).groupBy((F.col("value") > 20).alias("dispatched"), "age").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")))
def f13_table_counts(t: Tables) -> DataFrame:
    return R.table_counts({n: getattr(t, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")})


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.x'), json_extract_string(props, '$.k')) AS first FROM events")
def f14_json_fields(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), S.first_json(F.col("props"), "$.x", "$.k").alias("first"))


@query("""
WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, sum(('0x' || left(md5(o_orderpriority || o_orderkey), 8))::BIGINT) AS x FROM orders GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sum(x)::BIGINT AS text_sum, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS status_counts FROM c""")
def f15_fingerprint(t: Tables) -> DataFrame:
    return R.fingerprint(t.orders.withColumn("t", F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))), "o_orderstatus", "t")


@query("SELECT 1 AS only_left, 0 AS only_right, (SELECT count(*) FROM nation WHERE n_nationkey % 6 = 0 AND n_nationkey <> 3) AS different, 'different' AS verdict")
def f16_compare_copies(t: Tables) -> DataFrame:
    right = t.nation.where("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 0, F.upper(F.concat("n_name", F.lit("!")))).otherwise(F.col("n_name")))
    return R.compare_copies(t.nation, right, "n_nationkey", ["n_name", "n_regionkey"])


def _part(table: str, cols: list[str]) -> str:
    text = " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in sorted(cols))
    return f"SELECT *, sha256({text}) AS h FROM {table}"


_PRINTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
_WORDS = " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::HUGEINT)::VARCHAR" for i in range(R.LANES))


@query(f"""
WITH p AS ({_part("(SELECT * REPLACE (o_orderdate::DATE AS o_orderdate) FROM orders)", _PRINTED)}), s AS (SELECT o_orderstatus AS k, count(*) AS v FROM p GROUP BY 1)
SELECT count(*) AS n, sha256({_WORDS}) AS rows_digest, (SELECT '{{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}}' FROM s) AS status_counts,
  '{{"first":"' || coalesce(max(h) FILTER (o_orderkey = 1), '') || '","none":""}}' AS checks,
  sha256('o_custkey:bigint,o_orderdate:date,o_orderkey:bigint,o_orderpriority:string,o_orderstatus:string') AS schema_digest FROM p""")
def f15_dataset_fingerprint(t: Tables) -> DataFrame:
    """Digest of the multiset of rows, of the schema, status counts and two records, one of which is not there."""
    return R.dataset_fingerprint(_printed(t), "o_orderstatus", {"first": F.col("o_orderkey") == 1, "none": F.col("o_orderkey") < 0})


def _printed(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date"))


@query("""
WITH c AS (SELECT 'type' AS copy, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT 'again', o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders
  UNION ALL SELECT 'lost', o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey <> 1
  UNION ALL SELECT 'text', o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey = 1 THEN 'x' ELSE o_orderpriority END FROM orders),
s AS (SELECT copy, string_agg(k || v, ',' ORDER BY k) AS s FROM (SELECT copy, o_orderstatus AS k, count(*) AS v FROM c GROUP BY ALL) GROUP BY 1),
g AS (SELECT copy, count(*) AS n, count(*) FILTER (o_orderkey = 1) AS has, count(*) FILTER (o_orderkey = 1 AND o_orderpriority <> 'x') AS same,
  count(*) FILTER (EXISTS (SELECT 1 FROM orders o WHERE (o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority) = (c.o_orderkey, c.o_custkey, c.o_orderstatus, c.o_orderpriority))) AS equal FROM c GROUP BY 1)
SELECT copy, CASE WHEN r = '' THEN 'equal' ELSE 'different' END AS verdict, r AS reasons FROM (SELECT copy, concat_ws(', ', CASE WHEN n <> (SELECT count(*) FROM orders) THEN 'row counts' END, CASE WHEN copy = 'type' THEN 'schema' END,
  CASE WHEN s <> (SELECT s FROM s WHERE copy = 'again') THEN 'status counts' END, CASE WHEN equal <> (SELECT count(*) FROM orders) THEN 'rows' END,
  CASE WHEN has = 0 THEN 'lost record first' WHEN same = 0 THEN 'changed record first' END) AS r FROM g JOIN s USING (copy))""")
def f16_compare_fingerprints(t: Tables) -> DataFrame:
    """Copies of one table: the same again in another order, one with a changed type, one that lost a record, one with a changed text."""
    rows = _printed(t).drop("o_orderdate")
    copies = {
        "again": rows.repartition(3, "o_custkey"), "type": rows.withColumn("o_custkey", F.col("o_custkey").cast("string")), "lost": rows.where("o_orderkey <> 1"),
        "text": rows.withColumn("o_orderpriority", F.when(F.col("o_orderkey") == 1, "x").otherwise(F.col("o_orderpriority"))),
    }
    required = {"first": F.col("o_orderkey") == 1}
    expected, out = R.dataset_fingerprint(rows, "o_orderstatus", required), None
    for name, copy in copies.items():
        one = R.compare_fingerprints(R.dataset_fingerprint(copy, "o_orderstatus", required), expected)
        one = one.select(F.lit(name).alias("copy"), "verdict", F.array_join("reasons", ", ").alias("reasons"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'missing' ELSE 'mismatch' END AS reason FROM documents WHERE doc_id % 50 = 0 OR doc_id % 77 = 1")
def f17_bad_checksums(t: Tables) -> DataFrame:
    body = F.encode("text", "UTF-8")
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 50 != 0, body).alias("body"), F.when(F.col("doc_id") % 77 == 1, "0").otherwise(F.sha2(body, 256)).alias("checksum"))
    return R.bad_checksums(rows, "doc_id", "body", "checksum")


@query("SELECT doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars)::BIGINT // 20000 AS bin FROM documents")
def f18_cumulative_bins(t: Tables) -> DataFrame:
    return R.cumulative_bins(t.documents.select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20_000).select("doc_id", F.col("bin").cast("long").alias("bin"))


@query("""
WITH RECURSIVE o AS (SELECT doc_id // 1000 AS bucket, doc_id, n_chars, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS k FROM documents),
f AS (SELECT bucket, doc_id, n_chars, k, 0 AS batch, 1 AS n, n_chars AS total FROM o WHERE k = 1 UNION ALL
  SELECT o.bucket, o.doc_id, o.n_chars, o.k, CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN o.n_chars ELSE f.total + o.n_chars END FROM f JOIN o ON o.bucket = f.bucket AND o.k = f.k + 1)
SELECT bucket, doc_id, n_chars, batch::BIGINT AS batch FROM f""")
def f18_greedy_batches(t: Tables) -> DataFrame:
    rows = t.documents.select((F.floor(F.col("doc_id") / 1000)).alias("bucket"), "doc_id", "n_chars")
    return R.greedy_batches(rows, "bucket", "doc_id", "n_chars", 25, 20_000)


@query("""
WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
f AS (SELECT doc_id, n_chars, k, 0 AS batch, 1 AS n, n_chars AS total FROM o WHERE k = 1 UNION ALL
  SELECT o.doc_id, o.n_chars, o.k, CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= 25 OR f.total + o.n_chars > 20000 THEN o.n_chars ELSE f.total + o.n_chars END FROM f JOIN o ON o.k = f.k + 1)
SELECT doc_id, n_chars, batch::BIGINT AS batch FROM f""")
def f18_greedy_batches_one_bucket(t: Tables) -> DataFrame:
    """The whole table as one bucket."""
    return R.greedy_batches(t.documents.select(F.lit(0).alias("bucket"), "doc_id", "n_chars"), "bucket", "doc_id", "n_chars", 25, 20_000).drop("bucket")


@query("""
SELECT count(*) FILTER (text IS NULL) AS pending, count(*) FILTER (text IS NOT NULL) AS pointed, count(DISTINCT source) AS keys, coalesce(sum(n_chars), 0)::BIGINT AS bytes,
  count(*) FILTER (n_chars <> length(text)) AS inconsistent, round(100.0 * count(text) / count(*), 2)::DOUBLE AS progress FROM documents""")
def f19_migration_totals(t: Tables) -> DataFrame:
    d = t.documents
    return d.agg(F.count_if(F.col("text").isNull()).alias("pending"), F.count("text").alias("pointed"), F.count_distinct("source").alias("keys"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("bytes"), F.count_if(F.col("n_chars") != F.length("text")).alias("inconsistent"), F.round(100.0 * F.count("text") / F.count("*"), 2).alias("progress"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, (SELECT count(*) FROM part) > 120 AS has_more FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 100")
def f20_page(t: Tables) -> DataFrame:
    return R.page(t.part.select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 20, 100)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 10), n AS (SELECT l_orderkey AS k, bool_or(l_partkey % 10 = 0) AS whole FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS k, bool_or(l_linestatus = 'O') AS linked FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS k, CASE WHEN s.k IS NULL THEN 'not_materialized' ELSE 'available' END AS official_source, CASE WHEN s.k IS NULL THEN 'not_materialized' WHEN whole THEN 'unstructured' ELSE 'partial' END AS structured_text,
  CASE WHEN c.k IS NOT NULL THEN 'partial' WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'not_materialized' END AS history, CASE WHEN linked THEN 'partial' ELSE 'not_identified' END AS attribution
FROM orders LEFT JOIN s ON s.k = o_orderkey LEFT JOIN n ON n.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey""")
def f21_coverage_status(t: Tables) -> DataFrame:
    key = F.col("l_orderkey").alias("k")
    laws = t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "complete").alias("history"))
    nodes = t.lineitem.select(key, F.when(F.col("l_partkey") % 10 == 0, "document").otherwise("article").alias("node_type"))
    changes = t.lineitem.where("l_returnflag = 'R'").select(key, (F.col("l_linestatus") == "O").alias("linked"))
    return R.coverage_status(laws, "k", t.lineitem.where("l_quantity > 10").select(key), nodes, changes)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def f21_coverage_report(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, coalesce(active, 0) AS active, least(5, greatest(0, 8 - coalesce(active, 0))) AS remaining FROM customer LEFT JOIN a ON c_custkey = o_custkey""")
def f22_capacity(t: Tables) -> DataFrame:
    active = t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("active"))
    rows = t.customer.join(active, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return rows.select("c_custkey", "active", R.capacity_left(F.lit(5), F.col("active"), 8).cast("long").alias("remaining"))


# ------------------------------------------------------------------ work selection


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, max((o_orderdate, o_orderkey))[2] AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
WHERE o_orderkey IS NULL OR s = 'F'""")
def g1_latest_job(t: Tables) -> DataFrame:
    jobs = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return G.latest_attempt(t.customer.select("c_custkey"), jobs, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).where("o_orderkey is null or o_orderstatus = 'F'").select("c_custkey", "o_orderkey")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND (try_cast(CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) IS NULL OR ts < TIMESTAMP '2024-01-15')")
def g2_eligible(t: Tables) -> DataFrame:
    retry = S.utc_timestamp(F.when(F.col("event_id") % 3 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return t.events.where((F.col("event_type") != "view") & (retry.isNull() | (F.col("ts") < F.expr("timestamp_ntz '2024-01-15'")))).select("event_id")


@query("""
SELECT o_orderkey, o_orderpriority, turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)::INTEGER AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 23""")
def g3_fair_pick(t: Tables) -> DataFrame:
    return G.fair_pick(t.orders, "o_orderpriority", [F.col("o_orderdate"), F.col("o_orderkey")], 23).select("o_orderkey", "o_orderpriority", "turn")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 40")
def g4_keyset(t: Tables) -> DataFrame:
    return G.keyset(t.orders.select("o_orderkey"), "o_orderkey", 100, 40)


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'active' WHEN o_totalprice < 1000 THEN 'small' ELSE 'taken' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def g4_skip_reasons(t: Tables) -> DataFrame:
    return G.skip_reasons(t.orders, F.when(F.col("o_orderstatus") == "P", "active").when(F.col("o_totalprice") < 1000, "small"))


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 25")
def g5_oldest_waiting(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").orderBy("ts", "event_id").limit(25).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def g6_not_active(t: Tables) -> DataFrame:
    busy = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(busy, "c_custkey", "left_anti")


@query("SELECT user_id, n, CASE WHEN n < 5 THEN least(3600, (15 * 2 ** (n - 1))::INTEGER) END AS delay FROM (SELECT user_id, (count(*) % 9 + 1)::INTEGER AS n FROM events GROUP BY 1)")
def g7_retry_delay(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg((F.count("*") % 9 + 1).cast("int").alias("n"))
    return rows.select("user_id", "n", S.retry_delay(F.col("n")).alias("delay"))
