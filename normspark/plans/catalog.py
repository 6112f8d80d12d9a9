"""Catalog, archive and gate queries: orders stand for laws, lineitem for their parts, documents for raw bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.operators import catalog as C
from normspark.plans.registry import Tables, query
from normspark.sources.catalogs import archive, seed_catalog, with_version_ids
from normspark.sources.histories import both_directions


@query("""
SELECT 'R' || r_regionkey AS id, 'region' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS parent_id FROM region
UNION ALL SELECT 'N' || n_nationkey, 'nation', n_name, 'R' || n_regionkey FROM nation""")
def a5_jurisdictions(t: Tables) -> DataFrame:
    top = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    return top.unionByName(t.nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id")))


@query("""
WITH e AS (SELECT l_orderkey AS norm, l_suppkey AS other, 'incoming' AS direction, l_linenumber AS i FROM lineitem
  UNION ALL SELECT l_suppkey, l_orderkey, 'outgoing', l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY norm, other, direction ORDER BY i DESC) AS rn FROM e)
SELECT norm, other, direction, i FROM r WHERE rn = 1""")
def a11_both_directions(t: Tables) -> DataFrame:
    from normspark.operators.changes import last_wins

    edges = both_directions(t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("i")), "l_orderkey", "l_suppkey", ["i"])
    return last_wins(edges, ["norm", "other", "direction"], "i")


@query("""
SELECT DISTINCT source AS law_slug, sha256(text) AS checksum, left(sha256(text), 2) AS sha_prefix,
  'sha256/' || left(sha256(text), 2) || '/' || sha256(text) AS object_key
FROM documents WHERE (source, sha256(text)) NOT IN (SELECT source, sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def a13_archive(t: Tables) -> DataFrame:
    body = F.encode("text", "UTF-8")
    rows = t.documents.select("doc_id", F.col("source").alias("law_slug"), body.alias("raw_body"))
    held = rows.where("doc_id % 3 = 0").select("law_slug", F.sha2("raw_body", 256).alias("checksum"))
    return archive(held, rows).select("law_slug", "checksum", "sha_prefix", "object_key")


@query("""
WITH h AS (SELECT source AS law_slug, sha256(text) AS checksum, min(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS version_id FROM documents GROUP BY ALL),
i AS (SELECT source AS law_slug, sha256(text) AS checksum, min(doc_id + 1000000) AS new_id FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT law_slug, checksum, coalesce(version_id, new_id) AS version_id FROM h LEFT JOIN i USING (law_slug, checksum)""")
def a13_version_ids(t: Tables) -> DataFrame:
    """Snapshots without a version take the one that a later sync names."""
    rows = t.documents.select("doc_id", F.col("source").alias("law_slug"), F.sha2("text", 256).alias("checksum"))
    held = rows.groupBy("law_slug", "checksum").agg(F.min(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).alias("version_id"))
    return with_version_ids(held, rows.where("doc_id % 3 = 0").withColumn("version_id", F.col("doc_id") + 1_000_000))


@query("""
WITH s AS (SELECT CASE p_partkey WHEN 1 THEN 'lgpd' WHEN 2 THEN 'codigo-civil' ELSE p_partkey::VARCHAR END AS slug, p_name AS title, p_type AS status FROM part),
n AS (SELECT * FROM (VALUES ('lgpd', 'Lei Geral de Proteção de Dados Pessoais'), ('codigo-civil', 'Código Civil'), ('maria-da-penha', 'Lei Maria da Penha')) v(slug, new_title))
SELECT coalesce(s.slug, n.slug) AS slug, coalesce(new_title, title) AS title, status, CASE WHEN s.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'untouched' ELSE 'refreshed' END AS change FROM s FULL JOIN n ON s.slug = n.slug""")
def a6_seed_catalog(t: Tables) -> DataFrame:
    """The seed laws merged into a catalog: titles are refreshed, states stay."""
    held = t.part.select(F.when(F.col("p_partkey") == 1, "lgpd").when(F.col("p_partkey") == 2, "codigo-civil").otherwise(F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("title"), F.col("p_type").alias("status"))
    return C.upsert(held, seed_catalog(t.spark).select("slug", "title"), "slug", ["title"])


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 10000 AS shard FROM orders")
def a16_sharded_listing(t: Tables) -> DataFrame:
    return C.sharded(t.orders, "o_orderkey", 10_000).select("o_orderkey", F.col("shard").cast("long").alias("shard"))


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    laws = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    old = laws.where("o_orderkey % 4 <> 0")
    new = laws.where("o_orderkey % 3 <> 0").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), (F.col("o_custkey") + (F.col("o_orderkey") % 11 == 0).cast("int")).alias("o_custkey"))
    return old, new


_HALVES = """
old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 4 <> 0),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS o_custkey FROM orders WHERE o_orderkey % 3 <> 0),
merged AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
  CASE WHEN o.o_custkey <> n.o_custkey THEN o.o_orderstatus ELSE coalesce(n.o_orderstatus, o.o_orderstatus) END AS o_orderstatus,
  CASE WHEN o.o_custkey <> n.o_custkey THEN o.o_orderpriority ELSE coalesce(n.o_orderpriority, o.o_orderpriority) END AS o_orderpriority,
  coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
  CASE WHEN o.o_custkey <> n.o_custkey THEN 'conflict' WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'untouched'
    WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR (n.o_orderpriority IS NOT NULL AND n.o_orderpriority IS DISTINCT FROM o.o_orderpriority) THEN 'refreshed'
    ELSE 'unchanged' END AS change
  FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)"""


@query(f"WITH {_HALVES} SELECT * FROM merged")
def c1_upsert(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return C.upsert(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"], owner="o_custkey")


@query("""
WITH c AS (SELECT c_nationkey AS nation, c_acctbal::INTEGER // 500 AS slot, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL HAVING count(*) = 1)
SELECT s_suppkey, nation, slot, c_custkey FROM (SELECT s_suppkey, s_nationkey AS nation, s_acctbal::INTEGER // 500 AS slot FROM supplier) JOIN c USING (nation, slot)""")
def c2_unique_identity(t: Tables) -> DataFrame:
    seeds = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.expr("int(bround(s_acctbal)) div 500").cast("int").alias("slot"))
    records = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.expr("int(bround(c_acctbal)) div 500").cast("int").alias("slot"))
    return C.unique_identity(seeds, records, ["nation", "slot"], "c_custkey").select("s_suppkey", "nation", "slot", "c_custkey")


@query(f"""WITH {_HALVES}
SELECT o_orderpriority, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'refreshed') AS refreshed, count(*) FILTER (change = 'unchanged') AS unchanged,
  count(*) FILTER (change = 'untouched') AS untouched, count(*) FILTER (change = 'conflict') AS conflict FROM merged GROUP BY 1""")
def c3_delta_counts(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return C.delta_counts(C.upsert(old, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"], owner="o_custkey"), "o_orderpriority")


_PAGED = """p AS (SELECT o_orderstatus AS source, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS declared FROM orders)"""


@query(f"""
WITH {_PAGED}, g AS (SELECT source, pos // 100 AS page, count(*) AS n, min(declared) AS lo, max(declared) AS hi FROM p WHERE o_orderkey % 997 <> 0 GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS listed, max(hi) AS declared, count(*) AS pages, count(*) FILTER (n <> least(100, greatest(hi - page * 100, 0))) AS bad_pages,
  (min(lo) = max(hi)) AND count(*) FILTER (n <> least(100, greatest(hi - page * 100, 0))) = 0 AND sum(n) = max(hi) AS complete FROM g GROUP BY source""")
def c4_page_completeness(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source")
    rows = t.orders.select(F.col("o_orderstatus").alias("source"), "o_orderkey")
    rows = rows.withColumn("page", F.floor((F.row_number().over(w.orderBy("o_orderkey")) - 1) / 100)).withColumn("declared", F.count("*").over(w))
    return C.page_completeness(rows.where("o_orderkey % 997 <> 0"), "source", "page", "declared", 100)


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM lineitem) WHERE previous >= l_partkey""")
def c5_order_breaks(t: Tables) -> DataFrame:
    return C.order_breaks(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey")


@query("""
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS previous FROM lineitem) WHERE previous >= l_partkey""")
def c5_order_breaks_one_source(t: Tables) -> DataFrame:
    """All rows in one source: cut into ranges, whose last keys are passed on."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").withColumn("source", F.lit("all"))
    return C.order_breaks(rows, "source", ["l_orderkey", "l_linenumber", "l_partkey"], "l_partkey").drop("source")


@query("""
SELECT text_id, n, CASE WHEN a = b AND c = d THEN 'repeat' ELSE 'conflict' END AS route FROM (
  SELECT sha256(text) AS text_id, count(*) AS n, min(source) AS a, max(source) AS b, min(lang) AS c, max(lang) AS d FROM documents GROUP BY 1) WHERE n > 1""")
def c6_duplicates(t: Tables) -> DataFrame:
    return C.duplicate_routes(t.documents.select(F.sha2("text", 256).alias("text_id"), "source", "lang"), "text_id")


@query("""
WITH m AS (SELECT 'O' AS o_orderstatus, 10 AS minimum UNION ALL SELECT 'F', 1000000 UNION ALL SELECT 'Z', 1), c AS (SELECT o_orderstatus, count(*) AS found FROM orders GROUP BY 1)
SELECT o_orderstatus, minimum, coalesce(found, 0) AS found, coalesce(found, 0) >= minimum AND coalesce(found, 0) > 0 AS enough FROM m LEFT JOIN c USING (o_orderstatus)""")
def c7_minimum_volume(t: Tables) -> DataFrame:
    least = t.spark.createDataFrame([("O", 10), ("F", 1_000_000), ("Z", 1)], "o_orderstatus string, minimum int")
    return C.minimum_volume(t.orders, "o_orderstatus", least)


@query("""
SELECT l_partkey, count(*) FILTER (year(l_shipdate) <> y) AS misfiled, count(DISTINCT y) AS years FROM (
  SELECT l_partkey, l_shipdate, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def c8_year_gate(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_shipdate", F.year("o_orderdate").alias("y"))
    return C.year_gate(rows, "l_partkey", "l_shipdate", "y")


_PRINTS = """f AS (SELECT o_orderpriority AS source, o_orderkey // 500 AS page, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS sha256,
  count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY ALL)"""


@query(f"WITH {_PRINTS} SELECT source, sum(n)::BIGINT AS n, count(*) AS pages, sha256(string_agg(sha256, chr(10) ORDER BY page)) AS digest FROM f GROUP BY source")
def c9_identity_digest(t: Tables) -> DataFrame:
    return C.identity_digest(t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey"), "source", "o_orderkey", 500)


@query(f"WITH {_PRINTS} SELECT * FROM f")
def c10_page_fingerprints(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey", F.floor(F.col("o_orderkey") / 500).alias("page"))
    return C.page_fingerprints(rows, "source", "page", "o_orderkey")


@query(f"""WITH {_PRINTS},
s AS (SELECT o_orderpriority AS source, o_orderkey // 500 AS page, sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey)) AS sha256,
  count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders WHERE o_orderkey % 1009 <> 5 GROUP BY ALL)
SELECT f.source, min(f.page) FILTER (s.sha256 IS DISTINCT FROM f.sha256) AS first_stale_page, count(*) AS pages, count(*) FILTER (s.sha256 IS DISTINCT FROM f.sha256) AS pending_pages
FROM f LEFT JOIN s ON f.source = s.source AND f.page = s.page GROUP BY 1""")
def c11_resume_point(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("source"), "o_orderkey", F.floor(F.col("o_orderkey") / 500).alias("page"))
    fresh, stored = (C.page_fingerprints(r, "source", "page", "o_orderkey") for r in (rows, rows.where("o_orderkey % 1009 <> 5")))
    return C.resume_point(stored, fresh, "source", "page")


@query("""
WITH m AS (SELECT o_orderstatus, max(o_orderkey) AS max_seen FROM orders WHERE o_orderkey % 10 < 8 AND o_orderstatus <> 'P' AND o_orderkey < (SELECT quantile_disc(o_orderkey, 0.7) FROM orders) GROUP BY 1)
SELECT o_orderstatus, count(*) AS new_rows, max(o_orderkey) AS watermark, count(*) >= 100 AS backlog FROM orders LEFT JOIN m USING (o_orderstatus) WHERE max_seen IS NULL OR o_orderkey > max_seen GROUP BY 1""")
def c12_incremental(t: Tables) -> DataFrame:
    rank = t.orders.agg(F.expr("percentile_disc(0.7) within group (order by o_orderkey)").alias("cut"))
    seen = t.orders.where("o_orderkey % 10 < 8 and o_orderstatus <> 'P'").join(F.broadcast(rank), F.col("o_orderkey") < F.col("cut"))  # one row
    marks = seen.groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("max_seen"))
    return C.above_watermark(t.orders.select("o_orderkey", "o_orderstatus"), marks, "o_orderstatus", "o_orderkey", 100)


@query("""
WITH last AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), a AS (SELECT max(ts) AS as_of FROM events)
SELECT user_id, CASE WHEN last < as_of - (CASE WHEN user_id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END) THEN 'stale' ELSE 'current' END AS freshness FROM last, a""")
def c13_freshness(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    as_of = t.events.agg(F.max("ts").alias("as_of"))
    limit = F.when(F.col("user_id") % 2 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 7 day"))
    return last.join(F.broadcast(as_of)).select("user_id", C.freshness(F.col("last"), limit, F.col("as_of")).alias("freshness"))  # one row


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS listed FROM orders GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS stored FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(listed, 0) AS listed, coalesce(stored, 0) AS stored FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(listed, 0) <> coalesce(stored, 0)""")
def c14_reconcile(t: Tables) -> DataFrame:
    return C.reconcile(t.orders.select(F.col("o_custkey").alias("k")), t.lineitem.select(F.col("l_suppkey").alias("k")), "k")


@query("SELECT coalesce(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END, 'not_declared') AS scope, count(*) AS n FROM customer GROUP BY 1")
def c15_scope_counts(t: Tables) -> DataFrame:
    return C.scope_counts(t.customer.select(F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("s")), "s")


@query("""
WITH last AS (SELECT user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(ts) END AS last FROM events GROUP BY 1)
SELECT user_id FROM last ORDER BY last NULLS FIRST, user_id LIMIT 20""")
def c16_stalest(t: Tables) -> DataFrame:
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("x")).select("user_id", F.when(F.col("user_id") % 10 != 0, F.col("x")).alias("last"))
    return C.stalest(last, "last", "user_id", 20).select("user_id")


@query("""
SELECT o_orderkey, 'history=' || o_orderstatus || ';source=kept;text=new' AS coverage FROM orders""")
def c17_merge_coverage(t: Tables) -> DataFrame:
    old = F.create_map(F.lit("source"), F.lit("kept"), F.lit("text"), F.lit("old"), F.lit("gone"), F.col("o_orderpriority"))
    new = F.create_map(F.lit("text"), F.lit("new"), F.lit("history"), F.col("o_orderstatus"))
    merged = F.array_sort(F.map_entries(C.merge_coverage(old, new, ["gone"])))
    return t.orders.select("o_orderkey", F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("coverage"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN value < 10 THEN 'low' END, CASE WHEN event_type = 'click' THEN 'type' END, CASE WHEN user_id % 50 = 0 THEN 'user' END) AS reasons FROM events""")
def c18_reject_reasons(t: Tables) -> DataFrame:
    reasons = C.reject_reasons({"low": F.col("value") < 10, "type": F.col("event_type") == "click", "user": F.col("user_id") % 50 == 0})
    return t.events.select("event_id", reasons.alias("reasons"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def c19_repeated_keys(t: Tables) -> DataFrame:
    return C.repeated_keys(t.events, ["user_id", "event_type"])
