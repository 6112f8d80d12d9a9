"""Change, history and dossier queries: orders as laws, lineitem as changes of nodes, suppliers as source acts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normspark.functions import scalars as S
from normspark.operators import changes as D
from normspark.operators import dossiers as H
from normspark.operators.selection import top_per_group
from normspark.plans.registry import Tables, query


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("""
WITH v AS (SELECT l_partkey, l_shipdate::DATE AS day, l_orderkey * 10 + l_linenumber AS seq, l_returnflag || l_linestatus AS text FROM lineitem),
x AS (SELECT *, max({'d': day, 's': -seq, 't': text}) OVER (PARTITION BY l_partkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS p FROM v)
SELECT l_partkey, seq, p.t AS before_text, text AS after_text FROM x WHERE p.t IS NOT NULL AND p.t <> text""")
def d1_before_after(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", F.to_date("l_shipdate").alias("day"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return D.before_after(rows, ["l_partkey"], "day", "seq", "text").select("l_partkey", "seq", "before_text", "after_text")


@query("""
SELECT l_partkey, l_suppkey, y, l_orderkey, l_linenumber FROM (SELECT *, year(l_shipdate) AS y,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey, year(l_shipdate) ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def d2_newest_change(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", F.year("l_shipdate").cast("long"))
    out = D.latest(rows, ["l_partkey", "l_suppkey", "y"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")])
    return out.select("l_partkey", "l_suppkey", "y", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def d3_change_words(t: Tables) -> DataFrame:
    relation = F.when(F.col("l_returnflag") == "R", "Revogado pelo ato").when(F.col("l_returnflag") == "A", "ALTERADO por lei").otherwise("Publicado")
    return t.lineitem.where(D.is_change(relation)).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def d4_last_wins(t: Tables) -> DataFrame:
    return D.last_wins(t.events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 2 = 0 AND s.o_custkey = o.o_custkey AND s.o_orderpriority = o.o_orderpriority)")
def d5_unseen_events(t: Tables) -> DataFrame:
    key = ["o_custkey", "o_orderpriority"]
    return D.unseen(t.orders.select(*key), t.orders.where("o_orderkey % 2 = 0"), key)


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, l_suppkey, CASE WHEN l_linenumber > 1 THEN l_linenumber END AS device FROM lineitem),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('register:' || l_orderkey || ':' || l_suppkey || ':' || coalesce(device::VARCHAR, ''))) AS d FROM e)
SELECT l_orderkey, l_suppkey, device, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || ['8','9','a','b'][(CASE WHEN d[17:17] BETWEEN '0' AND '9' THEN d[17:17]::INTEGER ELSE ascii(d[17:17]) - 87 END) % 4 + 1] || d[18:20] || '-' || d[21:32] AS id
FROM h WHERE l_suppkey % 3 <> 0""")
def d5_event_ids(t: Tables) -> DataFrame:
    """Unseen events with their ids; what the store has is told by the id alone."""
    events = t.lineitem.select("l_orderkey", "l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("device"))
    events = events.withColumn("id", D.event_id("register", F.col("l_orderkey"), F.col("l_suppkey"), F.col("device")))
    return D.unseen(events, events.where("l_suppkey % 3 = 0"), ["id"])


_EV = """
e AS (SELECT o_orderkey AS event_id, o_orderkey AS law, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS item, CASE WHEN o_orderkey % 5 = 0 THEN 2 END AS par FROM orders),
c AS (SELECT l_orderkey * 10 + l_linenumber AS change_id, l_orderkey AS law, year(l_shipdate) AS y, l_linestatus AS item, l_linenumber AS par FROM lineitem),
pairs AS (SELECT event_id, change_id FROM e JOIN c ON e.law = c.law AND e.y = c.y WHERE (e.item IS NULL OR e.item = c.item) AND (e.par IS NULL OR e.par = c.par))"""


def _pairs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("law"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("item"), F.when(F.col("o_orderkey") % 5 == 0, 2).alias("par"))
    c = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"), F.col("l_orderkey").alias("law"), F.year("l_shipdate").alias("y"), F.col("l_linestatus").alias("item"), F.col("l_linenumber").alias("par"))
    return e, c, D.match_events(e, c, ["law", "y"], ["item", "par"])


@query(f"WITH {_EV} SELECT * FROM pairs")
def d6_event_change_match(t: Tables) -> DataFrame:
    return _pairs(t)[2]


@query(f"""WITH {_EV}
SELECT event_id::VARCHAR AS id, CASE WHEN event_id IN (SELECT event_id FROM pairs) THEN 'compared' ELSE 'pending' END AS status FROM e
UNION ALL SELECT 'change:' || change_id, 'derived' FROM c WHERE change_id NOT IN (SELECT change_id FROM pairs)""")
def d7_compared(t: Tables) -> DataFrame:
    return D.compared(*_pairs(t))


_FLAT = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^a-z0-9]', '', 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_FLAT.format('text')} AS t FROM documents), p AS (SELECT item_id, {_FLAT.format('text')} AS p FROM benchmark)
SELECT item_id, doc_id FROM p JOIN d ON length(p) >= 40 AND contains(t, p)""")
def d8_verified_additions(t: Tables) -> DataFrame:
    """Passages of 40 letters and digits or more, compared by these only."""
    return D.flat_passages(t.documents, t.benchmark)


@query("""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM benchmark)
SELECT item_id, doc_id FROM p JOIN d ON contains(t, p) AND len(string_split(p, ' ')) >= 8
  AND contains(' ' || t || ' ', ' ' || array_to_string(string_split(p, ' ')[1:8], ' ') || ' ')""")
def d8_word_passages(t: Tables) -> DataFrame:
    return D.contained_passages(t.documents, t.benchmark)


@query()
def d8_verified_additions_all(t: Tables) -> DataFrame:
    """The same without SQL; the tests compare with brute force, letters of any script included."""
    return D.flat_passages(t.documents, t.benchmark)


@query("""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'partial' WHEN regexp_matches(host, '(^|\\.)(example\\.org|example\\.net)$') THEN 'verified_primary' ELSE 'verified_source' END AS level FROM u""")
def d9_evidence_level(t: Tables) -> DataFrame:
    level = D.evidence_level(S.url_part(F.col("url"), "HOST"), F.col("page_id") % 4 != 0, ["example.org", "example.net"])
    return t.pages.select("page_id", level.alias("level"))


@query("""
WITH n AS (SELECT l_partkey, l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC, l_suppkey) AS rn,
  l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS changed_at FROM lineitem WHERE l_returnflag <> 'N')
SELECT o_orderkey AS law, l_linenumber AS node, l_suppkey AS source_act, changed_at, CASE WHEN rn IS NULL THEN 'not_identified' ELSE 'identified' END AS status
FROM orders LEFT JOIN n ON o_orderkey = l_orderkey AND rn = 1""")
def d10_blame(t: Tables) -> DataFrame:
    nodes = t.orders.select(F.col("o_orderkey").alias("law"))
    changes = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").alias("node"), F.col("l_suppkey").alias("source_act"), _day("l_shipdate").alias("changed_at"), "l_shipdate")
    order = [F.desc_nulls_last("l_shipdate"), F.desc("node"), F.col("source_act")]
    return D.blame(nodes, changes, ["law"], order, ["node", "source_act", "changed_at"])


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, status FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'verified' ELSE 'partial' END AS status,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def d11_provenance(t: Tables) -> DataFrame:
    comparable = F.col("l_returnflag") == "R"
    out = D.latest(t.lineitem, ["l_partkey"], [F.desc(comparable), F.desc_nulls_last("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", F.when(comparable, "verified").otherwise("partial").alias("status"))


_TREE = """
WITH d AS (SELECT o_orderkey AS law, unnest(['art:1', 'art:1.par:1', 'art:1.par:1.inciso:I', 'art:1.par:1.inciso:II', 'art:10', 'art:10.par:unico', 'art:2']) AS node_id FROM orders),
x AS (SELECT l_orderkey AS law, ['art:1', 'art:1.par:1', 'art:1.par:1.inciso:I', 'art:1.par:1.inciso:II', 'art:10', 'art:10.par:unico', 'art:2'][l_linenumber] AS node_id, * FROM lineitem WHERE l_linenumber <= 7),
c AS (SELECT *, l_returnflag = 'A' AS comparable FROM x WHERE l_returnflag <> 'N'), r AS (SELECT * FROM x WHERE l_returnflag = 'N')"""


@query(f"""{_TREE},
b AS (SELECT *, row_number() OVER (PARTITION BY law, node_id ORDER BY comparable DESC, l_shipdate DESC NULLS LAST, l_suppkey, l_partkey) AS rn FROM c),
n AS (SELECT d.law, d.node_id, count(r.law) FILTER (r.node_id = d.node_id) AS relations, count(r.law) FILTER (r.node_id <> d.node_id) AS inherited
  FROM d LEFT JOIN r ON r.law = d.law AND (r.node_id = d.node_id OR starts_with(d.node_id, r.node_id || '.')) GROUP BY 1, 2)
SELECT n.law, n.node_id, b.l_suppkey AS change_id, relations, inherited, CASE WHEN comparable THEN 'verified' WHEN b.law IS NOT NULL OR relations > 0 THEN 'partial' ELSE 'not_identified' END AS status
FROM n LEFT JOIN b ON b.law = n.law AND b.node_id = n.node_id AND rn = 1""")
def d11_node_provenance(t: Tables) -> DataFrame:
    """Every device of every law: its change, relations of its own and from above, and all three kinds of status."""
    devices, lines = _tree(t)
    changes = lines.where("l_returnflag <> 'N'").withColumn("comparable", F.col("l_returnflag") == "A")
    order = [F.desc_nulls_last("l_shipdate"), F.col("l_suppkey"), F.col("l_partkey")]
    return D.provenance(devices, changes, lines.where("l_returnflag = 'N'"), "law", "node_id", "l_suppkey", "comparable", order)


@query(f"""{_TREE}
SELECT d.law, d.node_id, r.node_id AS holder, length(d.node_id) - length(replace(d.node_id, '.', '')) - length(r.node_id) + length(replace(r.node_id, '.', '')) AS distance, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS signed_at
FROM d JOIN r ON r.law = d.law AND (r.node_id = d.node_id OR starts_with(d.node_id, r.node_id || '.'))""")
def d11_device_relations(t: Tables) -> DataFrame:
    devices, lines = _tree(t)
    relations = lines.where("l_returnflag = 'N'").select("law", "node_id", "l_suppkey", _day("l_shipdate").alias("signed_at"))
    return D.device_relations(devices, relations, "law", "node_id").withColumn("distance", F.col("distance").cast("long"))


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Seven devices a law, and lines as what is known of the device of their number."""
    paths = F.array(*map(F.lit, ("art:1", "art:1.par:1", "art:1.par:1.inciso:I", "art:1.par:1.inciso:II", "art:10", "art:10.par:unico", "art:2")))
    lines = t.lineitem.where("l_linenumber <= 7").withColumn("law", F.col("l_orderkey")).withColumn("node_id", F.get(paths, F.col("l_linenumber").cast("int") - 1))
    return t.orders.select(F.col("o_orderkey").alias("law"), F.explode(paths).alias("node_id")), lines


@query("""
SELECT l_orderkey AS law, 'change' AS kind, l_linenumber::BIGINT AS id, strftime(l_shipdate, '%Y-%m-%d') AS sort_day FROM lineitem
UNION ALL SELECT o_orderkey, 'event', o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN '0000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders""")
def d12_timeline(t: Tables) -> DataFrame:
    changes = t.lineitem.select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_shipdate").alias("day"))
    events = t.orders.select(F.col("o_orderkey").alias("law"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("day"))
    return D.timeline(changes, events).select("law", "kind", "id", "sort_day")


@query("""
WITH j AS (SELECT l_orderkey AS law, arg_max(CASE l_linestatus WHEN 'O' THEN 'running' ELSE 'queued' END, (l_shipdate, l_linenumber, l_linestatus)) AS job FROM lineitem WHERE l_returnflag = 'A' AND l_quantity <= 25 GROUP BY 1),
s AS (SELECT o_orderkey AS law, coalesce(job, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' END, 'not_requested') AS status FROM orders LEFT JOIN j ON o_orderkey = law),
r AS (SELECT l_orderkey AS law, 'change' AS kind, CASE WHEN l_linestatus = 'O' THEN 'diff' ELSE 'relation' END AS item, l_linenumber::BIGINT AS id, strftime(l_shipdate, '%Y-%m-%d') AS sort_day FROM lineitem
UNION ALL SELECT o_orderkey, 'event', 'relation', o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN '0000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders WHERE o_orderkey % 3 <> 0)
SELECT law, status, kind, item, id, sort_day FROM r JOIN s USING (law)""")
def d12_history(t: Tables) -> DataFrame:
    """Every law's history with its overall status: lines as changes and as jobs, orders as laws and as events."""
    laws = t.orders.select(F.col("o_orderkey").alias("law"), F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("").alias("history"))
    jobs = t.lineitem.select(
        F.col("l_orderkey").alias("law"), F.struct("l_linenumber", "l_linestatus").alias("job_id"), F.when(F.col("l_returnflag") == "R", "text").otherwise("history").alias("job_type"), F.col("l_shipdate").alias("created_at"),
        F.when((F.col("l_returnflag") == "N") | (F.col("l_quantity") > 25), "done").when(F.col("l_linestatus") == "O", "running").otherwise("queued").alias("status"))
    changes = t.lineitem.select(F.col("l_orderkey").alias("law"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_shipdate").alias("day"), (F.col("l_linestatus") == "O").alias("comparable"))
    state = F.when(F.col("o_orderkey") % 3 == 0, "compared").when(F.col("o_orderkey") % 3 == 1, "discovered")
    events = t.orders.select(F.col("o_orderkey").alias("law"), F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("day"), state.alias("event_status"))
    return D.history(laws, jobs, changes, events)


@query("SELECT l_orderkey, count(*) AS relations, count(*) FILTER (l_returnflag = 'R') AS comparisons, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1")
def d13_history_counters(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("relations"), F.count_if(F.col("l_returnflag") == "R").alias("comparisons"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))


@query("""
WITH h AS (SELECT o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('law:' || o_orderkey)) AS d FROM orders)
SELECT o_orderkey, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || ['8','9','a','b'][(CASE WHEN d[17:17] BETWEEN '0' AND '9' THEN d[17:17]::INTEGER ELSE ascii(d[17:17]) - 87 END) % 4 + 1] || d[18:20] || '-' || d[21:32] AS id FROM h""")
def d14_name_ids(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", S.uuid5(F.concat(F.lit("law:"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus, coalesce(p_name, l_partkey::VARCHAR) AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""")
def d15_change_detail(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "o_orderstatus", F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("label"))


@query("""
WITH a AS (SELECT l_orderkey AS law, l_linenumber, l_returnflag AS t FROM lineitem), b AS (SELECT l_orderkey - 1 AS law, l_linenumber, l_returnflag AS t FROM lineitem WHERE l_orderkey > 1)
SELECT coalesce(a.law, b.law) AS law, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, CASE WHEN a.law IS NULL THEN 'ADD' WHEN b.law IS NULL THEN 'REVOKE' ELSE 'MODIFY' END AS operation
FROM a FULL JOIN b ON a.law = b.law AND a.l_linenumber = b.l_linenumber WHERE a.law IS NULL OR b.law IS NULL OR a.t <> b.t""")
def d16_version_diff(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("law"), "l_linenumber", F.col("l_returnflag").alias("t"))
    b = t.lineitem.where("l_orderkey > 1").select((F.col("l_orderkey") - 1).alias("law"), "l_linenumber", F.col("l_returnflag").alias("t"))
    return D.version_diff(a, b, ["law", "l_linenumber"], "t").select("law", "l_linenumber", "operation")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'UPDATE' WHEN 'N' THEN 'ADD' ELSE 'OTHER' END AS operation FROM lineitem""")
def d17_operation_labels(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "Text_Change").when(F.col("l_returnflag") == "N", "Insertion").otherwise("Unknown")
    return t.lineitem.select("l_orderkey", "l_linenumber", D.operation_label(kind).alias("operation"))


@query("""
SELECT page_id, 'urn:lex:br:federal:lei:2018-08-14;' || page_id AS urn, page_id::VARCHAR AS number, 2018 AS year FROM pages""")
def d18_urn_identity(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://example.org/?urn=urn:lex:br:federal:lei:2018-08-14;"), F.col("page_id").cast("string"), F.lit("@x"))
    urn = S.urn_of(url)
    return t.pages.select("page_id", urn.alias("urn"), S.urn_number(urn).alias("number"), S.urn_year(urn).alias("year"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'art:' || l_orderkey || '.par:' || l_linenumber || '.inciso:' || ['I','II','III','IV','V','VI','VII'][l_linenumber] END AS node_id FROM lineitem""")
def d19_device_nodes(t: Tables) -> DataFrame:
    n, k = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    path = F.concat(F.lit("art"), n, F.lit("_par"), k, F.lit("_inc"), k, F.when(F.col("l_linenumber") == 7, "_odd").otherwise(""))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.device_node(path).alias("node_id"))


# ------------------------------------------------------------------ dossiers


@query("""
SELECT l_orderkey * 10 + l_linenumber AS process_id, o_orderkey AS norm_id FROM lineitem JOIN orders ON l_linestatus = o_orderstatus AND l_orderkey = o_orderkey AND year(l_shipdate) = year(o_orderdate)""")
def h1_process_norms(t: Tables) -> DataFrame:
    processes = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lower("l_linestatus").alias("kind"), F.concat(F.lit("00"), F.col("l_orderkey").cast("string")).alias("number"), F.year("l_shipdate").alias("year"))
    norms = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").cast("string").alias("number"), F.year("o_orderdate").alias("year"))
    return H.matched_processes(processes, norms)


@query("""
SELECT l_orderkey, 'PL|' || (l_suppkey % 3) || '|' || year(l_shipdate) AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL""")
def h2_cross_references(t: Tables) -> DataFrame:
    ref = F.struct(F.when(F.col("l_returnflag") == "R", "CD").otherwise("SF").alias("house"), F.lit("pl").alias("kind"), F.concat(F.lit("0"), (F.col("l_suppkey") % 3).cast("string")).alias("number"), F.year("l_shipdate").alias("year"))
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(ref).alias("refs"))
    first = H.cross_references(nested, "l_orderkey", "refs")
    every = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", H.norm_key(F.lit("pl"), (F.col("l_suppkey") % 3).cast("string"), F.year("l_shipdate")).alias("key"))
    return first.join(every, ["l_orderkey", "key"]).groupBy("l_orderkey", "key").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS one FROM customer GROUP BY ALL), r AS (SELECT n_nationkey, s FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer UNION SELECT 'NONE'))
SELECT n_nationkey, s, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN one END AS resolved_id
FROM r LEFT JOIN c ON n_nationkey = c_nationkey AND s = c_mktsegment""")
def h3_resolved(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_mktsegment").alias("s")).distinct().unionByName(t.spark.range(1).select(F.lit("NONE").alias("s")))
    refs = names.distinct().crossJoin(F.broadcast(t.nation.select("n_nationkey")))  # 25 nations at every size
    pool = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("s"), "c_custkey")
    return H.resolved(refs, pool, ["n_nationkey", "s"], "c_custkey")


@query("""
SELECT s_suppkey, s_nationkey, seg, c_custkey FROM (SELECT s_suppkey, s_nationkey, ['BUILDING', 'MACHINERY', 'NONE'][s_suppkey % 3 + 1] AS seg FROM supplier) s
JOIN (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) c ON s_nationkey = c_nationkey AND seg = c_mktsegment WHERE n > 1""")
def h3_candidates(t: Tables) -> DataFrame:
    """What suppliers' references could mean, where several customers of their nation and a segment fit."""
    seg = F.get(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("NONE")), (F.col("s_suppkey") % 3).cast("int"))
    pool = t.customer.select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_mktsegment").alias("seg"), "c_custkey")
    return H.ambiguous(t.supplier.select("s_suppkey", "s_nationkey", seg.alias("seg")), pool, ["s_nationkey", "seg"], "c_custkey")


@query("""
SELECT l_orderkey, l_returnflag AS session, l_suppkey AS member, CASE l_linestatus WHEN 'O' THEN 'Sim' ELSE 'Abstenção' END AS vote FROM lineitem""")
def h4_ballots(t: Tables) -> DataFrame:
    vote = F.when(F.col("l_linestatus") == "O", "sim").otherwise("ABSTENCAO")
    one = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("member"), vote.alias("vote"))).alias("ballots"))
    nested = one.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("session"), "ballots")).alias("votes"))
    return H.ballots(nested, "l_orderkey", "votes")


@query("""
SELECT l_orderkey, l_linenumber, n > 3 AS truncated FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn <= 3""")
def h5_top_per_group(t: Tables) -> DataFrame:
    return top_per_group(t.lineitem, ["l_orderkey"], [F.desc("l_shipdate"), F.col("l_linenumber")], 3).select("l_orderkey", "l_linenumber", "truncated")


@query("""
SELECT o_orderkey, coalesce(status, 'no_process') AS status FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'complete' END AS status FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON o_orderkey = l_orderkey""")
def h6_dossier_status(t: Tables) -> DataFrame:
    status = H.dossier_status(t.lineitem.where("l_quantity > 10"), "l_orderkey", F.col("l_returnflag") == "R")
    return t.orders.join(status, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("status", F.lit("no_process")).alias("status"))


@query("SELECT o_custkey, count(*) AS processes, sum(k)::BIGINT AS parts FROM orders JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def h7_totals(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("parts"))
    rows = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("processes"), F.sum(F.size("parts")).alias("parts"))
