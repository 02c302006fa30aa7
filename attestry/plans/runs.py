"""Queries on runs, comparisons, transforms and sinks, on tables that stand in for evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import runs as R
from ..sources import files
from .registry import query, table


@query("SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) END AS shared FROM lineitem GROUP BY 1")
def shared_run(spark, d):
    return R.shared(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 2 ELSE 0 END AS exit_status FROM lineitem GROUP BY 1")
def exit_statuses(spark, d):
    return R.exit_status(table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "present").otherwise("absent").alias("status")), "l_orderkey")


@query("SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type)::INTEGER AS place FROM events GROUP BY 1")
def columns_first_seen(spark, d):
    return R.first_seen_columns(table(spark, d, "events"), "event_type", "event_id")


_SOURCES = [
    E.Source("numbers", "blind", lambda: F.col("p_size") > 5, lambda: F.struct(F.when(F.col("p_size") > 25, "present").otherwise("absent").alias("status"), F.col("p_size").cast("string").alias("details"))),
    E.Source("names", "manifest", lambda: F.lit(True), lambda: F.when(F.col("p_name").contains("a"), "present").otherwise("absent")),
    E.python_source("parsed", "container", lambda: F.col("p_brand").isNotNull(), lambda: F.col("p_brand"), lambda text: ("present", str(10 // (int(text[-1]) - 3)))),
]


@query("""SELECT p_partkey, 'manifest' AS layer, 'names' AS source, CASE WHEN contains(p_name, 'a') THEN 'present' ELSE 'absent' END AS status, NULL::VARCHAR AS details FROM part
UNION ALL SELECT p_partkey, 'container', 'parsed', CASE WHEN right(p_brand, 1) = '3' THEN 'inconclusive' ELSE 'present' END, CASE WHEN right(p_brand, 1) = '3' THEN 'source failed: integer division or modulo by zero' ELSE floor(10.0::DOUBLE / (right(p_brand, 1)::INTEGER - 3))::INTEGER::VARCHAR END FROM part
UNION ALL SELECT p_partkey, 'blind', 'numbers', CASE WHEN p_size > 25 THEN 'present' WHEN p_size > 5 THEN 'absent' ELSE 'not_applicable' END, CASE WHEN p_size > 5 THEN p_size::VARCHAR END FROM part""")
def inspect_failures(spark, d):
    return E.inspect(table(spark, d, "part"), _SOURCES, "p_partkey", details=True).select("p_partkey", "layer", "source", "status", "details")


@query("SELECT * FROM (VALUES (0, 'manifest', 'names'), (1, 'container', 'parsed'), (3, 'blind', 'numbers')) t(layer_ord, layer, source)")
def sources_listing(spark, d):
    return E.listing(spark, _SOURCES)


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS codes FROM orders GROUP BY 1")
def status_sets(spark, d):
    return R.status_sets(table(spark, d, "orders"), "o_custkey", "o_orderstatus").select("o_custkey", F.array_join("codes", ",").alias("codes"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS first FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, chr((64 + dense_rank() OVER (PARTITION BY l_orderkey ORDER BY first))::INTEGER) AS class FROM f""")
def route_classes(spark, d):
    return R.route_classes(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, string_agg(l_linestatus, ',' ORDER BY l_linestatus) AS x FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), b AS (SELECT l_suppkey, l_returnflag, string_agg(l_linestatus, ',' ORDER BY l_linestatus) AS y FROM lineitem WHERE l_linenumber % 4 > 0 AND l_returnflag <> 'N' GROUP BY ALL)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag, x AS expected, y AS got, CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'extra' WHEN x = y THEN 'same' ELSE 'differing' END AS outcome
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag""")
def checks_compared(spark, d):
    x = table(spark, d, "lineitem")
    return R.checks_compared(x.filter("l_linenumber < 4"), x.filter("l_linenumber % 4 > 0 AND l_returnflag <> 'N'"), ["l_suppkey", "l_returnflag"], "l_linestatus")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS length, l_linenumber * 100 AS offset_ FROM lineitem), q AS (SELECT l_orderkey, offset_, length, min_by(l_linenumber, l_linenumber) AS n FROM p WHERE l_linenumber % 2 = 1 GROUP BY ALL)
SELECT p.l_orderkey, p.l_linenumber AS part, p.offset_ AS "offset", p.length, 'part ' || n AS name FROM p LEFT JOIN q ON p.l_orderkey = q.l_orderkey AND p.offset_ = q.offset_ AND p.length = q.length""")
def named_parts(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), (F.col("l_linenumber") * 100).alias("offset"), F.col("l_quantity").cast("long").alias("length"))
    declared = p.filter("part % 2 = 1").select("l_orderkey", "offset", "length", F.concat(F.lit("part "), F.col("part").cast("string")).alias("name"), F.col("part").alias("at"))
    return R.named_parts(p, declared, "l_orderkey")


@query("""WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id % 3 > 0), b AS (SELECT DISTINCT sha256(coalesce(text, '')) AS sha, lang FROM documents) SELECT doc_id, lang AS expected FROM a JOIN b USING (sha)""")
def truth_by_hash(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return t.filter("doc_id % 3 > 0").select("doc_id", "sha").join(t.select("sha", F.col("lang").alias("expected")).distinct(), "sha").select("doc_id", "expected")


_SUITE = ["none", "jpeg_q75", "resize_0.5", "crop_0.1", "captured:phone", "flip_still"]


@query("""SELECT s_suppkey, name, kind, value, label, on_bytes FROM supplier, (VALUES ('none', 'none', NULL, NULL, true), ('jpeg_q75', 'jpeg', 75.0::DOUBLE, NULL, false), ('resize_0.5', 'resize', 0.5::DOUBLE, NULL, false), ('crop_0.1', 'crop', 0.1::DOUBLE, NULL, false), ('captured:phone', 'captured', NULL, 'phone', false), ('flip_still', 'flip_still', NULL, NULL, true)) t(name, kind, value, label, on_bytes)""")
def transform_suite(spark, d):
    return R.suite(table(spark, d, "supplier").select("s_suppkey"), _SUITE).select("s_suppkey", "transform.*")


@query("""SELECT c_custkey, substr(c_name, 1, (c_custkey % 25)::INTEGER) AS cut, substr(c_name, 1, (c_custkey % 18)::INTEGER) || chr(xor(ascii(substr(c_name, (c_custkey % 18 + 1)::INTEGER, 1)), 1)) || substr(c_name, (c_custkey % 18 + 2)::INTEGER) AS flipped
FROM customer WHERE c_custkey % 25 BETWEEN 1 AND 17""")
def byte_edits(spark, d):
    k, c = F.col("c_custkey"), F.col("c_name").cast("binary")
    return table(spark, d, "customer").filter("c_custkey % 25 BETWEEN 1 AND 17").select("c_custkey", R.cut_at(c, k % 25).cast("string").alias("cut"), R.flipped_at(c, k % 18).cast("string").alias("flipped"))


@query("SELECT p_partkey, p_brand || '__' || p_size AS writer FROM part")
def writer_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", R.writer_of(F.concat_ws("__", "p_brand", F.col("p_size").cast("string"), "p_type")).alias("writer"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_partkey % 3 = 0""")
def harvested_fingerprints(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return R.upsert(p, p.filter("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name")), "p_partkey")


@query("""SELECT o_orderkey, o_orderkey || chr(9) || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'a b' END || chr(9) || o_orderstatus AS line FROM orders""")
def tsv_lines(spark, d):
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, "")).otherwise("a\nb")
    return table(spark, d, "orders").select("o_orderkey", R.tsv_line(F.col("o_orderkey"), odd, F.col("o_orderstatus")).alias("line"))


@query("""SELECT s_nationkey, '{"summary":{"files":' || count(*) || '},"inspections":[' || string_agg('{"s_name":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS document FROM supplier GROUP BY 1""")
def batch_documents(spark, d):
    return R.document(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", ["s_name"])


@query("""SELECT r_regionkey, '<!doctype html><html><head><meta charset="utf-8"><title>' || r_name || ' &amp; &lt;all&gt;</title></head><body><table><tr><th>name</th><td>' || r_name || '</td></tr><tr><th>none</th><td>-</td></tr></table></body></html>' AS page FROM region""")
def html_reports(spark, d):
    row = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    return table(spark, d, "region").select("r_regionkey", R.html_report(F.concat("r_name", F.lit(" & <all>")), F.array(row("name", F.col("r_name")), row("none", F.lit(None).cast("string")))).alias("page"))


@query("""SELECT c_custkey, field, length(value)::INTEGER AS length, CASE WHEN field = 'segment' THEN value END AS value FROM (SELECT c_custkey, unnest(['name', 'segment']) AS field, unnest([c_name, c_mktsegment]) AS value FROM customer)""")
def metadata_listing(spark, d):
    row = lambda f, c, reveal: F.struct(F.lit(f).alias("field"), S.masked(F.col(c), reveal).alias("x"))
    x = table(spark, d, "customer").select("c_custkey", F.explode(F.array(row("name", "c_name", False), row("segment", "c_mktsegment", True))).alias("r"))
    return x.select("c_custkey", "r.field", "r.x.length", "r.x.value")


@query("""SELECT s_name AS writer, s_suppkey FROM supplier ORDER BY writer, s_suppkey""")
def stable_order(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("writer"), "s_suppkey").orderBy("writer", "s_suppkey")


@query("""SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS first_parts FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 2 GROUP BY 1""")
def capped_lists(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), 1, 2).alias("x"))
    return x.select("l_orderkey", F.array_join(F.transform("x", lambda y: y["l_partkey"].cast("string")), ",").alias("first_parts"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'generated' END AS kind, source AS name FROM documents WHERE doc_id % 4 < 3 AND source IS NOT NULL AND NOT contains(source, '/')""")
def labelled_corpus(spark, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("/set/"), F.when(k % 4 == 3, "other").when(k % 3 == 0, "real").otherwise("gen"), F.lit("-"), "source", F.lit("/"), k.cast("string"), F.lit(".JPG"))
    own = files.labelled(table(spark, d, "documents").select(path.alias("p")), F.col("p"))
    return own.select(F.regexp_extract("path", "([0-9]+)[.]JPG$", 1).cast("long").alias("doc_id"), "kind", "name")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unsupported type' WHEN doc_id % 3 = 1 THEN 'unreadable' END AS skip_reason, CASE WHEN doc_id % 3 = 2 THEN 8 WHEN doc_id % 3 = 0 THEN 5 END::BIGINT AS size_bytes FROM documents""")
def skipped_files(spark, d):
    k = F.col("doc_id")
    content = F.unhex(F.when(k % 3 == 0, "68656C6C6F").when(k % 3 == 2, "FFD8FF0000000000"))
    return files.assets(table(spark, d, "documents").select(k.cast("string").alias("path"), content.alias("content"))).select(F.col("path").cast("long").alias("doc_id"), "skip_reason", "size_bytes")


@query("SELECT s_suppkey, (s_suppkey % 4)::INTEGER AS n FROM supplier")
def trust_bundles(spark, d):
    one = F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), F.col("s_name"), F.lit("\n-----END CERTIFICATE-----\n"))
    return table(spark, d, "supplier").select("s_suppkey", files.certificates(F.repeat(one, (F.col("s_suppkey") % 4).cast("int"))).alias("n"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber % 3 > 0), r AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, count(*) FILTER (p.l_linenumber IS NULL) AS missing, count(*) FILTER (p.l_returnflag = 'R') AS failed, CASE WHEN count(*) FILTER (p.l_linenumber IS NULL) > 0 THEN 'missing' WHEN count(*) FILTER (p.l_returnflag = 'R') > 0 THEN 'failed' ELSE 'eligible' END AS outcome
FROM r LEFT JOIN p USING (l_orderkey, l_linenumber) GROUP BY 1""")
def eligible_parts(spark, d):
    x = table(spark, d, "lineitem")
    return R.eligibility(x.select("l_orderkey", "l_linenumber"), x.filter("l_linenumber % 3 > 0").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("ok")), "l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT o_orderkey, unnest(['status', 'priority']) AS field, unnest([o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END]) AS v FROM orders WHERE o_orderkey % 3 > 0),
b AS (SELECT o_orderkey, unnest(['status', 'clerk']) AS field, unnest([CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, 'c']) AS v FROM orders WHERE o_orderkey % 3 < 2),
f AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1), c AS (SELECT * FROM a WHERE o_orderkey IN (SELECT o_orderkey FROM f) AND v IS NOT NULL), e AS (SELECT * FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM f))
SELECT coalesce(c.field, e.field) AS field, c.v AS old, e.v AS new, count(*) AS n FROM c FULL JOIN e ON c.o_orderkey = e.o_orderkey AND c.field = e.field WHERE c.v IS DISTINCT FROM e.v GROUP BY ALL""")
def flattened_snapshots(spark, d):
    """Snapshots as (file, field, value) rows: fields of one side only count as changes; files of one side don't."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    flat = lambda rows, **fields: rows.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("value")) for f, c in fields.items()])).alias("x")).select("o_orderkey", "x.*").filter(F.col("value").isNotNull())
    old = flat(o.filter(k % 3 > 0), status=F.col("o_orderstatus"), priority=F.when(k % 5 != 0, F.col("o_orderpriority")))
    new = flat(o.filter(k % 3 < 2), status=F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), clerk=F.lit("c"))
    return R.flattened_changes(old, new, "o_orderkey")


@query("SELECT event_id, '{\"path\":\"p' || event_id || '\",\"label\":\"' || event_type || '\",\"sha256\":\"' || sha256(event_type) || '\"}' AS line FROM events")
def jsonl_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("path"), F.col("event_type").alias("label"), F.sha2("event_type", 256).alias("sha256"))).alias("line"))


@query("""SELECT source, sha256(string_agg(doc_id, ',' ORDER BY doc_id)) AS corpus, count(DISTINCT lang) AS n_classes, list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL))::VARCHAR AS classes FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def calibration_sets(spark, d):
    rows = table(spark, d, "documents").filter("source is not null").groupBy("source", "lang").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    x = rows.groupBy("source").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.array_sort(F.collect_set("lang")).alias("classes"))
    return x.select("source", F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("corpus"), F.size("classes").cast("long").alias("n_classes"), F.concat(F.lit("["), F.array_join("classes", ", "), F.lit("]")).alias("classes"))
