"""Queries that show the JSON query language: a document per customer, an expression per form of the language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formula as J
from .registry import query, table

# Each form: its name, an expression, and the SQL of its result as JSON text over k (a number) and n (a name).
# An error is a text that begins with "!" here, and stands in the column error there.
FORMS = [
    ("chain", "o.x", "k"),
    ("pipe", "r[*].v | [0]", "k"),
    ("slice", "l[1:3]", "'[2,null]'"),
    ("slice_back", "l[::-1]", "'[[3,' || k || '],null,2,' || k || ']'"),
    ("slice_step", "l[::0]", "!a slice of step 0"),
    ("index", "l[-1]", "'[3,' || k || ']'"),
    ("index_beyond", "l[9]", "'null'"),
    ("projection", "r[*].v", "'[' || k || ',3,null]'"),
    ("value_projection", "o.*", "'[' || k || ',\"b\"]'"),
    ("flatten", "l[]", "'[' || k || ',2,null,3,' || k || ']'"),
    ("filter", "r[?v > `2`].v", "CASE WHEN k > 2 THEN '[' || k || ',3]' ELSE '[3]' END"),
    ("negation", "!k", "CASE WHEN k = 0 THEN 'true' ELSE 'false' END"),
    ("minus", "-k", "-k"),
    ("union", "[k] ~ k", "'[' || k || ',' || k || ']'"),
    ("reference", "&k", "!an expression is no value"),
    ("if", 'if(k > `2`, "big", "small")', "CASE WHEN k > 2 THEN '\"big\"' ELSE '\"small\"' END"),
    ("if_lazy", 'if(k >= `0`, "lazy", k / `0`)', "'\"lazy\"'"),
    ("not_null", "notNull(zz, k)", "k"),
    ("length_text", "length(n)", "length(n)"),
    ("length_list", "length(l)", "4"),
    ("length_number", "length(k)", "!length() needs a text, a list or an object"),
    ("contains_text", 'contains(n, "5")', "CASE WHEN contains(n, '5') THEN 'true' ELSE 'false' END"),
    ("contains_list", "contains(l, k)", "'true'"),
    ("starts", 'startsWith(n, "Cust")', "CASE WHEN n LIKE 'Cust%' THEN 'true' ELSE 'false' END"),
    ("ends_empty", 'endsWith(n, "")', "'false'"),
    ("keys", "keys(o)", "'[\"x\",\"y\"]'"),
    ("values", "values(o)", "'[' || k || ',\"b\"]'"),
    ("spread", 'startsWith([n, "x"], "Cu")', "'[true,false]'"),
    ("add_lists", "k + [1, 2]", "'[' || (k + 1) || ',' || (k + 2) || ']'"),
    ("coerced", '"7" + k', "(k + 7) || '.0'"),
    ("concatenated", '"a" & k', "'\"a' || k || '\"'"),
    ("hash", "{a: k, b: o.y}", "'{\"a\":' || k || ',\"b\":\"b\"}'"),
    ("global", "$low + k", "k + 1"),
    ("and", "k == `5` && n", "CASE WHEN k = 5 THEN '\"' || n || '\"' ELSE 'false' END"),
    ("helper", "twice(k)", "2 * k"),
    ("unknown", "nosuch(k)", "!no function nosuch()"),
    ("arity", "length()", "!length() takes 1 arguments"),
]

_ROWS = " UNION ALL ".join(
    f"SELECT id, '{name}' AS form, " + (f"NULL::VARCHAR AS value, '{sql[1:]}' AS error FROM c" if sql[0] == "!" else f"({sql})::VARCHAR AS value, NULL::VARCHAR AS error FROM c") for name, _, sql in FORMS
)


@query(f"WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS k, c_name AS n FROM customer) {_ROWS}")
def formula_forms(spark, d):
    k, n = F.col("c_custkey") % 7, F.col("c_name")
    doc = F.format_string('{"k":%d,"n":"%s","l":[%d,2,null,[3,%d]],"o":{"x":%d,"y":"b"},"r":[{"v":%d},{"v":3},{"w":1}]}', k, n, k, k, k, k)
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), doc.alias("doc"))
    rows = J.statements(docs, "id", "doc", {name: e for name, e, _ in FORMS}, {"$low": 1}, {"twice": "$args[0] * `2`"})
    return rows.select("id", F.col("statement").alias("form"), "value", "error")
