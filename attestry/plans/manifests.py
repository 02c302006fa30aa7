"""Queries on manifests and scalar rules, on tables that stand in for stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manifests as M
from .registry import query, table


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 > 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN 'remote' END, '-') AS manifest,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_orderkey % 4 = 1 THEN 'present' WHEN o_orderkey % 4 = 2 THEN o_orderstatus ELSE o_orderstatus || ',' || o_orderpriority END AS xmp,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'b' END) || CASE WHEN o_orderkey % 5 = 1 THEN ' one step back' ELSE ' ' || (o_orderkey % 5 + 0) || ' steps back' END
    ELSE o_orderpriority || ' (lineage: ' || (CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'b' END) || CASE WHEN o_orderkey % 5 = 1 THEN ' one step back' ELSE ' ' || (o_orderkey % 5) || ' steps back' END || ')' END AS terms
FROM orders WHERE o_orderkey % 5 > 0""")
def manifest_cells(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").filter(k % 5 > 0)
    terms = F.when(k % 4 == 2, F.array("o_orderstatus")).when(k % 4 == 3, F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    behind = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    own = F.when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    return o.select(
        "o_orderkey", M.manifest_cell(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(k % 3 == 0, F.lit("https://x"))).alias("manifest"),
        M.xmp_cell(k % 7 != 0, F.when(k % 4 != 0, k % 4), terms).alias("xmp"), M.manifest_terms(own, F.when(k % 3 != 0, k % 5), behind).alias("terms"),
    )


_CODES = ["timeStamp.trusted", "timeStamp.untrusted", "timeStamp.mismatch", "timeStamp.validated", "claimSignature.validated", "signingCredential.expired", "assertion.dataHash.mismatch"]


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, list_filter([{", ".join(f"CASE WHEN (l_partkey // {2 ** i}) % 2 = 1 THEN '{c}' END" for i, c in enumerate(_CODES))}], lambda x: x IS NOT NULL) AS codes, strftime(l_shipdate, '%Y-%m-%d') AS day, l_suppkey FROM lineitem),
s AS (SELECT *, list_sort(list_filter(codes, lambda x: x LIKE 'timeStamp.%')) AS ts FROM c),
t AS (SELECT *, CASE WHEN list_contains(ts, 'timeStamp.trusted') THEN 'trusted' WHEN list_contains(ts, 'timeStamp.untrusted') THEN 'untrusted' WHEN list_contains(ts, 'timeStamp.mismatch') THEN 'failed' WHEN len(ts) = 0 THEN 'none' ELSE 'validated_only' END AS status FROM s)
SELECT l_orderkey, l_linenumber, array_to_string(ts, ',') AS codes, status, list_contains(codes, 'signingCredential.expired') AND NOT list_contains(codes, 'assertion.dataHash.mismatch') AND NOT list_contains(codes, 'timeStamp.mismatch') AND NOT list_contains(codes, 'claimSignature.validated') AS expired_only,
  CASE status WHEN 'none' THEN 'No time-stamp: a check after ' || day || ' reports the certificate expired.' WHEN 'untrusted' THEN 'The time-stamp''s authority is not trusted: a check after ' || day || ' reports the certificate expired.' || CASE WHEN l_suppkey % 2 = 0 THEN ' Under a list that trusts it, the certificate counts as of ' || day || '.' ELSE '' END
    WHEN 'failed' THEN 'The time-stamp did not validate: a check after ' || day || ' reports the certificate expired.' WHEN 'validated_only' THEN 'Nothing is known of the time-stamp''s authority: a check after ' || day || ' may report the certificate expired.' END AS note,
  'has expired' || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE ' (valid until ' || day || ')' END || CASE status WHEN 'none' THEN ' without a time-stamp' WHEN 'untrusted' THEN ' with a time-stamp of an untrusted authority' WHEN 'failed' THEN ' with a time-stamp that did not validate' WHEN 'validated_only' THEN ' with a time-stamp of an unknown authority' ELSE '' END AS phrase
FROM t""")
def time_stamps(spark, d):
    x = table(spark, d, "lineitem")
    has = lambda some: F.array_compact(F.array(*[F.when(F.floor(F.col("l_partkey") / 2**i) % 2 == 1, F.lit(c)) for i, c in enumerate(_CODES) if i in some]))
    x = x.withColumns({"failure": has((1, 2, 5, 6)), "success": has((0, 3)), "note_codes": has((4,)), "day": F.date_format("l_shipdate", "yyyy-MM-dd")})
    ts = M.status_codes([F.col("success"), F.col("note_codes"), F.col("failure")], "timeStamp.")
    x = x.withColumn("ts", ts).withColumn("status", M.time_stamp_status(F.col("ts")))
    stated = F.when(F.col("l_suppkey") % 2 == 0, F.col("day"))
    return x.select(
        "l_orderkey", "l_linenumber", F.array_join("ts", ",").alias("codes"), "status", M.expired_only(F.concat("failure", "note_codes")).alias("expired_only"), M.validity_note(F.col("status"), F.col("day"), stated).alias("note"),
        M.expired_phrase(F.col("status"), F.when(F.col("l_suppkey") % 3 != 0, F.col("day"))).alias("phrase"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'present' WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'present' ELSE 'inconclusive' END WHEN o_orderkey % 4 = 2 THEN 'inconclusive' WHEN o_orderkey % 5 = 0 THEN 'inconclusive' ELSE 'absent' END AS status FROM orders""")
def manifest_statuses(spark, d):
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "Trusted").when(k % 4 == 1, "Invalid").when(k % 4 == 2, "Valid")
    return table(spark, d, "orders").select("o_orderkey", M.manifest_status(state, F.when(k % 5 == 0, F.lit("https://x")), F.when(k % 3 == 0, "match_trusted").otherwise("match")).alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN substr(sha256(p_name), 1, 12) ELSE 'x ' || p_brand || '.png' END AS name, CASE WHEN length(p_name) <= 10 THEN p_name ELSE '…' || right(p_name, 9) END AS short FROM part""")
def display_names(spark, d):
    path = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("/a/b/x "), "p_brand", F.lit(".png")))
    return table(spark, d, "part").select("p_partkey", M.display_name(path, F.sha2("p_name", 256)).alias("name"), M.truncated(F.col("p_name"), 10).alias("short"))


_VALUES = ["' N/A '", "'0000'", "'Yes'", "'0'", "' false'", "p_name", "'--'", "'TRUE '", "'unknown'", "''"]


@query(f"""WITH v AS (SELECT p_partkey, p_size, CASE p_partkey % 10 {" ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VALUES))} END AS v FROM part)
SELECT p_partkey, v, lower(trim(v)) IN ('', 'n/a', 'na', 'none', 'unknown', 'null', '-', '--') OR regexp_matches(trim(v), '^0+$') AS placeholder,
  CASE WHEN lower(trim(v)) IN ('yes', 'true', '1') THEN true WHEN lower(trim(v)) IN ('no', 'false', '0') THEN false END AS says,
  regexp_replace('0000' || printf('%08X', p_partkey), '^(00)+([0-9A-F][0-9A-F])', '\\2') AS serial, format('{{:,}}', p_partkey * 1000 + p_size) AS grouped,
  list_transform(string_split_regex('1.' || p_size || '-rc', '[.+-]'), lambda x: coalesce(try_cast(x AS BIGINT), 0)) < [1, (p_partkey % 50), 7] AS older
FROM v""")
def scalar_rules(spark, d):
    k = F.col("p_partkey")
    other = [F.lit(v.strip("'")) if v[0] == "'" else F.col(v) for v in _VALUES]
    v = F.element_at(F.array(*other), (k % 10 + 1).cast("int"))
    raw = F.unhex(F.concat(F.lit("0000"), F.format_string("%08X", k)))
    x = table(spark, d, "part").withColumn("v", v)
    return x.select(
        "p_partkey", "v", S.is_placeholder(F.col("v")).alias("placeholder"), S.says(F.col("v")).alias("says"), S.serial_hex(raw).alias("serial"), S.thousands(k * 1000 + F.col("p_size")).alias("grouped"),
        S.version_lt(F.format_string("1.%d-rc", "p_size"), F.format_string("1.%d.7", k % 50)).alias("older"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE printf('%.5f', s_suppkey % 10 + (s_suppkey % 60) / 60.0::DOUBLE + 30 / 3600.0::DOUBLE) || ' N, ' || printf('%.5f', (s_suppkey % 180)::DOUBLE + 0.5::DOUBLE) || CASE WHEN s_suppkey % 2 = 0 THEN ' E' ELSE '' END END AS place,
  sha256(unhex(lpad('', 128, '5c') || '')) IS NOT NULL AS hashed, CASE WHEN s_suppkey % 3 = 0 THEN 'DMI-ALLOWED' WHEN s_suppkey % 3 = 1 THEN 'DMI-X' ELSE 'http://other/DMI-X' END AS code,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS decoded, 'synthetic' || CASE WHEN s_suppkey % 2 = 0 THEN '_x' ELSE '' END AS label
FROM supplier""")
def scalar_texts(spark, d):
    k = F.col("s_suppkey")
    zero = k % 10 == 0
    lat = F.when(zero, F.lit(0.0)).otherwise(S.gps_degrees(k % 10, k % 60, F.lit(30)))
    lon = F.when(zero, F.lit(0.0)).otherwise((k % 180).cast("double") + F.lit(0.5))
    uri = "http://ns.useplus.org/ldf/vocab/"
    raw = F.when(k % 3 == 0, F.lit(f" {uri}DMI-ALLOWED")).when(k % 3 == 1, F.lit("DMI-X ")).otherwise(F.lit("http://other/DMI-X"))
    coded = F.when(k % 4 == 0, F.lit("no base64!")).otherwise(F.base64(F.col("s_name").cast("binary")))
    label = F.when(k % 2 == 0, F.concat(F.lit("synthetic_x_"), k.cast("string"))).otherwise(F.concat(F.lit("synthetic_"), k.cast("string")))
    return table(spark, d, "supplier").select(
        "s_suppkey", S.gps_text(lat, F.lit("N"), lon, F.when(k % 2 == 0, "E").otherwise("")).alias("place"), S.hmac_sha256(b"key", F.col("s_name")).isNotNull().alias("hashed"),
        S.without_prefix(raw, uri).alias("code"), S.decoded(coded).cast("string").alias("decoded"), S.signal_label(label).alias("label"),
    )


@query(f"""SELECT c_custkey, sha256(unhex('{bytes(b ^ 0x5C for b in b"attestry".ljust(64, b"\0")).hex()}' || sha256(unhex('{bytes(b ^ 0x36 for b in b"attestry".ljust(64, b"\0")).hex()}' || hex(c_name::BLOB))))) AS fingerprint FROM customer""")
def value_fingerprints(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.hmac_sha256(b"attestry", F.col("c_name")).alias("fingerprint"))


_HEADS = [("FFD8FFE0", "image", "image/jpeg"), ("89504E470D0A1A0A", "image", "image/png"), ("52494646000000005745425000", "image", "image/webp"), ("52494646000000005741564500", "audio", "audio/wav"), ("664C6143", "audio", "audio/flac"), ("494433", "audio", "audio/mpeg"), ("FFE3", "audio", "audio/mpeg"),
          ("00000018667479706D69663100", "image", "image/heif"), ("000000186674797069736F6D00", "video", "video/mp4"), ("1A45DFA3", "video", "video/webm"), ("5249464600000000", None, None), ("3C68746D6C3E", None, None), ("0000001866747970", None, None)]


@query(f"""SELECT doc_id, CASE doc_id % {len(_HEADS)} {" ".join(f"WHEN {i} THEN '{m}'" for i, (_, m, _) in enumerate(_HEADS) if m)} END AS modality, CASE doc_id % {len(_HEADS)} {" ".join(f"WHEN {i} THEN '{t}'" for i, (_, _, t) in enumerate(_HEADS) if t)} END AS mime,
  sha256(unhex(CASE doc_id % {len(_HEADS)} {" ".join(f"WHEN {i} THEN '{x}'" for i, (x, _, _) in enumerate(_HEADS))} END)) AS sha256 FROM documents""")
def sniff_bytes(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x, _, _ in _HEADS]), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    c = table(spark, d, "documents").select("doc_id", F.unhex(head).alias("content"))
    return c.select("doc_id", S.sniff(F.col("content")).alias("s"), F.sha2("content", 256).alias("sha256")).select("doc_id", "s.modality", "s.mime", "sha256")
