"""Queries on containers: bytes and packets are built from the tables' columns, parsed, and held against the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import lineage as L
from ..sources import coefficients, embedded, heif, images, layouts, pixels, xmp
from .registry import query, table

# --- JPEG ---------------------------------------------------------------------------------------

_Q = "(p_partkey % 100 + 1)"
_SAMPLING = [("11", "4:4:4"), ("21", "4:2:2"), ("22", "4:2:0")]
_ORDERED = [[t[i] for i in images.ZIGZAG] for t in (images.LUMA, images.CHROMA)]


def _sql_table(values: list[int], head: str) -> str:
    return f"list_aggregate(list_transform({values}, lambda s: '{head}' || printf('%02X', greatest(1, least(255, (s * scale + 50) // 100)))), 'string_agg', '')"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size, p_partkey % 7 = 0 AS adobe, p_partkey % 5 = 0 AS odd, p_partkey % 2 AS base, CASE WHEN {_Q} < 50 THEN 5000 // {_Q} ELSE 200 - 2 * {_Q} END AS scale, {_Q} AS q FROM part),
h AS (SELECT *, CASE WHEN odd THEN repeat('00' || printf('%02X', k % 200 + 2), 64) ELSE {_sql_table(_ORDERED[0], "00")} END AS t0, {_sql_table(_ORDERED[1], "00")} AS t1,
  CASE k % 3 WHEN 0 THEN '11' WHEN 1 THEN '21' ELSE '22' END AS hv FROM p)
SELECT k AS p_partkey, CASE WHEN k % 11 = 0 THEN 'a segment''s length is wrong' END AS error, CASE WHEN k % 11 > 0 THEN p_size * 8 END::INTEGER AS width, CASE WHEN k % 11 > 0 THEN k % 4096 + 1 END::INTEGER AS height,
  CASE WHEN k % 11 > 0 THEN CASE k % 3 WHEN 0 THEN '4:4:4' WHEN 1 THEN '4:2:2' ELSE '4:2:0' END END AS subsampling, CASE WHEN k % 11 > 0 THEN CASE base WHEN 1 THEN 'jfif' ELSE 'zero_based' END END AS id_style,
  CASE WHEN k % 11 > 0 AND NOT odd THEN q END::INTEGER AS quality, CASE WHEN k % 11 > 0 THEN CASE WHEN adobe THEN 'adobe' WHEN odd THEN 'non_standard' ELSE 'libjpeg' END END AS encoder, CASE WHEN k % 11 > 0 THEN k % 4 END::INTEGER AS trailing,
  CASE WHEN k % 11 > 0 THEN sha256(unhex(t0 || 'FF' || t1 || 'FF' || printf('%02X', base) || substr(hv, 1, 1).lpad(2, '0') || substr(hv, 2, 1).lpad(2, '0') || '00' || printf('%02X', base + 1) || '010101' || printf('%02X', base + 2) || '010101' || '0000' || CASE WHEN adobe THEN '01EE' ELSE '00' END || 'DBDBC0DA')) END AS fingerprint,
  CASE WHEN k % 11 = 0 THEN 'inconclusive' WHEN adobe OR NOT odd THEN 'present' ELSE 'absent' END AS status
FROM h""")
def jpeg_writers(spark, d):
    k, q = F.col("p_partkey"), F.col("p_partkey") % 100 + 1
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(F.lit(200) - q * 2)
    two = lambda x: F.format_string("%02X", x.cast("int"))
    scaled = lambda t: F.array_join(F.transform(F.array(*map(F.lit, t)), lambda s: two(F.greatest(F.lit(1), F.least(F.lit(255), F.floor((s * scale + 50) / 100))))), "")
    first = F.when(k % 5 == 0, F.repeat(two(k % 200 + 2), F.lit(64))).otherwise(scaled(_ORDERED[0]))
    sampling = F.element_at(F.array(*[F.lit(x) for x, _ in _SAMPLING]), (k % 3 + 1).cast("int"))
    ids = [two(k % 2 + i) for i in range(3)]
    text = F.concat(
        F.lit("FFD8"), F.when(k % 7 == 0, "FFEE000E41646F6265" + "00" * 7).otherwise(""), F.lit("FFDB004300"), first, F.lit("FFDB004301"), scaled(_ORDERED[1]), F.lit("FFC0001108"), F.format_string("%04X", (k % 4096 + 1).cast("int")),
        F.format_string("%04X", F.col("p_size") * 8), F.lit("03"), ids[0], sampling, F.lit("00"), ids[1], F.lit("1101"), ids[2], F.lit("1101"), F.lit("FFDA0000FFD9"), F.repeat(F.lit("00"), (k % 4).cast("int")),
    )
    content = F.unhex(F.when(k % 11 == 0, F.lit("FFD8FFDB004300")).otherwise(text))
    x = table(spark, d, "part").select("p_partkey", images.jpeg(content).alias("x"))
    status = images.jpeg_status(F.col("x"), F.lit(None).cast("string"))
    return x.select("p_partkey", *[f"x.{c}" for c in ("error", "width", "height", "subsampling", "id_style", "quality", "encoder", "trailing", "fingerprint")], status.alias("status"))


# --- PNG ----------------------------------------------------------------------------------------

_SIGN = images.PNG_SIGN.hex().upper()


@query("""WITH p AS (SELECT p_partkey AS k, p_size, p_type, p_partkey % 13 = 0 AS bad, (p_partkey % 4)::INTEGER AS n FROM part)
SELECT k AS p_partkey, CASE WHEN bad THEN 'a chunk ends early' END AS error, CASE WHEN NOT bad THEN p_size END::INTEGER AS width, CASE WHEN NOT bad THEN 'IHDR' || CASE WHEN k % 3 > 0 THEN ',tEXt' ELSE '' END || repeat(',IDAT', n) || ',IEND' END AS chunks,
  CASE WHEN NOT bad THEN n END AS idat_chunks, CASE WHEN NOT bad AND n >= 2 THEN p_size END::INTEGER AS idat_block, CASE WHEN NOT bad AND n >= 2 AND p_size > 2 THEN 'stored' END AS deflate,
  CASE WHEN NOT bad THEN sha256(unhex('4948445200' || CASE WHEN k % 3 > 0 THEN '7445587400' ELSE '' END || CASE WHEN n > 0 THEN '4944415400' ELSE '' END || '49454E4400' || '080600' || CASE WHEN k % 3 > 0 THEN '536F66747761726501' ELSE '' END)) END AS fingerprint,
  CASE WHEN NOT bad AND k % 3 > 0 AND contains(lower(p_type), 'brass') THEN 'present' ELSE 'inconclusive' END AS status, CASE WHEN NOT bad THEN n >= 2 AND p_size = 7 END AS in_sevens, CASE WHEN NOT bad THEN n = 1 END AS small
FROM p""")
def png_writers(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    chunk = lambda name, data: F.concat(F.format_string("%08X", (F.length(data) / 2).cast("int")), F.lit(name.encode().hex().upper()), data, F.lit("00000000"))
    n = (k % 4).cast("int")
    data = F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: chunk("IDAT", F.repeat(F.lit("00"), F.when(i < n, size).otherwise(1)))), "")
    text = F.when(k % 3 > 0, chunk("tEXt", F.concat(F.lit("536F66747761726500"), F.hex(F.col("p_type").cast("binary"))))).otherwise("")
    head = chunk("IHDR", F.concat(F.format_string("%08X", size), F.lit("000000010806000000")))
    content = F.unhex(F.when(k % 13 == 0, F.lit(_SIGN + "000000FF49484452")).otherwise(F.concat(F.lit(_SIGN), head, text, data, chunk("IEND", F.lit("")))))
    x = table(spark, d, "part").select("p_partkey", images.png(content).alias("x"))
    generator = S.first_needle(F.array_join(F.transform("x.text", lambda t: t["value"]), " "), ["brass"])
    rule = lambda name, block: images.idat_rule(F.col("x"), name, F.lit(block)).alias({"blocks": "in_sevens"}.get(name, "small"))
    whole = F.col("x.error").isNull()
    return x.select(
        "p_partkey", "x.error", "x.width", F.array_join("x.chunks", ",").alias("chunks"), "x.idat_chunks", "x.idat_block", "x.deflate", "x.fingerprint", images.png_status(F.col("x"), generator).alias("status"),
        F.when(whole, rule("blocks", 7)).alias("in_sevens"), F.when(whole, rule("single_small", 1000)).alias("small"),
    )


@query("""SELECT p_partkey, NOT ((p_size = p_partkey % 9 AND p_size + 1 = p_partkey % 7) OR (p_size = p_partkey % 7 AND p_size + 1 = p_partkey % 9)) AS conflict FROM part""")
def dimension_conflicts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", images.dims_conflict(F.col("p_size"), F.col("p_size") + 1, k % 9, k % 7).alias("conflict"))


# --- XMP ----------------------------------------------------------------------------------------

_PLUS = "http://ns.useplus.org/ldf/xmp/1.0/"
_CODES = ["DMI-ALLOWED", "DMI-PROHIBITED", "DMI-&#x41;BC", "  two &amp;  words "]
_SEEN = ["DMI-ALLOWED", "DMI-PROHIBITED", "DMI-ABC", "two & words"]
_KINDS = {"DMI-ALLOWED": "allowing", "DMI-PROHIBITED": "prohibiting", "two & words": "allowing"}


def _packets(spark, d):
    k = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.floor(k / 6) % 4 + 1).cast("int"))
    form = F.element_at(
        F.array(
            F.concat(F.lit(" plus:DataMining = '"), code, F.lit("'>")), F.concat(F.lit("><plus:DataMining>"), code, F.lit("</plus:DataMining>")), F.concat(F.lit('><plus:DataMining rdf:resource="'), code, F.lit('"/>')),
            F.concat(F.lit(" xmlns:DataMining='x' plus:DataMiningOther='"), code, F.lit("'><plus:DataMining/>")), F.concat(F.lit("><plus:DataMining><rdf:Alt><rdf:li>"), code, F.lit("</rdf:li></rdf:Alt></plus:DataMining>")),
            F.concat(F.lit(" plus:DataMining='DMI-PROHIBITED'><plus:DataMining>"), code, F.lit("</plus:DataMining>")),
        ),
        (k % 6 + 1).cast("int"),
    )
    text = F.concat(F.lit(f"<rdf:RDF xmlns:plus='{_PLUS}'><rdf:Description"), form, F.lit("</rdf:Description></rdf:RDF>"))
    return table(spark, d, "events").select("event_id", xmp.properties(text, ["DataMining"], {"plus": _PLUS}, nested=True).alias("found"))


_SEEN_SQL = "CASE (event_id // 6) % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_SEEN)) + " END"
_FOUND_SQL = f"""WITH v AS (SELECT event_id, {_SEEN_SQL} AS v, event_id % 6 AS f FROM events),
 x AS (SELECT event_id, f, CASE WHEN f = 3 THEN [] WHEN f = 5 THEN ['DMI-PROHIBITED', v] ELSE [v] END AS vs FROM v)"""


@query(_FOUND_SQL + f""" SELECT event_id, len(vs)::INTEGER AS n, array_to_string(vs, '|') AS values, CASE f WHEN 0 THEN 'attribute' WHEN 2 THEN 'resource' WHEN 3 THEN '' WHEN 5 THEN 'attribute|element' ELSE 'element' END AS forms,
  CASE WHEN len(vs) > 0 THEN '{_PLUS}' END AS namespace FROM x""")
def xmp_properties(spark, d):
    join = lambda c: F.array_join(F.transform("found", lambda x: x[c]), "|")
    return _packets(spark, d).select("event_id", F.size("found").alias("n"), join("value").alias("values"), join("form").alias("forms"), F.get("found", F.lit(0))["namespace"].alias("namespace"))


@query(_FOUND_SQL + """ SELECT event_id, CASE WHEN list_contains(vs, 'DMI-ABC') THEN 'inconclusive' WHEN list_contains(vs, 'DMI-PROHIBITED') AND (list_contains(vs, 'DMI-ALLOWED') OR list_contains(vs, 'two & words')) THEN 'inconclusive'
  WHEN list_contains(vs, 'DMI-PROHIBITED') THEN 'present' WHEN event_id % 5 = 0 THEN 'inconclusive' ELSE 'absent' END AS status FROM x""")
def data_mining_reservation(spark, d):
    values = F.transform("found", lambda x: x["value"])
    return _packets(spark, d).select("event_id", xmp.ladder(values, _KINDS, "prohibiting", ("prohibiting", "allowing"), F.col("event_id") % 5 == 0).alias("status"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'inconclusive' WHEN o_orderkey % 4 = 1 THEN 'present' WHEN o_orderkey % 4 = 2 THEN 'absent' ELSE 'inconclusive' END AS status FROM orders""")
def vendor_flags(spark, d):
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, F.array(F.lit("Yes"), F.lit("0"))).when(k % 4 == 1, F.array(F.lit(" TRUE"))).when(k % 4 == 2, F.array(F.lit("no"))).otherwise(F.array(F.lit("perhaps")))
    read = F.transform(said, lambda v: F.coalesce(S.says(v).cast("string"), F.lit("other")))
    return table(spark, d, "orders").select("o_orderkey", xmp.ladder(read, {"true": "yes", "false": "no"}, "yes", ("yes", "no")).alias("status"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'inconclusive' WHEN c_custkey % 5 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'inconclusive' ELSE 'absent' END WHEN c_custkey % 5 = 2 AND length(c_name) < 18 THEN 'inconclusive' ELSE 'present' END AS status FROM customer""")
def rights_agreement(spark, d):
    k, a = F.col("c_custkey"), F.col("c_name")
    copy = F.when(k % 5 == 0, F.lit("another")).when(k % 5 == 2, F.substr(a, F.lit(1), F.lit(14))).otherwise(a)  # 14 + 4 > 17: cut near the limit
    agree = xmp.copies_agree(a, copy, 17) & ~((k % 5 == 2) & (F.length(a) < 18))
    status = F.when(k % 5 == 1, F.when(k % 2 == 0, "inconclusive").otherwise("absent")).when(agree, "present").otherwise("inconclusive")
    return table(spark, d, "customer").select("c_custkey", status.alias("status"))


@query("""WITH i AS (SELECT s_suppkey, unnest(['document', 'instance', 'serial']) AS kind, unnest([s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'n/a' ELSE s_name END, CASE WHEN s_suppkey % 3 = 0 THEN '0000' ELSE s_suppkey::VARCHAR END]) AS value FROM supplier)
SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM i WHERE NOT (value IN ('n/a') OR regexp_matches(value, '^0+$')) GROUP BY kind""")
def embedded_identifiers(spark, d):
    k, name = F.col("s_suppkey"), F.col("s_name")
    row = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    found = F.explode(F.array(row("document", name), row("instance", F.when(k % 2 == 0, "n/a").otherwise(name)), row("serial", F.when(k % 3 == 0, "0000").otherwise(k.cast("string")))))
    rows = table(spark, d, "supplier").select(found.alias("x")).select("x.*").filter(~S.is_placeholder(F.col("value")))
    distinct = rows.distinct().groupBy(F.col("kind").alias("of")).agg(F.count(F.lit(1)).alias("n_values"))
    return xmp.kind_counts(rows, "kind").join(distinct, F.col("kind") == F.col("of")).select("kind", "n", "n_values")


# --- stores ---------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) - 1 AS depth, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
w AS (SELECT *, CASE role WHEN 'assistant' THEN 'trainedAlgorithmicMedia' WHEN 'user' THEN 'digitalCapture' END AS code FROM t WHERE depth < 16),
c AS (SELECT conv_id, code, min(depth) AS d FROM w WHERE code IS NOT NULL AND depth > 0 GROUP BY ALL)
SELECT conv_id, max(least(n, 16))::INTEGER AS n_steps, count(*) FILTER (i % 3 = 2)::INTEGER AS n_inputs, coalesce(string_agg('x' || i, ',' ORDER BY depth) FILTER (i % 3 = 2), '') AS missing, max(n) > 16 AS truncated,
  min(depth) FILTER (role = 'assistant')::INTEGER AS generative_depth, coalesce((SELECT string_agg(code, ',' ORDER BY d) FROM c WHERE c.conv_id = w.conv_id), '') AS parent_codes,
  string_agg(CASE role WHEN 'assistant' THEN 'generative AI creation' WHEN 'user' THEN 'camera capture' ELSE 're-encode' END || CASE WHEN depth = 0 THEN ' = this file' ELSE '' END, ' → ' ORDER BY depth DESC) AS summary
FROM w GROUP BY conv_id""")
def lineage_stores(spark, d):
    """A store per conversation: a manifest per turn, each the parent of the next."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    label = lambda i: F.concat(F.lit("m"), i.cast("string"))
    link = lambda to, how: F.struct(to.alias("active_manifest"), F.lit(how).alias("relationship"))
    code = lambda x: F.when(x["role"] == "assistant", "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia").when(x["role"] == "user", "digitalCapture/ ")
    action = lambda x: F.struct(F.when(x["role"] == "system", "c2pa.opened").when(x["role"] == "tool", "c2pa.opened").otherwise("c2pa.created").alias("action"), code(x).alias("digitalSourceType"))
    manifest = lambda x, i: F.struct(
        label(i).alias("key"),
        F.struct(
            F.array_compact(F.array(F.when(i > 0, link(label(i - 1), "parentOf")), F.when(i % 3 == 2, link(F.concat(F.lit("x"), i.cast("string")), "componentOf")))).alias("ingredients"),
            F.array(F.struct(F.lit("c2pa.actions.v2").alias("label"), F.struct(F.array(action(x)).alias("actions")).alias("data"))).alias("assertions"),
        ).alias("value"),
    )
    store = F.to_json(F.struct(label(F.size("turns") - 1).alias("active_manifest"), F.map_from_entries(F.transform("turns", manifest)).alias("manifests")))
    x = t.select("conv_id", L.lineage(store).alias("x"))
    return x.select("conv_id", "x.n_steps", "x.n_inputs", F.array_join("x.missing", ",").alias("missing"), "x.truncated", "x.generative_depth", F.array_join("x.parent_codes", ",").alias("parent_codes"), "x.summary")


# --- embedded metadata and layouts --------------------------------------------------------------------

#: A complete JPEG without metadata: a table, a scan of eight bytes, its end.
_SMALL = "FFDB004300" + "10" * 64 + "FFDA0002" + "11" * 8 + "FFD9"


def _segment(marker: str, data):
    return F.concat(F.lit("FF" + marker), F.format_string("%04X", (F.length(data) / 2).cast("int") + 2), data)


def _hex(text) -> object:
    return F.hex(text.cast("binary")) if not isinstance(text, str) else F.lit(text.encode().hex().upper())


def _field(tag: str, kind: int, count, value):
    return F.concat(F.lit(tag + f"{kind:04X}"), F.format_string("%08X", count.cast("int") if not isinstance(count, int) else F.lit(count)), value)


@query("""SELECT p_partkey, p_brand AS make, CASE WHEN p_partkey % 3 = 0 THEN 'midjourney v6' ELSE p_type END AS software, p_size::INTEGER AS width, (p_size + 1)::INTEGER AS height, p_name AS program, 'v' || p_size AS version, 'sRGB ' || p_name AS profile, '4.3' AS profile_version,
  '<x ' || p_name || '/>' AS xmp, p_partkey % 2 = 0 AS xmp_incomplete,
  CASE WHEN p_partkey % 3 = 0 THEN 'present' WHEN p_size % 5 <> 0 OR (p_partkey % 4 = 0) THEN 'inconclusive' ELSE 'absent' END AS status
FROM part""")
def embedded_metadata(spark, d):
    """JPEGs with EXIF, XMP (ordinary and extended), IPTC datasets and an ICC profile, all in one pass."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    software = F.when(k % 3 == 0, "midjourney v6").otherwise(F.col("p_type"))
    eight = lambda x: F.format_string("%08X", x)
    make, tool = F.concat(_hex(F.col("p_brand")), F.lit("00")), F.concat(_hex(software), F.lit("00"))
    n_make, n_tool = F.octet_length("p_brand") + 1, F.octet_length(software) + 1
    # TIFF: header (8), directory of three (2 + 36 + 4) to 50, sub-directory of two (2 + 24 + 4) to 80, then the texts
    tiff = F.concat(
        F.lit("4D4D002A000000080003"), _field("010F", 2, n_make, eight(F.lit(80))), _field("0131", 2, n_tool, eight(F.lit(80) + n_make)), _field("8769", 4, 1, F.lit("00000032")), F.lit("00000000"),
        F.lit("0002"), _field("A002", 4, 1, eight(size)), _field("A003", 4, 1, eight(size + 1)), F.lit("00000000"), make, tool,
    )
    dataset = lambda n, text: F.concat(F.lit(f"1C02{n:02X}"), F.format_string("%04X", F.octet_length(text)), _hex(text))
    program, version, profile = F.col("p_name"), F.concat(F.lit("v"), size.cast("string")), F.concat(F.lit("sRGB "), F.col("p_name"))
    sets = F.concat(dataset(65, program), dataset(70, version))
    resource = F.concat(F.lit("3842494D04040000"), eight((F.length(sets) / 2).cast("int")), sets)
    said = F.concat(F.lit("6465736300000000"), eight(F.octet_length(profile) + 1), _hex(profile), F.lit("00"))
    icc = F.concat(F.lit("00" * 8 + "0430" + "00" * 2 + "6D6E7472" + "52474220" + "00" * 16 + "61637370" + "00" * 88 + "00000001" + "64657363" + "00000090"), eight((F.length(said) / 2).cast("int")), said)
    packet = F.concat(F.lit("<x "), F.col("p_name"), F.lit("/>"))
    half = F.floor(F.length("p_name") / 2).cast("int")
    extended = lambda begin, text, whole: _segment("E1", F.concat(_hex("http://ns.adobe.com/xmp/extension/\0" + "G" * 32), eight(whole), eight(begin), _hex(text)))
    whole = F.octet_length("p_name")
    parts = F.concat(extended(half, F.substr(F.col("p_name"), half + 1, whole), whole), F.when(k % 2 == 0, "").otherwise(extended(F.lit(0), F.substr(F.col("p_name"), F.lit(1), half), whole)))
    content = F.unhex(F.concat(
        F.lit("FFD8"), _segment("E1", F.concat(_hex("Exif\0\0"), tiff)), _segment("E1", F.concat(_hex("http://ns.adobe.com/xap/1.0/\0"), _hex(packet))), parts,
        _segment("E2", F.concat(_hex("ICC_PROFILE\0"), F.lit("0101"), icc)), _segment("ED", F.concat(_hex("Photoshop 3.0\0"), resource)), F.lit(_SMALL),
    ))
    x = table(spark, d, "part").select("p_partkey", "p_size", embedded.embedded(content).alias("x"))
    generator = S.first_needle(F.col("x.software"), ["midjourney", "dall-e"])
    conflict = images.dims_conflict(F.col("x.width"), F.col("x.height"), F.when(F.col("p_size") % 5 == 0, F.col("p_size")).otherwise(0), F.col("p_size") + 1)
    status = embedded.exif_status(generator, conflict, k % 4 == 0, F.col("x.maker_note"), F.lit(True), F.lit(None).cast("string"))
    return x.select(
        "p_partkey", "x.make", "x.software", "x.width", "x.height", F.col("x.iim")[65][0].alias("program"), F.col("x.iim")[70][0].alias("version"), F.col("x.icc_description").alias("profile"), F.col("x.icc_version").alias("profile_version"),
        F.col("x.xmp")[0].alias("xmp"), F.col("x.xmp_incomplete").alias("xmp_incomplete"), status.alias("status"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 6 AS f FROM part)
SELECT k AS p_partkey, CASE WHEN f = 0 THEN 'absent' WHEN f IN (1, 5) THEN 'present' ELSE 'inconclusive' END AS status, CASE f WHEN 2 THEN CASE WHEN n = 1 THEN 'item 1 is beyond the file' ELSE 'item 1 is cut short' END WHEN 3 THEN 'bytes behind the last item' WHEN 4 THEN 'an item''s length is no number' ELSE '' END AS wrong,
  CASE WHEN f IN (0, 4) THEN '' WHEN f = 2 THEN n || '/' || (n - 1) || ',0/0' WHEN f = 3 THEN n || '/' || n || ',0/0' ELSE n || '/' || n || ',0/0' END AS parts FROM p""")
def container_directories(spark, d):
    """JPEGs with a directory of items behind them: agreeing, cut short, with bytes too many, with a wrong length, and without one."""
    k, n = F.col("p_partkey"), F.col("p_size")
    f = k % 6
    item = lambda name, mime, more: F.concat(F.lit(f'<C:Item I:Semantic="{name}" I:Mime="{mime}"'), more, F.lit("/>"))
    length = F.when(f == 4, F.lit(" I:Length='many'")).otherwise(F.concat(F.lit(" I:Length='"), n.cast("string"), F.lit("'")))
    xmp_text = F.concat(F.lit(f"<x xmlns:C='{layouts.CONTAINER}' xmlns:I='{layouts.ITEM}'><C:Directory>"), item("Primary", "image/jpeg", F.lit("")), item("Depth", "application/x", length), item("Same", "application/x", F.lit(" I:Length='0'")), F.lit("</C:Directory></x>"))
    behind = F.repeat(F.lit("AB"), (n + F.when(f == 2, -1).when(f == 3, 1).otherwise(0)).cast("int"))
    content = F.unhex(F.concat(F.lit("FFD8"), F.when(f == 0, "").otherwise(_segment("E1", F.concat(_hex("http://ns.adobe.com/xap/1.0/\0"), _hex(xmp_text)))), F.lit(_SMALL), behind))
    x = table(spark, d, "part").select("p_partkey", layouts.layout(content).alias("x"))
    parts = F.array_join(F.transform("x.parts", lambda p: F.concat(p["length"].cast("string"), F.lit("/"), p["present"].cast("string"))), ",")
    return x.select("p_partkey", "x.status", F.array_join("x.wrong", "; ").alias("wrong"), parts.alias("parts"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 5 AS f FROM part)
SELECT k AS p_partkey, CASE f WHEN 0 THEN 'absent' WHEN 1 THEN 'present' ELSE 'inconclusive' END AS status, CASE f WHEN 2 THEN 'the number of images differs from the table' WHEN 3 THEN 'image 1 is cut short' WHEN 4 THEN 'image 1 is no JPEG of its length' ELSE '' END AS wrong, CASE WHEN f > 0 THEN 2 ELSE 0 END::INTEGER AS n_images FROM p""")
def mpf_indexes(spark, d):
    """JPEGs with an index of two images: agreeing, with a wrong number, with a second image cut short or not a JPEG, and without one."""
    f = F.col("p_partkey") % 5
    size = len(_SMALL) // 2 + 2
    # index: header 8, directory 2 + 24 + 4, table of 32, so the segment ends at byte 80; offsets count from the header at byte 10
    eight = lambda x: F.format_string("%08X", x)
    table_ = F.concat(F.lit("20030000" + f"{size + 78:08X}" + "00000000" + "00000000" + "00000000"), eight(F.lit(size)), F.lit(f"{size + 78 - 10:08X}" + "00000000"))
    index = F.concat(F.lit("4D4D002A00000008" + "0002" + "B0010004" + "00000001"), eight(F.when(f == 2, 3).otherwise(2)), F.lit("B0020007" + "00000020" + "00000026" + "00000000"), table_)
    second = F.when(f == 4, "AB" * size).otherwise(F.when(f == 3, "FFD8" + _SMALL[:-4]).otherwise("FFD8" + _SMALL))
    content = F.unhex(F.concat(F.lit("FFD8"), F.when(f == 0, "").otherwise(_segment("E2", F.concat(_hex("MPF\0"), index))), F.lit(_SMALL), second))
    x = table(spark, d, "part").select("p_partkey", layouts.layout(content, "mpf").alias("x"))
    return x.select("p_partkey", "x.status", F.array_join("x.wrong", "; ").alias("wrong"), F.size("x.parts").alias("n_images"))


@query("""SELECT s_suppkey, 0.0::DOUBLE AS consistent, CASE WHEN s_suppkey % 2 = 0 THEN 'inconclusive' ELSE 'absent' END AS status FROM supplier""")
def pixel_lattices(spark, d):
    """Flat planes have no lattice."""
    plane = F.array_repeat(F.col("s_suppkey").cast("float"), 64 * 64)
    x = table(spark, d, "supplier").select("s_suppkey", pixels.lattice_of(plane, F.lit(64)).alias("x"))
    status = F.when(F.col("s_suppkey") % 2 == 0, pixels.lattice_status(F.col("x"))).otherwise(pixels.lattice_status(F.col("x"), 0.1))
    return x.select("s_suppkey", "x.consistent", status.alias("status"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END::INTEGER AS n_packets, CASE WHEN p_partkey % 5 > 0 AND contains(lower(p_type), 'steel') THEN 'present' ELSE 'inconclusive' END AS status FROM part""")
def webp_writers(spark, d):
    """WebP files whose XMP names a tool: a generator is present, anything else inconclusive."""
    packet = F.concat(F.lit("<x>"), F.col("p_type"), F.lit("</x>"))
    little = lambda n: F.concat(*[F.format_string("%02X", F.floor(n / 256**i).cast("int") % 256) for i in range(4)])
    size = F.octet_length(packet)
    chunk = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(_hex("XMP "), little(size), _hex(packet), F.when(size % 2 == 1, "00").otherwise("")))
    content = F.unhex(F.concat(_hex("RIFF"), F.lit("00000000"), _hex("WEBP"), _hex("VP8 "), F.lit("0100000000" + "00"), chunk))
    x = table(spark, d, "part").select("p_partkey", embedded.embedded(content).alias("x"))
    named = S.first_needle(F.array_join("x.xmp", " "), ["steel"]).isNotNull()
    return x.select("p_partkey", F.size("x.xmp").alias("n_packets"), F.when(named, "present").otherwise("inconclusive").alias("status"))


@query("""WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, i::INTEGER AS manifest, 'c2pa.' || role AS action, 'said by ' || role AS description, CASE WHEN role = 'user' THEN 'digitalCapture' END AS code, CASE WHEN i % 2 = 0 THEN 'tool ' || i ELSE 'plain' END AS agent FROM t""")
def manifest_events(spark, d):
    """Events of all manifests of a store, one per turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    action = lambda x, i: F.struct(
        F.concat(F.lit("c2pa."), x["role"]).alias("action"), F.concat(F.lit("said by "), x["role"]).alias("description"), F.when(x["role"] == "user", "http://x/y/digitalCapture/").alias("digitalSourceType"),
        F.struct(F.when(i % 2 == 0, "tool").otherwise("plain").alias("name"), F.when(i % 2 == 0, i.cast("string")).alias("version")).alias("softwareAgent"),
    )
    one = lambda x, i: F.to_json(F.struct(F.array(F.struct(F.lit("c2pa.actions").alias("label"), F.struct(F.array(action(x, i)).alias("actions")).alias("data"))).alias("assertions")))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.posexplode(F.transform("turns", one)).alias("manifest", "text"))
    text = F.col("text")
    return t.select("conv_id", "manifest", F.explode(L.events_of(text)).alias("e")).select("conv_id", "manifest", "e.*")


@query("""SELECT o_orderkey, 'The active manifest declares ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '.' ELSE 'no source type.' END || CASE WHEN o_orderkey % 5 > 0 THEN ' A generative declaration stands ' || (o_orderkey % 5) || ' back.' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN ' Not in the store: a, b.' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN ' The walk ended after 16 steps.' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN ' Ingredients have validation failures.' ELSE '' END AS text FROM orders""")
def lineage_rationales(spark, d):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    text = L.rationale(F.lit(16), F.when(k % 2 == 0, F.array("o_orderstatus")).otherwise(none), k % 5, F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none), k % 7 == 0, k % 11 == 0)
    return table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size * 40 AS n, p_partkey % 5 AS f FROM part)
SELECT k AS p_partkey, CASE WHEN f > 0 AND n >= 1024 THEN 'absent' ELSE 'inconclusive' END AS status, CASE WHEN f > 0 THEN n END::INTEGER AS blocks, CASE WHEN f = 0 THEN 'not sequential Huffman coding' WHEN n < 1024 THEN 'too small' END AS error, CASE WHEN f > 0 AND n >= 1024 THEN 0.0::DOUBLE END AS score FROM p""")
def double_compression(spark, d):
    """Even images, a row of blocks each: two bits a block, for a table in which 0 stands for the only symbol."""
    n = (F.col("p_size") * 40).cast("int")
    f = F.col("p_partkey") % 5
    one = "0001" + "00" * 15 + "00"
    content = F.unhex(F.concat(
        F.lit("FFD8"), F.when(f == 0, "FFC2").otherwise("FFC0"), F.lit("000B080008"), F.format_string("%04X", n * 8), F.lit("01011100"), F.lit("FFC40014" + one), F.lit("FFC40014" + "10" + one[2:]), F.lit("FFDA0008010100003F00"),
        F.repeat(F.lit("00"), F.ceil(n / 4).cast("int")), F.lit("FFD9"),
    ))
    x = table(spark, d, "part").select("p_partkey", coefficients.double_compression(content).alias("x"))
    return x.select("p_partkey", "x.status", "x.blocks", "x.error", "x.score")


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_partkey % 5 AS f FROM part)
SELECT k AS p_partkey, CASE WHEN f = 0 THEN 'a box''s length is wrong' END AS error, CASE WHEN f > 0 THEN 'mif1' END AS brand, CASE WHEN f > 0 THEN 7 END::BIGINT AS primary, CASE WHEN f > 0 THEN 'hvc1,mime' END AS kinds, CASE WHEN f IN (1, 2) THEN '<x>' || p_name || '</x>' WHEN f > 0 THEN '' END AS xmp,
  CASE f WHEN 3 THEN 'item 9: an extent lies outside its source' WHEN 4 THEN 'item 9: it has no place' WHEN 0 THEN NULL ELSE '' END AS unreadable, CASE WHEN f > 0 THEN f = 2 END AS manifest FROM p""")
def heif_items(spark, d):
    """Files of two items, an image and a packet in the file's own data; with a place too far, no place, and a box too long."""
    f = F.col("p_partkey") % 5
    box = lambda kind, data: F.concat(F.format_string("%08X", (F.length(data) / 2).cast("int") + 8), _hex(kind), data)
    packet = F.concat(F.lit("<x>"), F.col("p_name"), F.lit("</x>"))
    entry = lambda number, kind, text: box("infe", F.concat(F.lit(f"02000000{number:04X}0000"), _hex(kind), _hex(text)))
    items = box("iinf", F.concat(F.lit("000000000002"), entry(7, "hvc1", "\0"), entry(9, "mime", "n\0application/rdf+xml\0")))
    length = F.format_string("%04X", F.octet_length(packet) + F.when(f == 3, 1).otherwise(0))
    # version 1, two-byte offsets and lengths, method 1: in the data box
    places = box("iloc", F.concat(F.lit("0100000022000001"), F.format_string("%04X", F.when(f == 4, 8).otherwise(9)), F.lit("000100000001"), F.lit("0000"), length))
    meta = box("meta", F.concat(F.lit("00000000"), box("hdlr", F.concat(F.lit("00" * 8), _hex("pict"), F.lit("00" * 13))), box("pitm", F.lit("000000000007")), items, places, box("idat", _hex(packet))))
    store = F.when(f == 2, box("uuid", F.lit(heif.MANIFEST.hex().upper() + "00"))).otherwise("")
    content = F.unhex(F.concat(box("ftyp", F.lit("6D69663100000000" + "6D696631")), store, meta, F.when(f == 0, "000000FF66726565").otherwise("")))
    x = table(spark, d, "part").select("p_partkey", heif.heif(content).alias("x"))
    return x.select("p_partkey", "x.error", "x.brand", "x.primary", F.array_join("x.kinds", ",").alias("kinds"), F.array_join("x.xmp", "|").alias("xmp"), F.array_join("x.unreadable", "; ").alias("unreadable"), "x.manifest")
