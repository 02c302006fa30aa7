"""Files, containers, packets, stores and sinks, each against plain Python or a round trip."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import evidence as E
from attestry.operators import lineage as L
from attestry.operators import runs as R
from attestry.sources import files, images, xmp

JPEG = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(range(1, 65)) + b"\xff\xda\x00\x00\xff\xd9"
PNG = images.PNG_SIGN + b"\0\0\0\x0dIHDR" + b"\0\0\0\x02\0\0\0\x03\x08\x06\0\0\0" + b"crc4" + b"\0\0\0\x03IDAT\x78\x9c\x02crc4" + b"\0\0\0\0IENDcrc4"


def test_scan_keeps_what_is_not_supported(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.txt", JPEG), ("b.jpg", b"plain"), ("sub/c", PNG), ("sub/empty", b""), ("d", b"RIFF")):
        (tmp_path / name).write_bytes(data)
    found = files.scan(spark, f"file://{tmp_path}")
    got = {r["path"].rsplit("/", 1)[1]: (r["mime"], r["skip_reason"]) for r in found.collect()}
    assert got == {"a.txt": ("image/jpeg", None), "b.jpg": (None, "unsupported type"), "c": ("image/png", None), "d": (None, "unsupported type")}
    assert files.supported(found).count() == 2
    with pytest.raises(ValueError, match="the input"):
        files.supported(found.filter("path like '%b.jpg'"))
    with pytest.raises(ValueError, match="none of 2"):
        files.supported(found.filter("mime is null"))
    with pytest.raises(ValueError, match="no input"):
        files.supported(found.limit(0))


def test_corpora_and_fingerprints(spark, tmp_path):
    paths = spark.createDataFrame([("x/real-cam/b.JPG",), ("gen-model/a.png",), ("other/a.png",), ("real-cam/readme.txt",)], "p string")
    own = files.labelled(paths, F.col("p"))
    assert sorted(map(tuple, own.collect())) == [("gen-model/a.png", "generated", "model"), ("x/real-cam/b.JPG", "real", "cam")]
    files.write_corpus(own, "set", f"file://{tmp_path}/c.jsonl")
    assert sorted(map(tuple, files.read_corpus(spark, f"file://{tmp_path}/c.jsonl").collect())) == sorted(map(tuple, own.collect()))
    (tmp_path / "one.json").write_text(json.dumps({"id": "s", "entries": [{"path": "p", "label": {"kind": "real", "source": "cam"}}]}))
    assert files.read_corpus(spark, f"file://{tmp_path}/one.json").first() == ("p", "real", "cam")
    entry = lambda f, w: {"fingerprint": f, "format": "jpeg", "writer": w, "class": "camera"}
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entries": [entry("1", "old"), entry("2", "z"), entry("2", "b")]}))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "entries": [entry("1", "new")]}))
    merged = files.merged_fingerprints(files.read_fingerprints(spark, f"file://{tmp_path}/a.json", 0), files.read_fingerprints(spark, f"file://{tmp_path}/b.json", 1))
    assert [(r["fingerprint"], r["writer"]) for r in merged.collect()] == [("2", "b"), ("1", "new")]
    pem = "-----BEGIN CERTIFICATE-----\nx\n-----END CERTIFICATE-----\n"
    assert spark.createDataFrame([(pem * 3 + "text -----BEGIN CERTIFICATE-----",)], "t string").select(files.certificates(F.col("t"))).first()[0] == 3


def test_broken_images(spark):
    bad = [b"", b"\xff\xd8", JPEG[:20], b"\xff\xd8\x00", PNG[:30], images.PNG_SIGN + b"\0\0\0\0IENDcrc4", None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, b binary").select("i", images.jpeg(F.col("b")).alias("j"), images.png(F.col("b")).alias("p")).collect()
    assert all(r["j"]["error"] and r["p"]["error"] for r in rows)
    r = random.Random(1)
    for _ in range(300):  # never anything but ValueError
        for parse, whole in ((images.jpeg_structure, JPEG), (images.png_structure, PNG)):
            b = bytearray(whole[: r.randrange(len(whole) + 1)])
            for _ in range(r.randint(0, 3)):
                if b:
                    b[r.randrange(len(b))] = r.randrange(256)
            try:
                parse(bytes(b))
            except ValueError:
                pass
    assert images.png_structure(PNG)["width"] == 2 and images.even_block([5, 5, 3]) == 5 and images.even_block([5, 5, 6]) is None and images.even_block([5]) is None
    assert all(images._QUALITY[0][tuple(images.scaled(images.LUMA, q))] == q for q in range(1, 101))


def test_properties_of_packets():
    find = xmp.find_property
    assert find("<a:Name>x</a:Name>", "Name") == [("a", "x", "element")]
    assert find('<d a:Name = "x" xmlns:Name="y" b:NameOther="z"/>', "Name") == [("a", "x", "attribute")]
    assert find("<a:Name/><a:Name rdf:resource='u'/><a:Name></a:Name>", "Name") == [("a", "u", "resource")]
    assert find("<a:Name><b>x</b> y</a:Name>", "Name") == [] and find("<a:Name><b>x</b> y</a:Name>", "Name", True) == [("a", "x y", "element")]
    assert find("a:Name", "Name") == [] and find("<a:Name", "Name") == [] and find("<d a:Name=x/>", "Name") == []
    assert xmp.unescape("&lt;&#65;&#x42;&nope;&#xD800;&amp;amp; &#99999999999;") == "<AB&nope;&#xD800;&amp; &#99999999999;"
    assert xmp.namespace_of("xmlns:p='u'", "p") == "u" and xmp.namespace_of("", "p") is None and xmp.prefix_bound('xmlns:p="u"', "p", "u") and len(xmp.tidy("x " * 300)) == 257


def test_walk_of_stores():
    created = lambda code: [{"label": "c2pa.actions", "data": {"actions": [{"action": "c2pa.created", "digitalSourceType": f"http://x/{code}", "softwareAgent": {"name": "n", "version": "2"}}]}}]
    store = {
        "active_manifest": "a",
        "manifests": {
            "a": {"ingredients": [{"active_manifest": "i", "relationship": "inputTo"}, {"active_manifest": "b", "relationship": "parentOf"}, {"active_manifest": "z", "relationship": "parentOf"}, {"title": "flat"}], "assertions": [{"label": "c2pa.actions.v2", "data": {"actions": [{"action": "c2pa.opened"}]}}]},
            "b": {"assertions": created("trainedAlgorithmicMedia"), "ingredients": [{"active_manifest": "gone"}]}, "i": {"assertions": created("digitalCapture/"), "ingredients": [{"active_manifest": "b"}]},
        },
        "validation_results": {"ingredientDeltas": [{"validationDeltas": {"failure": [{"code": "x"}]}}]},
    }
    x = L.walk(store)
    assert (x["n_steps"], x["n_inputs"], x["missing"], x["generative_depth"], x["relationships"], x["parent_codes"]) == (2, 2, ["gone"], 1, ["componentOf", "inputTo"], ["trainedAlgorithmicMedia"])
    assert x["summary"] == "generative AI creation → (camera capture) was the input to: re-encode = this file"
    assert x["bottom_line"] == "a camera capture went into generative AI, and this file derives from that (earlier steps have failures)"
    assert L.events(store["manifests"]["b"])[0] == {"action": "c2pa.created", "description": None, "code": "trainedAlgorithmicMedia", "agent": "n 2"}
    loop = {"active_manifest": "a", "manifests": {"a": {"ingredients": [{"active_manifest": "a", "relationship": "parentOf"}]}}}
    assert (L.walk(loop)["n_steps"], L.walk(loop)["truncated"]) == (1, True)
    for odd in ({}, {"active_manifest": 3}, {"active_manifest": "a", "manifests": []}, {"active_manifest": "a", "manifests": {"a": {"ingredients": [None, 3], "assertions": {"x": 1}}}}):
        L.walk(odd)
    deep = {"active_manifest": "m0", "manifests": {f"m{i}": {"ingredients": [{"active_manifest": f"m{i + 1}", "relationship": "parentOf"}]} for i in range(40)}}
    assert (L.walk(deep)["n_steps"], L.walk(deep)["truncated"]) == (16, True)


def test_lineage_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, "[1]"), (4, "{}")], "i int, t string").select("i", L.lineage(F.col("t")).alias("x")).select("i", "x.n_steps").collect()
    assert {r["i"]: r["n_steps"] for r in rows} == {1: None, 2: None, 3: None, 4: 0}


def plain_chain(up, start, most):
    seen, out, node = [start], [(0, start, False, False)], up[start]
    for depth in range(1, most + 1):
        if node is None:
            break
        cyclic, missing = node in seen or depth == most, node not in up
        out.append((depth, node, missing, cyclic))
        if cyclic or missing:
            break
        seen.append(node)
        node = up[node]
    return out


@pytest.mark.parametrize("most", [16, 4])
def test_chains(spark, most):
    r = random.Random(3)
    up = {i: r.choice([None, r.randrange(60), r.randrange(60), i - 1 if i else None, i - 1 if i else None]) for i in range(50)}
    got = sorted(tuple(x) for x in L.chains(spark.createDataFrame(list(up.items()), "n long, p long"), "n", "p", most).collect())
    assert got == sorted((s, *x) for s in up for x in plain_chain(up, s, most))
    assert L.chains(spark.createDataFrame([], "n long, p long"), "n", "p").count() == 0


def test_sources_that_fail(spark):
    def run(x):
        if x == 2:
            raise RuntimeError("broken")
        return "present", None

    rows = E.inspect(spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, v int"), [E.python_source("s", "mark", lambda: F.col("v").isNotNull(), lambda: F.col("v"), run)], "k", details=True)
    assert sorted((r["k"], r["status"], r["details"]) for r in rows.collect()) == [(1, "present", None), (2, "inconclusive", "source failed: broken"), (3, "not_applicable", None)]


def test_transforms_and_columns():
    assert R.transform("jpeg_q75")["value"] == 75 and R.transform("captured:a:b")["label"] == "a:b" and R.transform("none")["on_bytes"]
    for bad in ("jpeg_q0", "jpeg_q101", "resize_5", "crop_1", "turn", "jpeg"):
        with pytest.raises(ValueError):
            R.transform(bad)
    assert R.merged_columns([["none", "a", "c"], ["none", "b", "c"], ["d"], ["c", "e"]]) == ["d", "none", "b", "a", "c", "e"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p\t1", None, "s", "n", 1.5, "h")], "path string, label string, source string, statistic string, value double, sha256 string")
    R.append_log(rows, f"file://{tmp_path}/log")
    R.append_log(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2
    R.write_tsv(rows, ["path", "label"], f"file://{tmp_path}/tsv")
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/tsv").collect()] == [("p 1", "-")]
    R.write_calibration(rows, f"file://{tmp_path}/cal")
    assert spark.read.json(f"file://{tmp_path}/cal").first()["source"] == "s" and R.snapshot(rows.withColumn("elapsed_ms", F.lit(1))).columns == rows.columns


def test_stream_of_files(spark, tmp_path):
    from attestry.streaming import ingest

    (tmp_path / "in").mkdir()
    source = E.Source("jpeg", "container", lambda: F.col("mime") == "image/jpeg", lambda: images.jpeg_status(images.jpeg(F.col("content")), F.lit(None).cast("string")))

    def run():
        found = ingest.distinct_content(ingest.landing(spark, f"file://{tmp_path}/in"))
        ingest.write_evidence(found, [source], f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["status"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    for name, data in (("a.jpg", JPEG), ("b.png", PNG), ("c.txt", b"plain")):
        (tmp_path / "in" / name).write_bytes(data)
    assert run() == [("a.jpg", "absent"), ("b.png", "not_applicable")]
    (tmp_path / "in" / "copy.jpg").write_bytes(JPEG)
    (tmp_path / "in" / "d.jpg").write_bytes(JPEG[:30] + b"\xff")
    assert run() == [("a.jpg", "absent"), ("b.png", "not_applicable"), ("d.jpg", "inconclusive")]


def segment(kind, data):
    return bytes([0xFF, kind]) + (len(data) + 2).to_bytes(2, "big") + data


SMALL = segment(0xDB, b"\0" + bytes(range(64))) + b"\xff\xda\0\x02\x11\xff\x00\x11\xff\xd0\x11\xff\xd9"


def test_ends_of_images():
    from attestry.sources import layouts as Y

    whole = b"\xff\xd8" + segment(0xE1, b"\xff\xd8\xff\xd9") + SMALL
    assert Y.primary_end(whole) == len(whole) == Y.primary_end(whole + b"\xff\xd8" + SMALL)
    assert all(Y.primary_end(whole[:n]) is None for n in range(len(whole))) and Y.primary_end(b"x") is None


def test_directories():
    from attestry.sources import layouts as Y

    head = f"<x xmlns:a='{Y.CONTAINER}' xmlns:b=\"{Y.ITEM}\">"
    one = lambda body: Y.directory(f"{head}<a:Directory><rdf:Seq>{body}</rdf:Seq></a:Directory></x>")
    assert one('<a:Item b:Semantic="Primary" b:Mime="m" b:Padding="3"/><a:Item><b:Semantic>G</b:Semantic><b:Mime>n</b:Mime><b:Length> 7 </b:Length></a:Item>') == [
        {"semantic": "Primary", "mime": "m", "length": None, "padding": 3}, {"semantic": "G", "mime": "n", "length": 7, "padding": None},
    ]
    assert Y.directory("<x/>") is None and Y.directory(head) is None
    for bad in ("", '<a:Item b:Mime="m"/>', '<a:Item b:Semantic="s" b:Mime="m" b:Length="-1"/>', '<a:Item b:Semantic="s" b:Mime="m"/>' * 65):
        with pytest.raises(ValueError):
            one(bad)
    with pytest.raises(ValueError):
        Y.directory(head + "<a:Directory>")
    parts, wrong = Y.placed([{"semantic": "Primary", "mime": "m", "length": None, "padding": 2}, {"semantic": "G", "mime": "image/jpeg", "length": 3, "padding": None}, {"semantic": "H", "mime": "m", "length": 0, "padding": 1}, {"semantic": "I", "mime": "m", "length": 9, "padding": None}, {"semantic": "J", "mime": "m", "length": None, "padding": None}], 4, b"01234\0\xff\xd8\xff78")
    assert [(p["offset"], p["present"]) for p in parts] == [(6, 3), (6, 0), (9, 2)] and wrong == ["padding behind the first item", "item 3 is cut short", "item 4 has no length"]


def test_embedded_metadata():
    from attestry.sources import embedded as M

    assert [M.decoded(t.encode(k)) for t in ("<a>é",) for k in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-be", "utf-32-le")] == ["<a>é"] * 8
    part = lambda g, whole, at, data: segment(0xE1, M.EXTENDED + g * 32 + whole.to_bytes(4, "big") + at.to_bytes(4, "big") + data)
    jpeg = lambda *s: b"\xff\xd8" + b"".join(s) + SMALL
    assert M.packets(jpeg(part(b"a", 4, 2, b"cd"), segment(0xE1, M.XMP + b"<x>"), part(b"a", 4, 0, b"ab"))) == (["<x>", "abcd"], False)
    for broken in (part(b"a", 4, 0, b"ab"), part(b"a", 4, 2, b"cd"), part(b"a", 2, 0, b"abc"), part(b"a", 2, 0, b"ab") + part(b"b", 2, 0, b"xy"), segment(0xE1, M.EXTENDED + b"short")):
        assert M.packets(jpeg(broken))[1]
    text = lambda k, v: len(k + v).to_bytes(4, "big") + b"iTXt" + k + v + b"crc4"
    assert M.packets(images.PNG_SIGN + text(b"XML:com.adobe.xmp", b"\0\0\0\0\0<y>") + text(b"other", b"\0\0\0\0\0<z>")) == (["<y>"], False)
    assert M.packets(b"RIFF\0\0\0\0WEBPXMP \x03\0\0\0<w>\0") == (["<w>"], False)
    chunk = lambda i, n, d: segment(0xE2, M.ICC + bytes([i, n]) + d)
    assert M.icc_bytes(jpeg(chunk(2, 2, b"b"), chunk(1, 2, b"a"))) == b"ab" and M.icc_bytes(jpeg()) is None
    for bad in ((chunk(1, 2, b"a"),), (chunk(1, 1, b"a"), chunk(1, 1, b"a")), (chunk(1, 2, b"a"), chunk(2, 3, b"a"))):
        with pytest.raises(ValueError):
            M.icc_bytes(jpeg(*bad))
    import zlib

    iccp = lambda d: images.PNG_SIGN + len(d).to_bytes(4, "big") + b"iCCP" + d + b"crc4"
    assert M.icc_bytes(iccp(b"n\0\0" + zlib.compress(b"profile"))) == b"profile"
    for bad in (b"n", b"n\0", b"n\0\x01x", b"n\0\0x"):
        with pytest.raises(ValueError):
            M.icc_bytes(iccp(bad))
    records = lambda *r: b"mluc\0\0\0\0" + len(r).to_bytes(4, "big") + (12).to_bytes(4, "big") + b"".join(c + len(t.encode("utf-16-be")).to_bytes(4, "big") + (16 + 12 * len(r) + sum(len(u.encode("utf-16-be")) for _, u in r[:i])).to_bytes(4, "big") for i, (c, t) in enumerate(r)) + b"".join(t.encode("utf-16-be") for _, t in r)
    assert M._described(records((b"deDE", "eins"), (b"enUS", "one"))) == "one" and M._described(records((b"deDE", "eins"), (b"frFR", "un"))) == "eins" and M._described(b"text\0\0\0\0 a  b\0") == "a b" and M._described(b"none") is None
    r = random.Random(4)
    whole = jpeg(segment(0xE1, M.EXIF + b"II*\0\x08\0\0\0\x01\0\x0f\x01\x02\0\x03\0\0\0ab\0\0\0\0\0\0"), segment(0xE1, M.XMP + b"<x>"), chunk(1, 1, b"\0" * 140), segment(0xED, M.IRB + b"8BIM\x04\x04\0\0\0\0\0\x07\x1c\x02\x41\0\x02ab"))
    assert M.exif(whole)["make"] == "ab" and M.iim(whole) == {65: ["ab"]}
    for _ in range(500):  # broken bytes give a row, never an error
        b = bytearray(whole[: r.randrange(len(whole) + 1)])
        for _ in range(r.randint(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        assert len(M.read(bytes(b))) == 17
    assert len(M.read(None)) == 17


def test_lattices():
    import numpy as np

    from attestry.sources import pixels as P

    r = np.random.default_rng(0)
    noise = r.normal(128, 10, (256, 256))
    grid = noise.copy()
    grid[::8] += 40
    grid[:, ::8] += 40
    plain, (contrast, share) = P.lattice(noise), P.lattice(grid)
    assert contrast > 4 * plain[0] and share == 1.0 and P.lattice(np.zeros((3, 3))) == (0.0, 0.0)
    p = r.random((5, 6)).astype(np.float32)
    want = [[p[y, x] - sum(p[min(4, max(0, y + j)), min(5, max(0, x + i))] for j in (-1, 0, 1) for i in (-1, 0, 1)) / 9 for x in range(6)] for y in range(5)]
    assert np.allclose(P.residual(p), want, atol=1e-5)


def test_records_and_packs(spark, tmp_path):
    assert json.loads(R.run_record(spark, reveal=True, fpr=0.01, trust=None).first()[0]) == {"fpr": 0.01, "reveal": True}
    store = spark.createDataFrame([({"b": ("1", "x"), "a": ("2", "y")},)], "packs map<string, struct<version: string, sha256: string>>")
    assert [tuple(r) for r in R.installed(store).collect()] == [("a", "2", "y"), ("b", "1", "x")]
    R.write_derivatives(spark.createDataFrame([("s", "captured:a/b", "jpg", b"x")], "stem string, transform string, ext string, content binary"), f"file://{tmp_path}/d")
    assert tuple(spark.read.parquet(f"file://{tmp_path}/d").first()) == ("s__captured_a_b.jpg", b"x")


def test_timeline(spark):
    store = json.dumps({"active_manifest": "a", "manifests": {"a": {"ingredients": [{"active_manifest": "b", "relationship": "parentOf"}], "assertions": [{"label": "c2pa.actions", "data": {"actions": [{"action": "c2pa.opened"}]}}]}, "b": {"digitalSourceType": "x/digitalCapture"}}})
    assert spark.createDataFrame([(store,)], "t string").select(L.lineage(F.col("t")).alias("x")).select(L.timeline(F.col("x.steps"))).first()[0] == "1 back: camera capture [digitalCapture]\nthis file: re-encode"


def test_heif_boxes():
    from attestry.sources import heif as H

    box = lambda kind, data: (len(data) + 8).to_bytes(4, "big") + kind + data
    ftyp, n = box(b"ftyp", b"heic\0\0\0\0mif1"), lambda x, size: x.to_bytes(size, "big")
    infe = lambda v, i, rest: box(b"infe", bytes([v, 0, 0, 0]) + n(i, 4 if v == 3 else 2) + b"\0\0" + rest)
    mime = b"mimex\0application/RDF+xml\0"

    def build(extents, v=2, method=0, tail=b"", version=0):
        iinf = box(b"iinf", bytes([version, 0, 0, 0]) + n(1, 4 if version else 2) + infe(v, 5, mime))
        iloc = box(b"iloc", b"\x02\0\0\0\x44\x40" + n(1, 4) + n(5, 4) + n(method, 2) + b"\0\0" + n(10, 4) + n(len(extents), 2) + b"".join(n(a, 4) + n(z, 4) for a, z in extents))
        return ftyp + box(b"mdat", b"<abc>tail") + box(b"meta", b"\0\0\0\0" + iinf + iloc + tail)

    at = len(ftyp) + 8 - 10
    assert H.structure(build([(at, 2), (at + 2, 3)]))["xmp"] == ["<abc>"] and H.structure(build([(at, 5)], 3, version=1))["xmp"] == ["<abc>"]
    assert H.structure(build([], tail=box(b"idat", b"0123456789<in>")))["unreadable"] == ["item 5: no extents"]
    assert H.structure(build([(0, 0)], method=1, tail=box(b"idat", b"0123456789<in>")))["xmp"] == ["<in>"]
    for bad in ([(10**6, 1)], [(at, 10**6)]):
        assert len(H.structure(build(bad))["unreadable"]) == 1
    assert len(H.structure(build([(at, 1)], method=2))["unreadable"]) == 1 and H.structure(ftyp)["brands"] == ["mif1"]
    whole = build([(at, 5)], tail=box(b"pitm", b"\0\0\0\0\0\5"))
    assert H.structure(whole)["primary"] == 5
    r = random.Random(7)
    for b in (b"", b"\0\0\0\x08free", ftyp[:10]):
        with pytest.raises(ValueError):
            H.structure(b)
    for _ in range(400):
        b = bytearray(whole[: r.randrange(len(whole) + 1)])
        for _ in range(r.randint(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        try:
            H.structure(bytes(b))
        except ValueError:
            pass
