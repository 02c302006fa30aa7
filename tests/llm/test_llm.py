"""Operators against brute force and round trips, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import chat, decontaminate, jaccard, language, licenses, line_templates, mixing, shared, token_files, topk, warc

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, row_key string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 80))) for _ in range(12)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [None, "", "   \n\t ", "one", "One  two three", "a b c d e", "A b C d e", out[0], out[0], "z" * 5000, " ".join(r.choice(words) for _ in range(9000)), "é ü 1.2,3 x7y"]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None, "é"]), 1, "clash", "clash", "clash") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    texts = ["Ab1 c-d é x", "", None, "x" * 3000, "AB1"]
    data, offsets = shared.utf8(pa.array(texts))
    s, e = shared.split_words(data, offsets, shared.ALNUM)
    found = [data[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert found == [w for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))] or [f.lower() for f in found]
    h = shared.hash_words(data, s, e)
    assert h[0] == shared.hash_text(["ab1"])[0] == h[-1]


def test_mixing(spark, docs, empty):
    rows = mixing.mix_plan(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        assert r["_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_size"]
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] <= 3 * r["source_size"] + 1e-6 and r["copies"] <= 3 for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-3
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_comes_near_its_targets(spark):
    """Taken words are within five standard errors of the target, for heavy and light documents; repeated ids draw alike."""
    r = random.Random(9)
    rows = [(i, "w " * (r.randint(1, 40) if i % 50 else 3000), f"s{i % 7}") for i in range(4000)] + [(5, "w w", "s5"), (5, "w w", "s5")]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for x in got:
        by.setdefault(x["source"], []).append(x)
    for rows_ in by.values():
        rate = rows_[0]["target"] / rows_[0]["source_size"]
        error = (sum(x["size"] ** 2 for x in rows_) * (rate % 1) * (1 - rate % 1)) ** 0.5
        assert abs(sum(x["size"] * x["copies"] for x in rows_) - rows_[0]["target"]) <= 5 * error + 1e-6
    assert len({x["copies"] for x in got if x["doc_id"] == 5}) == 1


def test_mixing_caps(spark):
    d = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (1, "b"), (1, "c")])], "doc_id long, text string, source string")
    t = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    assert t == {"a": 96.0, "b": 3.0, "c": 3.0}


@pytest.mark.parametrize("at_once", [10**9, 7])
def test_decontamination(spark, docs, empty, at_once):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    w = (texts[3][1] or "").split()
    shuffled = w[2:15]
    random.Random(3).shuffle(shuffled)
    items = [(1, " ".join(w[2:20])), (10, "a B c"), (2, None), (3, ""), (4, "one"), (5, " ".join(w[5:18])), (6, "nothing of this occurs anywhere at all"), (None, "z" * 5000), (7, " ".join(shuffled)), (4, "one"), (4, "a b")]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, part string")
    want = decontaminate.brute_force(texts, [("null" if i is None else i, t) for i, t in items])
    rows = shared.named_rows(docs.repartition(3, F.rand(5)))
    got = {r["doc_id"]: tuple(r)[3:9] for r in decontaminate.contamination(rows, bench, at_once=at_once).collect()}
    assert got == want and any(x[5] > x[2] for x in want.values())
    none = decontaminate.contamination(rows, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["contaminated"] or r["n_near"] for r in none)
    if at_once > 7:
        assert decontaminate.contamination(shared.named_rows(empty), bench).count() == 0
        kept = decontaminate.remove_contaminated(docs, bench)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if not x[4]}


def test_rows_of_one_id_are_decided_alone(spark, tmp_path):
    """Repeated ids, null ids and repeated rows: from files and from a table in memory."""
    text = "a b c d e f g h i j k l m n o"
    rows = [(1, text, "r"), (2, text, "r"), (2, "p q r s t u v", "r"), (None, text, "r"), (None, "x y z x y", "r"), (3, text, "r"), (3, text, "r"), (None, "x y z x y", "r"), (4, None, "r"), (4, None, "r")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_part string")
    table.write.parquet(f"file://{tmp_path}/t")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    for t in (table, spark.read.parquet(f"file://{tmp_path}/t")):
        kept = sorted(map(repr, map(tuple, jaccard.one_of_each(t).collect())))
        assert kept == sorted(map(repr, [rows[0], rows[2], rows[4], rows[8], rows[9]]))
        clean = sorted(map(repr, map(tuple, decontaminate.remove_contaminated(t, bench).collect())))
        assert clean == sorted(map(repr, [rows[2], rows[4], rows[7], rows[8], rows[9]]))


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "alpha"), (4, "beta alpha"), (5, "x beta"), (6, "beta x x x alpha x beta")], "doc_id long, text string")
    index = decontaminate.build_index(shared.named_rows(d))
    near = lambda text: sorted(r["doc_id"] for r in decontaminate.search(index, decontaminate.windows(spark.createDataFrame([(1, text)], "item_id long, text string")), slop=3).collect() if r["near"])
    assert near("alpha beta") == [1, 4, 6] and near("beta") == [1, 2, 4, 5, 6] and near("alpha gamma") == []


def test_near_duplicates(spark, docs, empty):
    want = jaccard.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == want
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, x in want.items() if x[1] == d}


def test_near_duplicates_at_the_threshold(spark):
    # 8 words: 4 shingles; sets that share 3 of 4 united link, 3 of 5 don't
    d = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "a b c d e f g x"), (4, "q w e r t z u i o p"), (5, "a B c d e f G h")]
    got = {r[0]: r[2] for r in jaccard.near_duplicates(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in jaccard.brute_force(d).items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}


def test_near_copies_scattered_around_a_core(spark):
    """A cluster whose members fall into several components, with and without edits in common."""
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    edits = [(r.randrange(120), f"e{i}") for i in range(12)]
    rows = []
    for d in range(160):
        own = list(base)
        for place, word in r.sample(edits, r.randrange(3)) + [(r.randrange(120), f"x{d}-{i}") for i in range(r.randrange(7))]:
            own[place] = word
        rows.append((d, " ".join(own[: r.choice((120, 120, 112, 95))])))
    want = jaccard.brute_force(rows)
    assert len({v[1] for v in want.values()}) > 5
    got = {x[0]: (x[1], x[2]) for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@have
def test_language(spark, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(table)
    odd = spark.createDataFrame([(1, None, "x"), (2, "12 34 …", "x"), (3, "", "x"), (4, "the " * 3000, "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: (r["_lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en"
    rows = language.identify(table, model).filter(language.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert language.identify(empty, language.learn(empty)).count() == 0


def plain_language(model, prob, text, known={}):  # noqa: B006  sums of words are kept between calls
    """(language, posterior) by a plain forward sum over the bytes of each word."""
    total = np.zeros(len(model.langs))
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        w = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        if (id(model), w) not in known:
            alpha, logs = [np.ones(len(model.langs))], 0
            for j in range(1, len(w) + 1):
                alpha.append(sum((alpha[i] * prob[w[i:j]] for i in range(max(0, j - model.pieces.longest), j) if w[i:j] in prob), np.zeros(len(model.langs))))
                if j % 10 == 0:
                    top = np.maximum(np.max(alpha[-model.pieces.longest :], axis=0), 1e-300)
                    alpha = [a / top for a in alpha]
                    logs = logs + np.log(top)
            known[id(model), w] = logs + np.log(np.maximum(alpha[-1], 1e-300))
        total += known[id(model), w]
    share = np.exp(total - total.max())
    return model.langs[int(total.argmax())], (share / share.sum()).max()


def probabilities(model):
    names = language.public_pieces()
    return {names[i]: model.p[k] for k, i in enumerate(model.pieces.order)}


@have
def test_language_against_plain_sums(spark):
    """Every score again by a plain forward sum over bytes; null and repeated ids, rows and labels; a run of 500 bytes."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(table)
    prob = probabilities(model)
    texts = [r["text"] for r in table.limit(12).collect()] + ["z" * 500 + "которые" * 60, "hello", "hello", None, "日本語" * 90, "A b"]
    rows = [(i if i % 3 else None, t, "x", "clash") for i, t in enumerate(texts)] * 2
    got = [(r["text"], r["_lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string"), model).collect()]
    assert len(got) == len(rows)

    for text, lang, score in got:
        want = plain_language(model, prob, text) if text else ("und", 0.0)
        assert lang == want[0] and abs(score - want[1]) < 1e-6


def test_one_long_word():
    names = language.public_pieces()
    pieces = language.Pieces(names)
    p = np.random.default_rng(1).random((len(names) + 1, 3))
    p /= p.sum(axis=0)
    p[-1] = 0
    w = np.frombuffer((" " + "z" * 30 + "которые" * 40 + "hello" * 20).encode(), np.uint8)
    assert np.allclose(language.forward(pieces, p, w[None, :])[0], language.forward_one(pieces, p, w))


def test_top_k_of_large_components(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, -3.0]), (2, [-1e17, 2.0]), (3, [2.0**53 / 64 + 2, 1.0]), (4, [1.0, 1e300]), (20, [3.0, 1.0]), (20, [1.0, 1.0]), (5, [1.0, 1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = [(i, [max(-(1 << 63), min((1 << 63) - 1, int(64 * x))) for x in e]) for i, e in rows]
    clamp = lambda s: max(-topk.LIMIT, min(topk.LIMIT, s))
    want = []
    for q, u in [(0, whole[0][1]), (20, min(whole[5][1], whole[6][1]))]:
        best = sorted((-clamp(sum(a * b for a, b in zip(u, w))), i) for i, w in whole if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect()) == sorted(want)


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(names := [b" ", b"a", b" a", b"aa", b"b"])
    values = np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    prob = dict(zip(names, values))
    p = np.append(values[pieces.order], 0)[:, None]  # pieces are numbered in the order of their hashes

    def ways(w):
        return 1.0 if not w else sum(prob[w[:k]] * ways(w[k:]) for k in range(1, len(w) + 1) if w[:k] in prob)

    for w in (b" aab", b" a", b" aaaa"):
        got = language.forward(pieces, p, np.frombuffer(w, np.uint8)[None, :])[0, 0]
        assert abs(np.exp(got) - ways(w)) < 1e-12


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)], "clash") for i in range(300)]
    rows += [(300, None, ""), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (302, [float("nan")] * 6, ""), (303, [float("inf")] * 6, ""), (320, [1.0, 1.0], ""), (321, [0.5, 0.5], ""), (None, [1.0] * 6, "")]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    got = [tuple(x) for x in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect()]
    ok = {i: [int(np.floor(64 * x)) for x in e] for i, e, _ in rows if i is not None and (i < 300 or i > 319)}
    want = []
    for q in ok:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q and len(ok[c]) == len(ok[q])))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_ball_tree_prunes():
    r = np.random.default_rng(0)
    v = np.concatenate([np.floor(r.normal(c * 40, 2, (400, 8))) for c in range(-4, 5)])
    best = topk.Best(5, 10, np.full(5, topk.NONE))
    tree = topk.BallTree(np.arange(len(v)), v)
    visits = topk.search(tree, np.full(5, -1), v[-5:], best)
    assert visits < 5 * len(tree.levels[-1]) / 2
    assert (best.score[0] == np.sort((v @ v[-5]).astype(int))[::-1][:10]).all()


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = token_files.public_vocabulary()
    t = Tokenizer.from_file(path)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(900, "it's we'll  'tis ab'sx \"'s"), (901, "日本語 text Привет, мир"), (902, "<|endoftext|> a\tb\n\n c"), (None, "no id"), (7, "repeated id")]
    got = token_files.tokens_of(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")).collect()
    want, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    codes = {(d, x): [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        want.append(r["doc_id"])
    assert want == [d for d, _ in ordered]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(i), crc(i)) for (d, _), i in codes.items())
    assert token_files.tokens_of(empty).count() == 0


def test_other_tokenizers_go_whole(spark, docs):
    """A file with another pre-tokenizer or normalizer is encoded as the library does it."""
    from tokenizers import Tokenizer

    path = token_files.public_vocabulary("word_bpe_49k.json")
    assert not token_files.Encoder(path).known and token_files.Encoder(token_files.public_vocabulary()).known
    t = Tokenizer.from_file(path)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.tokens_of(docs, path).collect())
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert got == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in ids.items())


def plain_scan(text):
    """(n_words, n_base, first_word, last_word, base_labels) by plain Python."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted(i for i, _ in found)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


MIT = """Copyright (c) 2020 Some Body
Permission is hereby granted, free of charge, to any person obtaining a copy of my own tool, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_licenses(spark, docs, empty):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the terms of the MIT License.",
        "licensed under the Apache License, Version 2.0", "Licensed under the Apache Version 2.0", "all rights reserved all Rights\nreserved", None, "", "cc by", MIT, MIT.replace("EXPRESS OR IMPLIED", "EXPRESS"),
        "You see, this program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of it",
        "cc by cc by", "cc by cc by", "x " * 20000 + "all rights reserved",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert [got[i]["labels"] for i in range(12)] == ["gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "mit", "apache-2.0", "", "reserved", "", "", "cc-by", "mit", "", "agpl-3.0,gpl"]
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == plain_scan(t)
    assert licenses.scan(empty).count() == 0
    for r in licenses.scan(docs.unionByName(docs)).collect():
        assert tuple(r)[1:6] == plain_scan(dict((x[0], x[1]) for x in corpus())[r["doc_id"]])


def test_template_markup():
    def ok(a, t):
        w = shared.hash_text(licenses.words_of(t))
        return bool(a.places(w, np.zeros(len(w), int), np.full(len(w), len(w))))

    a = licenses.Automaton("x", 'use of <<var;name="n";original="it";match=".{0,2}">> is <<beginOptional>>not <<beginOptional>>at all<<endOptional>><<endOptional>> free')
    assert all(ok(a, t) for t in ["use of is free", "use of this thing is not free", "use of this is not at all free"])
    assert not any(ok(a, t) for t in ["use of one two three is free", "use of it is at all free", "use of it is", "use it is free"])
    a = licenses.Automaton("x", '<<beginOptional>>the title<<endOptional>> <<var;name="n";match=".+">> we grant you <<var;name="m";match=".*">> all of it')
    for n in (1, 80, 5000):
        assert ok(a, "w " * n + "we grant you " + "x " * n + "all of it") and not ok(a, "we grant you " + "x " * n + "all of it") and not ok(a, "w we grant you " + "x " * n + "all of")
    many = "w we grant you " * 50
    assert ok(a, many + "all of it") and not ok(a, many + "all it")
    w = shared.hash_text(licenses.words_of(many + "all of it"))
    assert len(a.places(w, np.zeros(len(w), int), np.full(len(w), len(w)))) == 50
    with pytest.raises(ValueError):
        licenses.Automaton("x", "<<beginOptional>>a<<endOptional>>")


def test_automata_against_regular_expressions():
    """Random templates over three words: the automata match where the pattern used for SQL does."""
    r = random.Random(8)
    pieces = ["a", "b", "c", "a b", "<<beginOptional>>b<<endOptional>>", '<<var;match="a b|c">>', '<<var;match=".{0,2}">>', '<<var;match=".+">>', "<<beginOptional>>a <<beginOptional>>c<<endOptional>><<endOptional>>"]
    for _ in range(150):
        template = " ".join(["a", *r.choices(pieces, k=r.randint(1, 5))]) if r.random() < 0.5 else " ".join([*r.choices(pieces, k=r.randint(1, 4)), "c"])
        a, p = licenses.Automaton("x", template), re.compile(licenses.pattern(template))
        for _ in range(20):
            text = " ".join(r.choices("abc", k=r.randint(1, 12)))
            w = shared.hash_text(text.split())
            assert bool(a.places(w, np.zeros(len(w), int), np.full(len(w), len(w)))) == bool(p.search(f" {text} ")), (template, text)


def test_line_templates(spark, docs, empty):
    lines = ["GET page 12 took 5 ms", "GET page 99 took 7 ms", "user bob logged in at noon today", "user eve logged in at noon today", "user joe logged in at noon today", "rare line here", "", "  "]
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 8)))) for i in range(25)] + [(100, None), (101, ""), (102, "one line"), (103, "x " * 4000)]
    want = line_templates.brute_force(rows)
    d = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], "doc_id long, text string, n_lines string, gone string, right_key string")
    got = {r["doc_id"]: (r["_n_lines"], len(r["dropped"]), r["text"]) for r in line_templates.drop_recurring(d.unionByName(d.limit(5))).collect()}
    assert {k: (a, b, t or "") for k, (a, b, t) in got.items()} == want and got[100][2] is None
    assert line_templates.drop_recurring(empty).count() == 0


def test_line_templates_of_mixed_leaves(spark):
    """Families and unrelated lines that begin alike: each family recurs by itself, in any order of rows."""
    one = lambda i: f"job alpha done by name{'abcdefgh'[i]} on the node in zone east"
    two = lambda i: f"job alpha done after all retries of part{'abcdefgh'[i]} were used up"
    other = "job alpha done quickly where nobody had expected such luck here"
    kept = [other, other.replace("quickly", "slowly")]
    rows = [(i, "\n".join((one(i), two(i % 3), f"own text {'abcdefgh'[i]}"))) for i in range(6)] + [(6, other), (7, kept[1]), (8, one(7))]
    r = random.Random(4)
    words = "ab cd ef gh ij kl".split()
    family = [[r.choice(words) for _ in range(12)] for _ in range(3)]
    for d in range(20, 60):
        line = list(r.choice(family))
        for _ in range(r.randint(0, 4)):
            line[r.randrange(12)] = r.choice(words)
        rows.append((d, " ".join(["same", "three", "words", *line])))
    want = line_templates.brute_force(rows)
    assert [want[i] for i in (0, 6, 7, 8)] == [(3, 2, "own text a"), (1, 0, kept[0]), (1, 0, kept[1]), (1, 1, "")]
    assert {want[d][1] for d in range(20, 60)} == {0, 1}
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        got = {x["doc_id"]: (x["n_lines"], len(x["dropped"]), x["text"]) for x in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 2)).collect()}
        assert got == want


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "<p>é &amp;lt; <b>b</b></p><script>x</script>"), (2, None, None), (3, "u", ""), (1, "http://a/", "<br>a")], "page_id long, url string, html string")
    r = warc.responses(pages)
    every = r.unionByName(warc.derive(r))
    assert every.count() == 12
    warc.write_warc(every, f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert back.count() == 12 and every.drop("key").exceptAll(back).count() == 0
    one = back.filter("type = 'conversion' and target like '%0D%0A%'").first()
    assert one["block"] == "é &lt; b" and one["block_digest"] == "sha1:" + hashlib.sha1(one["block"].encode()).hexdigest()
    import gzip

    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.gz").write_bytes(b"".join(gzip.compress(f"WARC/1.0\r\nwarc-type:{k}\r\nX-Odd:a\r\n b\r\nCONTENT-LENGTH:  {len(k)}\r\n\r\n{k}\r\n\r\n".encode()) for k in ("one", "three")))
    assert sorted((x["type"], x["block"]) for x in warc.read_warc(spark, f"file://{tmp_path}/z").collect()) == [("one", "one"), ("three", "three")]
    none = warc.responses(pages.limit(0).withColumn("block", F.lit("clash")))
    assert none.count() == 0 and warc.derive(none).count() == 0
    long = warc.derive(warc.responses(spark.createDataFrame([(1, "u", "<p>" + "ab " * 300_000)], "page_id long, url string, html string"))).filter("type = 'conversion'").first()
    assert long["block"] == ("ab " * 300_000).strip()
    assert back.filter("type <> 'response'").join(r.select("record_id").withColumnRenamed("record_id", "refers_to"), "refers_to", "left_anti").count() == 0


def plain_chat(rows):
    """{(conv_id, speaker): (text, spans)} by plain Python."""
    out, convs = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "unknown", x or ""))
    for c, turns in convs.items():
        for speaker in {r for _, r, _ in turns}:
            text, spans = "", []
            for _, r, x in sorted(turns):
                text += "<|assistant|>\n" if r == speaker else f"<|user name={r}|>\n"
                if r == speaker:
                    spans.append((len(text), len(text) + len(x) + 8))
                text += x + "<|end|>\n"
            out[c, speaker] = (text, spans)
    return out


def test_chat(spark):
    r = random.Random(6)
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 300, "ann", "bye"), (None, None, None, "x"), (2, 0, "a", "s"), (2, 0, "a", "s"), (3, 0, "long", "é" * 100_000)]
    rows += [(4, t, r.choice(["ann", "bob", None]), "w" * r.randint(0, 5)) for t in range(600)] + [(5, None, r.choice("ab"), str(r.randint(0, 9))) for _ in range(700)] + [(5, 1, "c", "only here")]
    t = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, segment string").repartition(5)
    segments = chat.perspectives(t).collect()
    assert max(x["n_turns"] for x in segments) <= chat.SEGMENT and sum(x["n_turns"] for x in segments if x["conv_id"] == 5) == 3 * 701
    want = plain_chat(rows)
    got = {(x["conv_id"], x["speaker"]): (x["text"], [tuple(m) for m in x["mask"]]) for x in chat.whole(chat.perspectives(t)).collect()}
    assert got == want
    for x in segments:
        assert want[x["conv_id"], x["speaker"]][0][x["begin"] :].startswith(x["text"])
    assert chat.perspectives(t.limit(0)).count() == 0


@have
@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_decontaminate", "op3_chat_perspectives", "op6_top_k", "op8_warc_derivatives", "op9_license_scan"])
def test_sql(spark, name):
    from attestry.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, o = QUERIES[name](spark, SF), c.execute(ORACLES[name])
    assert df.columns == [x[0] for x in o.description]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, o.fetchall()))


@have
def test_pipeline(spark):
    """run() against plain versions of every stage; mixing by its SQL, ids by the library."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.learn(docs)
    prob = probabilities(model)
    letter = lambda t: any(c.isalpha() for c in t or "")
    kept = [d for d, r in rows.items() if letter(r["text"]) and plain_language(model, prob, r["text"])[1] >= 0.5]
    one = [d for d, x in jaccard.brute_force([(d, rows[d]["text"]) for d in kept]).items() if x[1] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, x in decontaminate.brute_force([(d, rows[d]["text"]) for d in one], items).items() if not x[4]}
    c = duckdb.connect()
    c.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet' WHERE list_contains(?, doc_id)", [sorted(clean)])
    copies = {d: taken // size if size else 0 for d, size, _, _, taken in c.execute(mixing.ORACLE).fetchall()}
    code, start, want = Tokenizer.from_file(token_files.public_vocabulary()), 0, []
    for d in sorted(clean):
        ids = [*code.encode(rows[d]["text"], add_special_tokens=False).ids, 0]
        for _ in range(copies[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(map(tuple, p.run(spark, SF).collect())) == want


def test_stages_take_odd_rows(spark, tmp_path):
    """Null, empty and repeated rows and ids, clashing names and empty tables go through every stage."""
    import corpus_pipeline as p

    text = "the quick brown fox jumps over the lazy dog and then it goes home to sleep for the night"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (None, text, None, None), (2, None, "en", "s"), (3, "", None, "s"), (None, None, None, None), (4, "wo ist der Hund und was macht er heute", "de", None), (5, "x " * 5000, "en", "s")]
    spark.createDataFrame([(*x, 1, "clash", "clash", "clash") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, row_part string, size string, lang_pred string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such passage anywhere"), (None, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for docs in (table, table.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, f"file://{tmp_path}")
            if name != "token_files":
                assert out.columns == docs.columns
            path = f"file://{tmp_path}/{name}-{docs is table}-{out.count()}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    assert not shared._scopes()


def test_joins_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, and long texts that consist of what all share."""
    text = "all of this stands in every one of the texts that are here today and it goes on for a while"
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    rows = [(None, text), (7, text), (7, text), (None, "alone in the world as it seems to be"), (3, text + " more"), (9, long), (8, long + " end"), (8, "x"), (None, None), (5, "  ")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    n = len(text.split()) - 4
    assert got == sorted([(None, n, 3), (7, n, 3), (7, n, 3), (3, n + 1, 3), (None, 5, None), (9, 900, 8), (8, 901, 8), (8, 1, 8), (None, 0, None), (5, 0, 5)], key=str)


def test_scopes(spark, tmp_path):
    d = spark.range(3)
    there = lambda path: os.path.isdir(path.removeprefix("file://"))
    with shared.scope(spark):
        _, outer = shared.stored(d, "a")
        with shared.scope(spark):
            _, inner = shared.stored(d, "b")
            own, stays = shared.kept(d, "c")
        assert there(outer) and there(stays) and not there(inner) and own.count() == 3
        _, last = shared.kept(d, "d")
    assert not there(outer) and not there(stays) and there(last) and last in shared._application
