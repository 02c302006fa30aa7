"""Line dedup by a log-template tree of fixed depth.

A line's words ([^\\x20\\x09-\\x0D]+, case kept) that hold a digit are variable fields, written <*>. The tree
sorts a line by its number of words, then by its first ``DEPTH`` words (variable ones as <*>): that path is its
leaf. Within a leaf, lines are grouped by similarity, a template for each group: the words that all its lines
share stay, and positions where they differ become <*> too. The leaf's distinct lines are taken in the order of
their words' hashes. Each joins the group whose template has the most words in common with it, place by place (the
earliest group if several do), if these are at least ``SIMILAR`` of the positions; else it opens a group. A
template found in at least ``MIN_DOCS`` documents recurs, and its lines are dropped from all documents.

Unlike in the usual form, the order is not that in which lines come but a fixed one, so tasks need no shared tree
and reruns agree. Lines that all share ``SIMILAR`` of their positions are one group in any order.

Defined cases: null text has no lines and stays null; a text without words has lines, of which none is
dropped; lines are cut at line feeds only; rows that repeat (doc_id and text) count as one document for
recurrence and are treated alike; an empty table gives an empty result; extra columns pass through, added
names get underscores in front if they clash. Lines and leaves are compared by 64-bit hashes.

Scale: per line, two hashes are shuffled and summed with partial aggregation; words of a line leave a scan only
if a filter of fixed size says that its leaf holds several templates. Leaves that are one group are found by
sums; the distinct lines of any other leaf go through one task, which keeps a row of hashes per group of the leaf it
is at, and compares each line with all of them. Texts are shuffled once, to meet the numbers of their dropped lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NONSPACE, Filter, blocks, discard, fresh, hash_text, hash_words, join_measured, lists, mix, per_text, split_words, stored

DEPTH, SIMILAR, MIN_DOCS = 3, 0.6, 3

_U = np.uint64
_FIELD = _U(0x2A2A2A2A2A2A2A2B)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


class Lines:
    """The lines of a block of texts: first word, number of words, leaf and template of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(data == 10)
        self.per = np.diff(np.searchsorted(feeds, offsets)) + 1  # lines of each text
        begins = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
        s, e = split_words(data, offsets, NONSPACE)
        w = hash_words(data, s, e, fold=False)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int32)))
        w[digits[e] > digits[s]] = _FIELD
        self.words = w
        self.first = np.searchsorted(s, begins)
        self.n = np.diff(np.append(self.first, len(w)))
        place = np.arange(len(w)) - np.repeat(self.first, self.n)
        with np.errstate(over="ignore"):
            term = mix(w + (place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)))
        lead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(place < DEPTH, term, _U(0)), dtype=np.uint64)))
        stop, count = self.first + self.n, mix(self.n.astype(np.uint64))
        self.template = mix(sums[stop] - sums[self.first] + count).view(np.int64)
        self.leaf = mix(lead[stop] - lead[self.first] + count + _U(77)).view(np.int64)


HASHED = "row_key long, leaves array<long>, templates array<long>"


def _key():
    return F.xxhash64("doc_id", "text")


def _hashed(docs: DataFrame) -> DataFrame:
    """The leaf and template of every line; 0 for a line without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                x = Lines(data, offsets)
                cuts = np.concatenate(([0], np.cumsum(x.per)))
                some = x.n > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists(np.where(some, x.leaf, 0), cuts, pa.int64()), lists(np.where(some, x.template, 0), cuts, pa.int64())], names=["row_key", "leaves", "templates"])

    return docs.filter(F.col("text").isNotNull()).select(_key().alias("row_key"), "text").mapInArrow(run, HASHED)


def _leaf_words(docs: DataFrame, wanted: Filter) -> DataFrame:
    """(leaf, template, words array<long>) of the lines whose leaf the filter lets pass, each once a block."""
    sent = wanted.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                x = Lines(data, offsets)
                own = np.flatnonzero((x.n > 0) & Filter.test(sent.value, x.leaf))
                own = own[np.unique(x.template[own], return_index=True)[1]]
                if len(own):
                    n = x.n[own]
                    at = np.repeat(x.first[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x.leaf[own]), pa.array(x.template[own]), lists(x.words[at].view(np.int64), np.concatenate(([0], np.cumsum(n))), pa.int64())], names=["leaf", "template", "words"])

    return docs.select("text").mapInArrow(run, "leaf long, template long, words array<long>")


def _groups(lines: DataFrame, similar: float) -> DataFrame:
    """(template, group) of distinct lines (leaf, template, words); a group's name is the template of its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, size = None, 0
        for batch in batches:
            leaves, templates = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            at, values = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
            out = np.empty(len(leaves), np.int64)
            for k in range(len(leaves)):
                line = values[at[k] : at[k + 1]]
                if leaves[k] != leaf:
                    leaf, size = leaves[k], 0
                    shared, names = np.empty((8, len(line)), np.int64), np.empty(8, np.int64)
                same = (shared[:size] == line).sum(axis=1)
                best = int(same.argmax()) if size else 0
                if size and same[best] / len(line) >= similar:
                    shared[best][shared[best] != line] = 0  # no word's hash
                else:
                    if size == len(shared):
                        shared, names = np.concatenate((shared, np.empty_like(shared))), np.concatenate((names, np.empty_like(names)))
                    best, size = size, size + 1
                    shared[best], names[best] = line, templates[k]
                out[k] = names[best]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out)], names=["template", "group"])

    return lines.repartition("leaf").sortWithinPartitions("leaf", "words").mapInArrow(run, "template long, group long")


def recurring(docs: DataFrame, hashed: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """(kind, key) of the recurring templates: kind 0 a whole leaf, kind 1 a line as it is before it is generalised."""
    once = hashed.dropDuplicates(["row_key"])
    pairs = F.array_distinct(F.filter(F.arrays_zip("leaves", "templates"), lambda x: x["templates"] != 0))
    templates, path = stored(once.select(F.explode(pairs).alias("x")).groupBy(F.col("x.leaves").alias("leaf"), F.col("x.templates").alias("template")).agg(F.count(F.lit(1)).alias("n")), "templates")
    mixed = templates.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).filter((F.col("kinds") > 1) & (F.col("n") >= min_docs)).select("leaf")
    mixed, path2 = stored(mixed, "mixed-leaves")
    lines, path4 = stored(_leaf_words(docs, Filter(mixed, "leaf")), "leaf-words")
    words = lines.select("leaf", F.posexplode("words").alias("place", "word"))
    fixed = words.groupBy("leaf", "place").agg((F.min("word") == F.max("word")).alias("same")).groupBy("leaf").agg(F.avg(F.col("same").cast("double")).alias("share")).filter(F.col("share") >= similar)
    general = fixed.join(mixed, "leaf", "left_semi").select("leaf")
    general, path3 = stored(general, "general-leaves")
    flat = once.select(F.explode(F.array_distinct(F.filter("leaves", lambda x: x != 0))).alias("leaf"))
    wide = flat.join(general, "leaf", "left_semi").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select(F.lit(0).alias("kind"), F.col("leaf").alias("key"))
    split = lines.join(mixed.join(general, "leaf", "left_anti"), "leaf", "left_semi").dropDuplicates(["template"])
    groups, path5 = stored(_groups(split, similar), "groups")
    held = join_measured(once.select("row_key", F.explode(pairs).alias("x")).select("row_key", F.col("x.templates").alias("template")), groups, "template", "inner", groups.count())
    often = held.select("row_key", "group").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    alike = groups.join(often, "group", "left_semi").select(F.lit(1).alias("kind"), F.col("template").alias("key"))
    narrow = templates.filter(F.col("n") >= min_docs).join(mixed, "leaf", "left_anti").select(F.lit(1).alias("kind"), F.col("template").alias("key"))
    out, _ = stored(wide.unionByName(alike).unionByName(narrow), "recurring")
    discard(docs.sparkSession, path, path2, path3, path4, path5)
    return out


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """docs with the text that is left, n_lines, and dropped: the sorted numbers of the lines that went, from 0."""
    spark = docs.sparkSession
    hashed, path = stored(_hashed(docs.select("doc_id", "text")), "hashed-lines")
    keys = recurring(docs.select("doc_id", "text"), hashed, min_docs, similar)
    wanted = Filter(keys, "key").sent

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(1).offsets)
            for kind, column in ((0, 1), (1, 2)):
                values = np.asarray(batch.column(column).values)
                own = np.flatnonzero((values != 0) & Filter.test(wanted.value, values))
                doc = np.searchsorted(at, own, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(values[own], pa.int64()), batch.column(0).take(pa.array(doc)), pa.array((own - at[doc]).astype(np.int32))], names=["kind", "key", "row_key", "line"])

    hits = hashed.mapInArrow(flagged, "kind int, key long, row_key long, line int").join(keys, ["kind", "key"], "left_semi")
    key, right, gone, lines, dropped, n_lines = fresh(docs.columns, "row_key", "right_key", "gone", "lines", "dropped", "n_lines")
    found = hits.groupBy(F.col("row_key").alias(right)).agg(F.sort_array(F.collect_set("line")).alias(gone))
    out = docs.withColumn(key, _key()).join(found, F.col(key) == F.col(right), "left")
    out = out.withColumn(lines, F.split("text", "\n", -1)).withColumn(dropped, F.coalesce(gone, F.array().cast("array<int>")))
    # The lines that stay are the numbers of all without the dropped ones: one pass by hash, however many there are.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    left = F.when(F.size(dropped) == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col(lines)[i]), "\n"))
    return out.select(*[left.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines), F.col(dropped))


def op10_line_templates(spark, sf_dir: str) -> DataFrame:
    out = drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def brute_force(docs: list[tuple], min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> dict:
    """The same by plain Python, for tests: {doc_id: (n_lines, n_dropped, kept text)}."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    parsed = {d: [tuple("<*>" if re.search("[0-9]", w) else w for w in word.findall(x)) for x in t.split("\n")] if t is not None else [] for d, t in docs}
    leaf = lambda x: (len(x), x[:DEPTH])
    kinds, holders = {}, {}
    for d, xs in parsed.items():
        for x in xs:
            if x:
                kinds.setdefault(leaf(x), set()).add(x)
                holders.setdefault(x, set()).add(d)
    order = lambda x: [int(_FIELD.view(np.int64)) if w == "<*>" else int(hash_text([w], fold=False).view(np.int64)[0]) for w in x]
    recurs = set()
    for xs in kinds.values():
        groups: list[list[tuple]] = []
        for x in sorted(xs, key=order):
            alike = [sum({y[i] for y in g} == {x[i]} for i in range(len(x))) for g in groups]
            if alike and max(alike) / len(x) >= similar:
                groups[alike.index(max(alike))].append(x)
            else:
                groups.append([x])
        recurs.update(x for g in groups if len(set().union(*(holders[y] for y in g))) >= min_docs for x in g)
    gone = lambda x: x in recurs
    out = {}
    for d, t in docs:
        rows = t.split("\n") if t is not None else []
        keep = [r for r, x in zip(rows, parsed[d], strict=True) if not gone(x)]
        out[d] = (len(rows), len(rows) - len(keep), "\n".join(keep))
    return out
