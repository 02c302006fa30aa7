"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents. A block is a run of documents of about BLOCK_BYTES; its row holds the
sorted terms of the block and for each the sorted positions at which it stands (postings), and the
documents' first positions and row names. All postings of all terms are stored as Parquet, once; any number of
test sets can be searched in it.

A test set becomes a table of windows (phrases with their item). A search joins a block's terms with the
windows' rarest terms in the whole corpus, so a window costs nothing in a block that lacks its rarest term; it
then shifts that term's postings by the term's place in the phrase and intersects them with the shifted postings
of the next rarest terms until all are used. For proximity the same lists are met within a distance: a window
is near a place of its first word if all its other words stand at most ``slop`` words away from it, in any order.

Defined cases: null text has no words; an item without words occurs nowhere; an item of fewer than
``width`` words is one window; rows that repeat an item_id count as one item, and a null item_id is named
"null"; rows that repeat a doc_id give a row each, and each is decided alone; an empty table gives an empty
result, an empty benchmark no hits; extra columns are not read. Terms are 64-bit hashes of words.

Scale: the texts are read once and never shuffled. What is broadcast are WINDOWS windows at most (about 250
bytes each); with more, they go out in several searches of the same index, and only documents with hits are shuffled, by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, blocks, hash_words, join_measured, kept, keyed, lists, named_rows, per_text, ranges, released, scope, split_words, stored

WIDTH, SLOP = 13, 26
#: Windows that are searched at once.
WINDOWS = 200_000

INDEX = "parts array<long>, lines array<long>, doc_ids array<long>, firsts array<int>, terms array<long>, counts array<int>, positions array<int>"
_INDEX = pa.schema([*((c, pa.list_(pa.int64())) for c in ("parts", "lines", "doc_ids")), ("firsts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("counts", "positions"))])


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, term of every word, each row's first word) of runs of rows."""
    for i, j, data, offsets in blocks(column):
        s, e = split_words(data, offsets, ALNUM)
        yield i, j, hash_words(data, s, e).view(np.int64), per_text(s, offsets)


def build_index(docs: DataFrame) -> DataFrame:
    """A row per block of documents (INDEX); docs has doc_id, text, and part and line, which name the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, firsts in _terms(batch.column(1)):
                at = np.argsort(h, kind="stable")
                h = h[at]
                cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(c).slice(i, j - i).cast(pa.int64()))  # noqa: B023, E731
                one = lambda v, t: lists(v, np.array([0, len(v)]), t)
                yield pa.RecordBatch.from_arrays([whole(2), whole(3), whole(0), one(firsts, pa.int32()), one(h[cut], pa.int64()), one(np.diff(np.append(cut, len(h))), pa.int32()), one(at, pa.int32())], schema=_INDEX)

    return docs.select("doc_id", "text", "part", "line").mapInArrow(released(run), INDEX)


class Block:
    """One row of the index, ready for lookups."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.firsts, self.terms = row["firsts"].astype(np.int64), row["terms"]
        self.ends = np.cumsum(row["counts"].astype(np.int64))
        self.begins = self.ends - row["counts"]
        self.positions = row["positions"].astype(np.int64)
        self.size = int(self.firsts[-1])
        owner = np.repeat(np.arange(len(self.terms)), row["counts"])
        #: The same lists laid out by position, which makes an intersection with a shifted list one lookup per entry.
        self.term_at = np.full(self.size, -1, np.int64)
        self.term_at[self.positions] = owner
        #: And as one sorted list, in which any list's entries between two positions are found.
        self.keys = owner * (self.size + 1) + self.positions
        self.doc_at = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Number in this block of each term; -1: it has no postings here."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def anchored(self, q: "Phrases") -> tuple["Phrases", np.ndarray, np.ndarray, np.ndarray]:
        """The phrases whose terms are all in this block, (phrase, place of its rarest term) of all their places, and the numbers of their terms."""
        low, high = np.searchsorted(q.anchors, self.terms), np.searchsorted(q.anchors, self.terms, "right")
        mine = np.flatnonzero(high > low)
        alive, anchor = q.by_anchor[ranges(low[mine], (high - low)[mine])], np.repeat(mine, (high - low)[mine])
        local = self.number(q.terms[alive].ravel()).reshape(len(alive), q.terms.shape[1])
        ok = ((local >= 0) | (np.arange(local.shape[1]) >= q.length[alive, None])).all(axis=1)
        alive, anchor, local = alive[ok], anchor[ok], local[ok]
        counts = self.ends[anchor] - self.begins[anchor]
        return q.only(alive), np.repeat(np.arange(len(alive)), counts), self.positions[ranges(self.begins[anchor], counts)], local

    def phrases(self, q: "Phrases", phrase: np.ndarray, at: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every occurrence that stays within one document."""
        start = at - q.place[phrase, 0]
        ok = (start >= 0) & (start + q.length[phrase] <= self.size)
        phrase, start = phrase[ok], start[ok]
        for k in range(1, q.place.shape[1]):
            if not len(phrase):
                break
            more = k < q.length[phrase]
            ok = ~more
            ok[more] = self.term_at[start[more] + q.place[phrase[more], k]] == local[phrase[more], k]
            phrase, start = phrase[ok], start[ok]
        ok = self.doc_at[start] == self.doc_at[start + q.length[phrase] - 1]
        return phrase[ok], start[ok]

    def close(self, number: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term stands at most slop words away from at, in the same document."""
        doc = self.doc_at[at]
        low, high = np.maximum(at - slop, self.firsts[doc]), np.minimum(at + slop, self.firsts[doc + 1] - 1)
        i = np.minimum(np.searchsorted(self.keys, number * (self.size + 1) + low), len(self.keys) - 1)
        found = self.keys[i] - number * (self.size + 1)
        return (found >= low) & (found <= high)

    def near(self, q: "Phrases", phrase: np.ndarray, at: np.ndarray, local: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) wherever all its other words stand at most slop words away."""
        for k in range(1, q.place.shape[1]):  # all stand around the rarest one, twice as far at most
            if not len(phrase):
                break
            ok = k >= q.length[phrase]
            ok[~ok] = self.close(local[phrase[~ok], k], at[~ok], 2 * slop)
            phrase, at = phrase[ok], at[ok]
        if not len(phrase):
            return phrase, at
        first = local[phrase, q.first[phrase]]
        doc = self.doc_at[at]
        low, high = np.maximum(at - slop, self.firsts[doc]), np.minimum(at + slop, self.firsts[doc + 1] - 1)
        x = np.searchsorted(self.keys, first * (self.size + 1) + low)
        y = np.searchsorted(self.keys, first * (self.size + 1) + high, "right")
        phrase, at = np.repeat(phrase, y - x), self.positions[ranges(x, y - x)]
        pair = np.unique(phrase * (self.size + 1) + at)
        phrase, at = pair // (self.size + 1), pair % (self.size + 1)
        for k in range(q.place.shape[1]):
            if not len(phrase):
                break
            ok = k >= q.length[phrase]
            ok[~ok] = self.close(local[phrase[~ok], k], at[~ok], slop)
            phrase, at = phrase[ok], at[ok]
        return phrase, at


class Phrases:
    """Phrases, a row each, with terms in order of corpus frequency, rarest first (ties: by place)."""

    def __init__(self, terms: np.ndarray, length: np.ndarray, known: np.ndarray, count: np.ndarray):
        i = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
        seen = np.where(known[i] == terms, count[i], 0) if len(known) else np.zeros(terms.shape, np.int64)
        beyond = np.arange(terms.shape[1]) >= length[:, None]
        seen[beyond] = np.iinfo(np.int64).max
        self.place = np.argsort(seen, axis=1, kind="stable")
        self.terms, self.length = np.take_along_axis(terms, self.place, 1), length
        self.first = self.place.argmin(axis=1)
        self.place[np.take_along_axis(beyond, self.place, 1)] = 0
        able = np.flatnonzero(np.take_along_axis(seen, self.place[:, :1], 1)[:, 0] > 0) if len(terms) else np.empty(0, np.int64)  # else a term is nowhere
        anchors = self.terms[able, 0] if len(able) else np.empty(0, np.int64)
        order = np.argsort(anchors, kind="stable")
        self.anchors, self.by_anchor = anchors[order], able[order]
        self.number = np.arange(len(terms))

    def only(self, which: np.ndarray) -> "Phrases":
        """Some of the phrases, for one block; number has their places among all."""
        out = object.__new__(Phrases)
        out.place, out.length, out.first, out.number = self.place[which], self.length[which], self.first[which], which
        return out


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, terms) of the distinct windows of each item of benchmark (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, h, firsts in _terms(batch.column(1)):
                n = np.diff(firsts)
                count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
                owner, begin = np.repeat(np.arange(len(n)), count), ranges(firsts[:-1], count)
                for x in range(0, len(owner), 20_000):
                    who, at = owner[x : x + 20_000], begin[x : x + 20_000]
                    size = np.minimum(n[who], width)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + who)), lists(h[ranges(at, size)], np.concatenate(([0], np.cumsum(size))), pa.int64())], names=["item", "terms"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    return named.mapInArrow(released(run), "item string, terms array<long>").distinct()


def _index_rows(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, pa.Array], dict[str, np.ndarray]]]:
    for i in range(batch.num_rows):
        values = {n: batch.column(k)[i].values for k, n in enumerate(batch.schema.names)}
        yield {n: values.pop(n) for n in ("parts", "lines", "doc_ids") if n in values}, {n: v.to_numpy(zero_copy_only=False) for n, v in values.items()}


def frequencies(index: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the wanted terms (sorted) that the corpus holds, and how often."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, row in _index_rows(batch):
                i = np.minimum(np.searchsorted(sent.value, row["terms"]), max(0, len(sent.value) - 1))
                ok = sent.value[i] == row["terms"] if len(sent.value) else np.zeros(len(i), bool)
                total[i[ok]] += row["counts"][ok]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some]), pa.array(total[some])], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toArrow()
    return found["term"].to_numpy(), found["n"].to_numpy()


HITS = "part long, line long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>, near array<string>"
_HITS = pa.schema([*((c, pa.int64()) for c in ("part", "line", "doc_id", "n_words")), *((c, pa.list_(pa.int64())) for c in ("begins", "ends")), *((c, pa.list_(pa.string())) for c in ("items", "near"))])


def search(index: DataFrame, test: DataFrame, slop: int = SLOP, every: bool = True) -> DataFrame:
    """A row per document (HITS): maximal runs of words in exact matches, the items of these, and the items with a window near a place; test has at most WINDOWS windows. With every=False, documents without either are left out."""
    found = test.toArrow()
    flat = found["terms"].combine_chunks()
    at = np.asarray(flat.offsets).astype(np.int64) if len(flat) else np.zeros(1, np.int64)
    length = np.diff(at)
    terms = np.zeros((len(length), int(length.max(initial=1))), np.int64)
    terms[np.repeat(np.arange(len(length)), length), ranges(np.zeros(len(length), np.int64), length)] = np.asarray(flat.values)[at[0] : at[-1]] if len(flat) else np.empty(0, np.int64)
    names, owner = np.unique(np.array(found["item"].to_pylist(), dtype=object).astype(str), return_inverse=True) if len(length) else (np.empty(0, str), np.empty(0, np.int64))
    wanted = np.unique(np.asarray(flat.values)) if len(flat) else np.empty(0, np.int64)
    sent = index.sparkSession.sparkContext.broadcast((Phrases(terms, length, *frequencies(index, wanted)), owner, names.astype(object)))

    def of_docs(doc: np.ndarray, item: np.ndarray, n: int, names_: np.ndarray) -> pa.Array:
        """A list per document of the distinct names, sorted as strings, as item numbers are."""
        pair = np.unique(doc * max(1, len(names_)) + item) if len(doc) else np.empty(0, np.int64)
        d, k = pair // max(1, len(names_)), pair % max(1, len(names_))
        return lists(names_[k], np.searchsorted(d, np.arange(n + 1)), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, owner, names = sent.value
        for batch in batches:
            for ids, row in _index_rows(batch):
                block = Block(row)
                n = len(ids["doc_ids"])
                here, *where = block.anchored(phrases)
                phrase, start = block.phrases(here, *where)
                close, place = block.near(here, *where, slop)
                order = np.lexsort((start, block.doc_at[start]))
                phrase, start = phrase[order], start[order]
                doc, stop = block.doc_at[start], start + here.length[phrase]
                if len(start):  # runs: a start beyond all earlier ends of its document opens one
                    top = np.maximum.accumulate(stop)
                    opens = np.flatnonzero(np.concatenate(([True], (start[1:] > top[:-1]) | (doc[1:] != doc[:-1]))))
                    begins, ends, run_doc = start[opens], np.maximum.reduceat(stop, opens), doc[opens]
                else:
                    begins = ends = run_doc = np.empty(0, np.int64)
                cuts = np.searchsorted(run_doc, np.arange(n + 1))
                base = block.firsts[run_doc]
                out = pa.RecordBatch.from_arrays(
                    [ids["parts"], ids["lines"], ids["doc_ids"], pa.array(np.diff(block.firsts)), lists(begins - base, cuts, pa.int64()), lists(ends - base, cuts, pa.int64()), of_docs(doc, owner[here.number[phrase]], n, names), of_docs(block.doc_at[place], owner[here.number[close]], n, names)],
                    schema=_HITS,
                )
                if not every:
                    some = np.zeros(n, bool)
                    some[doc] = some[block.doc_at[place]] = True
                    out = out.filter(pa.array(some))
                yield out

    return index.mapInArrow(released(run), HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, at_once: int = WINDOWS) -> DataFrame:
    """Per row of docs (doc_id, text, part, line): part, line, doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, near and the runs (begins, ends) of hit words."""
    index, _ = stored(build_index(docs), "postings", compression="zstd")
    test, _ = stored(windows(benchmark, width), "windows")
    n_blocks = max(1, -(-test.count() // at_once))
    block = F.pmod(F.xxhash64("item", "terms"), F.lit(n_blocks))
    if n_blocks == 1:
        hits = search(index, test)
    else:
        both = search(index, test.filter(block == 0))
        for b in range(1, n_blocks):
            both = both.unionByName(search(index, test.filter(block == b), every=False))
        names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        joined = both.groupBy("part", "line").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("runs"), names("items"), names("near")
        )
        merged = F.aggregate(
            "runs",
            F.array().cast("array<struct<begins:bigint,ends:bigint>>"),
            lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= r["begins"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begins"].alias("begins"), F.greatest(F.element_at(acc, -1)["ends"], r["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(r))),
        )
        joined = joined.withColumn("runs", merged)
        hits = joined.select("part", "line", "doc_id", "n_words", F.col("runs.begins").alias("begins"), F.col("runs.ends").alias("ends"), "items", "near")
    n_hit = F.coalesce(F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return hits.select(
        "part", "line", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.size("near").cast("long").alias("n_near"), "items", "near", "begins", "ends",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain benchmark passages in at least a twentieth of their words."""
    own, part, line = keyed(docs)
    with scope(docs.sparkSession):
        rows = contamination(own.select("doc_id", "text", F.col(part).alias("part"), F.col(line).alias("line")), benchmark)
        bad, _ = kept(rows.filter("contaminated").select(F.col("part").alias(part), F.col("line").alias(line)), "contaminated")
    return join_measured(own, bad, [part, line], "left_anti", bad.count()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(named_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), d AS (
  SELECT row_number() OVER () AS r, doc_id, words, len(words)::BIGINT AS n_words FROM w
), items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL
), wins AS (
  SELECT DISTINCT item, list_slice(words, i, i + least(len(words), 13) - 1) AS win
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), phrases AS (
  SELECT row_number() OVER () AS p, win, len(win) AS n, win[1] AS head, list_distinct(win) AS terms FROM (SELECT DISTINCT win FROM wins)
), spots AS (
  SELECT r, unnest(words) AS word, unnest(range(1, n_words + 1)) AS i FROM d
), often AS (
  SELECT word, count(*) AS c FROM spots GROUP BY word
), rare AS (
  SELECT p, min_by(term, coalesce(c, 0)) AS term FROM (SELECT p, unnest(terms) AS term FROM phrases) LEFT JOIN often ON term = word GROUP BY p
), able AS (
  SELECT r, p FROM (SELECT DISTINCT r, word FROM spots) JOIN rare ON word = term
), met AS (
  SELECT r, p, n, i, list_slice(words, i, i + n - 1) = win AS exact
  FROM able JOIN phrases USING (p) JOIN d USING (r) JOIN spots USING (r)
  WHERE word = head AND list_has_all(list_slice(words, greatest(i - 26, 1), least(i + 26, n_words)), terms)
), hit AS (
  SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met WHERE exact) GROUP BY r
), found AS (
  SELECT r, array_to_string(list_sort(list(DISTINCT item) FILTER (WHERE exact)), ',') AS names, count(DISTINCT item) FILTER (WHERE exact)::BIGINT AS n_items, count(DISTINCT item)::BIGINT AS n_near
  FROM met JOIN phrases USING (p) JOIN wins USING (win) GROUP BY r
)
SELECT doc_id, n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> dict:
    """The same by plain Python, for tests: {doc_id: (n_words, n_hit, n_items, sha, contaminated, n_near)}."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    wins = {}
    for name, text in items:
        w = word.findall(lower(text))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(name))
    out, starts = {}, {}
    for win in wins:
        starts.setdefault(win[0], []).append(win)
    for doc_id, text in docs:
        w = word.findall(lower(text))
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (names := wins.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= names
        near = set()
        for i, x in enumerate(w):
            for win in starts.get(x, ()):
                if set(win) <= set(w[max(0, i - SLOP) : i + SLOP + 1]):
                    near |= wins[win]
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near))
    return out
