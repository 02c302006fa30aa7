"""License scans by template-markup matching.

A template is text with markup: ``<<beginOptional>>...<<endOptional>>`` encloses wording that may be
absent, ``<<var;name="n";original="o";match="m">>`` stands for replaceable wording, where m is ``.+``,
``.*`` or ``.{a,b}`` (so many words; the first two without a bound but the text's ends) or alternatives ``x|y``. Its
longest stretch of mandatory words is the anchor; what stands before and behind it is compiled into token automata,
one read backwards and one forwards. They accept exactly if all mandatory words stand there in order, with
nothing between but what the markup allows. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased,
so case, punctuation and line breaks don't matter.

Base phrases are templates without markup. Everything is found at every word of every whole text; a template's
place is the word at which its anchor stands.

Defined cases: null text is empty, without words and labels; first_word and last_word are null where no
base phrase stands; matches that overlap all count; rows that repeat give a row each; an empty table gives an empty
result; extra columns are not read. Words are compared by 64-bit hashes.

Scale: one pass without an exchange. Automata run only where their anchor stands, which is found for whole blocks
at once; if a text holds an anchor often, one run over the text serves all its places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .shared import ALNUM, blocks, hash_text, hash_words, per_text, split_words

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Places of an anchor in one text from which on one run over the text decides all of them.
MANY = 4

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;.*?)>>", re.S)


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def parsed(template: str) -> list[tuple]:
    """A template as items: ("word", w), ("optional", items), ("words", least, most or None), ("ways", [words, ...])."""
    levels: list[list[tuple]] = [[]]
    at = 0
    for m in [*_MARK.finditer(template), None]:
        levels[-1] += [("word", w) for w in words_of(template[at : m.start() if m else len(template)])]
        if not m:
            break
        at = m.end()
        if m[1] == "beginOptional":
            levels.append([])
        elif m[1] == "endOptional":
            if len(levels) == 1:
                raise ValueError("endOptional without beginOptional")
            items = levels.pop()
            levels[-1].append(("optional", items))
        else:
            match = dict(re.findall(r'(\w+)="(.*?)"', m[1])).get("match", ".+")
            if x := re.fullmatch(r"\.(?:(\+)|\*|\{(\d+),(\d+)\})", match):
                levels[-1].append(("words", int(x[2]), int(x[3])) if x[2] else ("words", 1 if x[1] else 0, None))
            else:
                levels[-1].append(("ways", [words_of(way) for way in match.split("|")]))
    if len(levels) > 1:
        raise ValueError("beginOptional without endOptional")
    return levels[0]


def turned(items: list[tuple]) -> list[tuple]:
    """The same, read backwards."""
    one = {"optional": lambda x: ("optional", turned(x[1])), "ways": lambda x: ("ways", [w[::-1] for w in x[1]])}
    return [one.get(x[0], lambda y: y)(x) for x in reversed(items)]


class Side:
    """An automaton of items: step[s] maps a word's hash to states, free[s] are states reached without a word, any[s] by any word."""

    def __init__(self, items: list[tuple]):
        self.step: list[dict[int, set[int]]] = []
        self.free: list[set[int]] = []
        self.any: list[set[int]] = []
        self.end = self._all(self._new(), items)

    def _new(self) -> int:
        self.step.append({})
        self.free.append(set())
        self.any.append(set())
        return len(self.step) - 1

    def _word(self, a: int, word: str) -> int:
        b = self._new()
        self.step[a].setdefault(int(hash_text([word])[0]), set()).add(b)
        return b

    def _all(self, at: int, items: list[tuple]) -> int:
        for kind, *x in items:
            if kind == "word":
                at = self._word(at, x[0])
                continue
            end = self._new()
            if kind == "optional":
                self.free[at].add(end)
                self.free[self._all(at_inside := self._new(), x[0])].add(end)
                self.free[at].add(at_inside)
            elif kind == "ways":
                for way in x[0]:
                    b = at
                    for w in way:
                        b = self._word(b, w)
                    self.free[b].add(end)
            else:
                least, most = x
                for k in range(least if most is None else most):
                    if most is not None and k >= least:
                        self.free[at].add(end)
                    b = self._new()
                    self.any[at].add(b)
                    at = b
                if most is None:  # a state of its own, so that it loops only here
                    b = self._new()
                    self.free[at].add(b)
                    self.any[b].add(b)
                    at = b
                self.free[at].add(end)
            at = end
        return at

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def after(self, states: set[int], word: int) -> set[int]:
        return self.closed({t for s in states for t in (*self.step[s].get(word, ()), *self.any[s])})

    def accepts(self, words: np.ndarray) -> bool:
        """Whether some of these words, from the first on, are accepted."""
        states = self.closed({0})
        for w in words:
            if self.end in states or not states:
                break
            states = self.after(states, int(w))
        return self.end in states

    def ends(self, words: np.ndarray) -> np.ndarray:
        """For each gap between words (the first is before all), whether words that end there are accepted."""
        start = frozenset(self.closed({0}))
        states, out = set(start), np.zeros(len(words) + 1, bool)
        out[0] = self.end in states
        for k, w in enumerate(words):
            states = self.after(states, int(w)) | start
            out[k + 1] = self.end in states
        return out


class Automaton:
    """A template: its anchor's hashes, and automata of what stands before and behind."""

    def __init__(self, label: str, template: str):
        self.label = label
        items = parsed(template)
        runs, at = [], 0
        while at < len(items):
            stop = at
            while stop < len(items) and items[stop][0] == "word":
                stop += 1
            runs.append((stop - at, -at))
            at = max(stop, at + 1)
        size, at = max(runs, default=(0, 0))
        if not size:
            raise ValueError("a template needs mandatory words")
        at = -at
        self.anchor = hash_text([w for _, w in items[at : at + size]])
        before, behind = items[:at], items[at + size :]
        #: Read backwards from the anchor and forwards behind it; and each the other way, for many places at once.
        self.before, self.behind = (Side(turned(before)), Side(before)) if before else None, (Side(behind), Side(turned(behind))) if behind else None

    def places(self, words: np.ndarray, firsts: np.ndarray, stops: np.ndarray) -> list[int]:
        """Words at which the anchor of a match stands; firsts and stops: for each word, where its text begins and ends."""
        n = len(self.anchor)
        if len(words) < n:
            return []
        at = np.flatnonzero(words[: len(words) - n + 1] == self.anchor[0])
        for k in range(1, n):
            at = at[words[at + k] == self.anchor[k]]
        at = at[at + n <= stops[at]]
        if not self.before and not self.behind:
            return at.tolist()
        out = []
        for own in np.split(at, np.flatnonzero(np.diff(firsts[at])) + 1) if len(at) else []:
            first, stop = int(firsts[own[0]]), int(stops[own[0]])
            ok = np.ones(len(own), bool)
            if len(own) <= MANY:
                if self.before:
                    ok &= [self.before[0].accepts(words[first:a][::-1]) for a in own]
                if self.behind:
                    ok &= [self.behind[0].accepts(words[a + n : stop]) for a in own]
            else:
                if self.before:
                    ok &= self.before[1].ends(words[first : own[-1]])[own - first]
                if self.behind:
                    ok &= self.behind[1].ends(words[own[0] + n : stop][::-1])[stop - own - n]
            out += own[ok].tolist()
        return out


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> tuple[list[Automaton], list[Automaton]]:
    return [Automaton(label, t) for label, t in templates], [Automaton(label, p) for p, label in base]


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long>>"
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """A row per row of docs (doc_id, text): SCAN. score: 1 where a template matches, else 0.5 where a base phrase stands, else 0. places: each label's matches."""
    fixed, phrases = tuple(map(tuple, templates)), tuple(base.items())
    compiled(fixed, phrases)  # faults in a template show here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, plain = compiled(fixed, phrases)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                s, e = split_words(data, offsets, ALNUM)
                words = hash_words(data, s, e)
                first = per_text(s, offsets)
                n = np.diff(first)
                firsts, stops = np.repeat(first[:-1], n), np.repeat(first[1:], n)
                found: list[list[tuple[bool, str, int]]] = [[] for _ in range(j - i)]
                for is_base, a in [*((True, a) for a in plain), *((False, a) for a in own)]:
                    at = a.places(words, firsts, stops)
                    for doc, word in zip((np.searchsorted(first, at, "right") - 1).tolist(), at, strict=True):
                        found[doc].append((is_base, a.label, word - int(first[doc])))
                starts = [[w for b, _, w in x if b] for x in found]
                label = lambda x, all_too: ",".join(sorted({y for b, y, _ in x if b or all_too}))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([len(x) for x in starts], pa.int64()),
                        pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()),
                        pa.array([label(x, False) for x in found], pa.string()), pa.array([label(x, True) for x in found], pa.string()),
                        pa.array([1.0 if any(not b for b, _, _ in x) else 0.5 if x else 0.0 for x in found], pa.float64()),
                        pa.array([[{"label": y, "word": w} for _, y, w in sorted(x, key=lambda z: (z[2], z[1]))] for x in found], _PLACE),
                    ],
                    names=[c.split()[0] for c in SCAN.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCAN)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("places")


def pattern(template: str) -> str:
    """The template as a regular expression over words that each have a space in front, for SQL."""
    def of(items: list[tuple]) -> str:
        return "".join(
            f" {x[0]}" if kind == "word" else f"(?:{of(x[0])})?" if kind == "optional" else "(?:" + "|".join("".join(f" {w}" for w in way) for way in x[0]) + ")" if kind == "ways" else "(?: [^ ]+){%d,%s}" % (x[0], "" if x[1] is None else x[1])
            for kind, *x in items
        )

    return of(parsed(template)) + " "


_PLACES = "list_filter(range(0, len(words)), lambda i: {})"
_HERE = " OR ".join(f"list_slice(words, i + 1, i + {len(p.split())}) = {p.split()}" for p in BASE)
ORACLE = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), p AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, {_PLACES.format(_HERE)} AS places, ' ' || array_to_string(words, ' ') || ' ' AS t FROM w
), l AS (
  SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
    list_filter([{", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{label}' END" for p, label in BASE.items())}], lambda x: x IS NOT NULL) AS base,
    list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES)}], lambda x: x IS NOT NULL) AS own
  FROM p
)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0::DOUBLE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM l
"""
