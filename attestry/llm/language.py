"""Language ID by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public byte-level vocabulary that can stand in a word, of any length. Each
language has a probability per piece, fitted by expectation maximisation (forward-backward over all
segmentations) on the words of a bounded sample of labelled documents (there, runs beyond ``FIT_RUN`` bytes are cut). A text's words (runs of ASCII letters and bytes
beyond ASCII, A-Z lower-cased, each with a space in front) are scored by the forward algorithm, which sums
all ways to cut a word of any length into pieces; a document's score is the posterior of its best language.

Defined cases: null text, or text without a letter, is ``und`` with score 0, and so is every text if no
label was learned; a word that no segmentation covers counts alike in all languages; ties go to the smaller language; rows that repeat are predicted alike; an empty table gives an empty result; extra columns pass through,
and added names get underscores in front if they clash.

Scale: one pass over the texts without an exchange. The model is vocabulary x languages. The fit takes
``SAMPLE_DOCS`` documents (expected number, drawn by a hash of doc_id, the same number per language)
whatever the input's size; everything else covers all rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LETTERS, LOWER, blocks, distinct, fresh, hash_words, per_text, released, split_words

FIT_RUN = 256
#: Words of at most so many bytes are scored in groups of equal length; longer ones in a rolling window, CHUNK bytes at a time.
SHORT, CHUNK = 64, 1 << 14
#: The bound of the fit's sample, over all languages.
SAMPLE_DOCS = 1_200
ROUNDS, SMOOTHING = 3, 0.02
#: Words that a worker keeps with their scores (8 + 8 x languages bytes each).
CACHE_WORDS = 500_000
BLOCK = 1 << 20
SLOTS = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


def public_pieces(path: str | None = None) -> list[bytes]:
    """Pieces that can stand in a word: an optional space, then lower-case letters or bytes beyond ASCII."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    fits = lambda p: p and all(b >= 0x80 or 97 <= b <= 122 for b in p.removeprefix(b" "))
    return sorted({p for p in found if fits(p)})


def _slot(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)


class Pieces:
    """Numbers of pieces by hash; number len(pieces) stands for no piece."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for b in p:
                    h = h * _STEP + _BYTE[b]
            keys[i] = h
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.uint64(0))
        slots = _slot(self.keys[:-1])
        self.first = np.full(SLOTS, self.count, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.other = np.setdiff1d(np.arange(len(slots)), self.first)  # share a slot with another piece
        self.other_keys = self.keys[self.other]

    def number(self, h: np.ndarray) -> np.ndarray:
        i = self.first[_slot(h)]
        found = self.keys[i] == h
        out = np.where(found, i, self.count)
        if len(self.other):
            o = np.minimum(np.searchsorted(self.other_keys, h), len(self.other) - 1)
            out = np.where(self.other_keys[o] == h, self.other[o], out)
        return out

    def within(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, piece numbers) for all stretches of equally long words, a row each."""
        values = _BYTE[words]
        for i in range(words.shape[1]):
            h = np.zeros(len(words), np.uint64)
            for j in range(i, min(words.shape[1], i + self.longest)):
                h = h * _STEP + values[:, j]
                yield i, j + 1, self.number(h)


def forward(pieces: Pieces, p: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log probability of each row of words (n x length) in each language, over all segmentations. p has a last row of zeros."""
    n, length = words.shape
    langs = p.shape[1]
    alpha = np.zeros((length + 1, n, langs))
    alpha[0] = 1
    logs = np.zeros((n, langs))
    done = 0
    for i, j, number in pieces.within(words):
        if i > done and i % 24 == 0:  # keeps long words from underflow; only these rows are still read
            top = np.maximum(alpha[i : i + pieces.longest].max(axis=0), 1e-300)
            alpha[i : i + pieces.longest] /= top
            logs += np.log(top)
            done = i
        if (number < pieces.count).any():
            alpha[j] += alpha[i] * p[number]
    return logs + np.log(np.maximum(alpha[length], 1e-300))


def forward_one(pieces: Pieces, p: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The same for one word of any length, in bounded memory: a window of the last sums rolls over it."""
    width, langs = pieces.longest, p.shape[1]
    window = np.zeros((width, langs))  # the sums at the width places before the next one; the last is the nearest
    window[-1] = 1
    logs = np.zeros(langs)
    for begin in range(0, len(word), CHUNK):
        part = word[max(0, begin - width + 1) : begin + CHUNK]
        skip = begin - max(0, begin - width + 1)
        values, number = _BYTE[part], np.full((len(part), width), pieces.count, np.int64)
        h = np.zeros(len(part), np.uint64)
        for d in range(min(width, len(part))):  # pieces of d + 1 bytes, by their last byte
            h = h[: len(part) - d] * _STEP + values[d:]
            number[d:, width - 1 - d] = pieces.number(h)
        use = number < pieces.count
        for k in range(skip, len(part)):
            own = np.flatnonzero(use[k])
            total = (window[own] * p[number[k, own]]).sum(axis=0)
            window[:-1] = window[1:]
            window[-1] = total
            if k % 16 == 0:
                top = np.maximum(window.max(axis=0), 1e-300)
                window /= top
                logs += np.log(top)
    return logs + np.log(np.maximum(window[-1], 1e-300))


def _expected(pieces: Pieces, p: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in each language."""
    n, length = words.shape
    langs = p.shape[1]
    alpha, beta = np.zeros((length + 1, n, langs)), np.zeros((length + 1, n, langs))
    alpha[0], beta[length] = 1, 1
    spans = [(i, j, k) for i, j, k in pieces.within(words) if (k < pieces.count).any()]
    for i, j, k in spans:
        alpha[j] += alpha[i] * p[k]
    for i, j, k in reversed(spans):
        beta[i] += beta[j] * p[k]
    weight = counts / np.maximum(alpha[length], 1e-300)
    out = np.zeros_like(p)
    number = np.concatenate([k for _, _, k in spans])
    for lang in range(langs):
        uses = np.concatenate([alpha[i][:, lang] * p[k, lang] * beta[j][:, lang] * weight[:, lang] for i, j, k in spans])
        out[:, lang] = np.bincount(number, uses, len(p))
    out[-1] = 0
    return out


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for the fit, those beyond FIT_RUN bytes in parts."""
    s, e = split_words(data, offsets, LETTERS)
    n = -(-(e - s) // FIT_RUN)
    own = np.repeat(np.arange(len(s)), n)
    begin = s[own] + FIT_RUN * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(begin + FIT_RUN, e[own])


def _matrices(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length as rows with a space in front: (their indices, bytes), at most 20,000 rows at once."""
    size = e - s
    for length in np.unique(size):
        own = np.flatnonzero(size == length)
        for i in range(0, len(own), 20_000):
            part = own[i : i + 20_000]
            m = np.full((len(part), length + 1), 32, np.uint8)
            m[:, 1:] = LOWER[data[s[part][:, None] + np.arange(length)]]
            yield part, m


class Model:
    def __init__(self, langs: list[str], pieces: Pieces, p: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.p, self.prior = langs, pieces, p, prior
        self.keys, self.logs = np.empty(0, np.uint64), np.empty((0, len(langs)))

    def words(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.empty((len(s), len(self.langs)))
        brief = np.flatnonzero(e - s <= SHORT)
        for own, m in _matrices(data, s[brief], e[brief]):
            out[brief[own]] = forward(self.pieces, self.p, m)
        for i in np.flatnonzero(e - s > SHORT):
            out[i] = forward_one(self.pieces, self.p, np.concatenate((np.full(1, 32, np.uint8), LOWER[data[s[i] : e[i]]])))
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and its number of words."""
        s, e = split_words(data, offsets, LETTERS)
        n = np.diff(per_text(s, offsets))
        total = np.zeros((len(n), len(self.langs)))
        if len(s):
            keys, first, place = distinct(hash_words(data, s, e))
            i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
            miss = np.flatnonzero(self.keys[i] != keys) if len(self.keys) else np.arange(len(keys))
            if len(miss):
                if len(self.keys) + len(miss) > CACHE_WORDS:
                    self.keys, self.logs, miss = np.empty(0, np.uint64), np.empty((0, len(self.langs))), np.arange(len(keys))
                at = first[miss]
                where = np.searchsorted(self.keys, keys[miss])
                self.logs = np.insert(self.logs, where, self.words(data, s[at], e[at]), axis=0)
                self.keys = np.insert(self.keys, where, keys[miss])
                i = np.searchsorted(self.keys, keys)
            owner = np.repeat(np.arange(len(n)), n)
            word = i[place]
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(owner, self.logs[:, k][word], len(n))
        return total, n


def held_out(doc_id) -> object:
    """crc32 of doc_id as text leaves remainder 1 modulo 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: str | None = None) -> Model:
    """Fit on text and lang of documents that aren't held out; docs needs doc_id, text and lang."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    have = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(have)
    pieces = Pieces(names := public_pieces(vocabulary))
    p = np.full((len(names) + 1, max(1, len(langs))), 1.0 / len(names))
    p[-1] = 0
    if not langs:
        return Model([], pieces, p, np.zeros(1))
    each = max(1, sample_docs // len(langs))
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, each / have[lang])))])[F.col("lang")]
    u = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(u < rate).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_of = batch.column(0).to_pylist()
            for i, _, data, offsets in blocks(batch.column(1)):
                s, e = _cut(data, offsets)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(per_text(s, offsets)))
                found: dict[tuple[str, bytes], int] = {}
                body = LOWER[data].tobytes()
                for d, a, b in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True):
                    key = (names_of[i + d], body[a:b])
                    found[key] = found.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")).toArrow()
    words: dict[bytes, np.ndarray] = {}
    for lang, w, n in zip(counted["lang"].to_pylist(), counted["word"].to_pylist(), counted["n"].to_pylist(), strict=True):
        words.setdefault(w, np.zeros(len(langs)))[langs.index(lang)] += n
    ordered = sorted(words)
    if ordered:
        data = np.frombuffer(b"".join(ordered), np.uint8)
        e = np.cumsum([len(w) for w in ordered])
        s = e - np.array([len(w) for w in ordered])
        n = np.array([words[w] for w in ordered])
        for _ in range(ROUNDS):
            uses = np.zeros_like(p)
            for own, m in _matrices(data, s, e):
                uses += _expected(pieces, p, m, n[own])
            uses[:-1] += SMOOTHING
            p = uses / uses.sum(axis=0)
            p[-1] = 0
    return Model(langs, pieces, p, np.log(np.full(len(langs), 1.0 / len(langs))))


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its posterior; only ``text`` is read for it."""
    pred, score = fresh(docs.columns, pred, score)
    at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(r"\p{L}"), sent.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(at), BLOCK):
                total, n = m.scores(data, offsets)
                ascii_letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), dtype=np.int64)))
                some = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for k in np.flatnonzero((n > 0) & ~some):
                    some[k] = letter.search(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")) is not None
                best, top = np.full(j - i, len(m.langs)), np.zeros(j - i)
                if m.langs:
                    total += m.prior
                    total -= total.max(axis=1, keepdims=True)
                    share = np.exp(total)
                    share /= share.sum(axis=1, keepdims=True)
                    best, top = np.where(some, total.argmax(axis=1), len(m.langs)), np.where(some, share.max(axis=1), 0.0)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(top)], names=[*batch.schema.names, pred, score])

    return docs.mapInArrow(released(run), schema)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that have no letter or whose best language has less than ``least`` of the posterior."""
    pred, score = fresh(docs.columns, "lang_pred", "score")
    return identify(docs, learn(docs)).filter((F.col(pred) != "und") & (F.col(score) >= least)).drop(pred, score)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
