"""N-gram Jaccard join with filters from several global token orders.

A document's set holds its distinct five-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased; fewer
words: the whole sequence is one). Two documents link when 100 * shared >= 75 * united. Sets are numbered by
a hash, so exact copies are one node.

A global order of tokens gives each set x a prefix of |x| - ceil(0.75 |x|) + 1 tokens; linked sets share a
prefix token under every order, and even as many as the rest of their sets leaves to be shared. All
``ORDERS`` orders sort tokens by the number of sets that hold them, in classes, and differ within a class.
Tokens of one set come first in all of them and can't be shared, so they are never indexed, and a set that
has more of them than its prefix is long links with nothing. The join runs in four steps:

1. Tokens meet in buckets and are counted there; those of several sets return to their sets. Sets that still
   can link are stored with these tokens alone; their overlaps follow from them exactly.
2. Stars. The prefixes meet in buckets, a posting list per token and order. In each list the most central
   set of each size band meets the others, and neighbours in centrality meet; pairs are as many as list entries.
   They are verified and merged into components.
3. Orders. In the same lists all pairs of sets from different components meet that pass tests of size, position
   and of a bitmap that bounds their overlap. A pair is a candidate only if it reaches the needed number of shared
   prefix tokens under all orders: the filters are intersected.
4. Candidates are verified on the sets in rounds, those that share most first; after each round the
   components grow, and pairs within one need no test. At the end every candidate was tested or connected.

Defined cases: null, empty or blank text has an empty set and links with nothing; component_id of such a
row is its doc_id; rows that repeat a doc_id count as documents of that id; a null doc_id is never a
component's smallest, and a component that has no other id is null; an empty table gives an empty result;
extra columns are not read. Tokens and sets are compared by 64-bit hashes.

Scale: texts are read twice and never shuffled; tokens are shuffled once, packed by block and bucket, 8 bytes
each. Very frequent tokens (a bounded list) skip that shuffle, so no bucket holds a hot one, and of a text with
very many copies one row alone sends tokens. Nothing is dropped: both lists only change what travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, extended
from .shared import NONSPACE, blocks, discard, hash_words, join_measured, kept, keyed, lists, mix, named_rows, per_text, ranges, released, scope, split_words, stored

WORDS = 5
ORDERS = 3
#: Tokens that meet in one bucket to be counted, and entries of posting lists in one bucket, about.
BUCKET, LIST_BUCKET = 1_000_000, 400_000
#: Sets of a block that hold a token, from which on it is counted as a frequent one, and its sets in all, at least.
OFTEN, FREQUENT = 4, 1_000
#: Rows of a text from which on one of them alone sends its tokens.
COPIES = 64
#: Entries of the list of frequent tokens at most (8 bytes each); an eighth of that for copied texts (24 bytes each).
LISTED = 1_000_000
#: Words of 64 bits in a set's bitmap.
WORD_BITS = 16

_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and their offsets."""
    s, e = split_words(data, offsets, NONSPACE)
    first = per_text(s, offsets)
    n = np.diff(first)
    h = hash_words(data, s, e)
    total = np.zeros(max(0, len(h)), np.uint64)
    for k in range(WORDS):
        total[: len(h) - k] = total[: len(h) - k] * _U(0x9E3779B97F4A7C15) + h[k:] if len(h) > k else total[: len(h) - k]
    count = np.where(n >= WORDS, n - WORDS + 1, 0)
    values = np.maximum(mix(total[ranges(first[:-1], count)]), _U(1))  # 0 is no token
    owner = np.repeat(np.arange(len(n)), count)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        own = []
        for i in few:
            x = _U(n[i])
            with np.errstate(over="ignore"):
                for w in h[first[i] : first[i + 1]]:
                    x = x * _U(0xC2B2AE3D27D4EB4F) + w
            own.append(x)
        values, owner = np.concatenate((values, np.maximum(mix(np.array(own, np.uint64)), _U(1)))), np.concatenate((owner, few))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def set_numbers(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set that is not empty, as int64; 0 for an empty one."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        out[some] = np.maximum(mix(np.add.reduceat(mix(values ^ _U(0xA0761D6478BD642F)), at[:-1][some]) + n[some].astype(np.uint64)), _U(1))
    return out.view(np.int64)


def _seed(k: int) -> np.uint64:
    return mix(np.array([k + 1], np.uint64))[0]


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared tokens that sets of these sizes need to link: the least i with 175 i >= 75 (a + b)."""
    return -((-3 * (a + b)) // 7)


# --- step 0: nodes ------------------------------------------------------------------------------------

NODES = "doc_id long, part long, line long, node long, n long, often array<long>, often_n array<long>"
_NODES = pa.schema([*((c, pa.int64()) for c in ("doc_id", "part", "line", "node", "n")), ("often", pa.list_(pa.int64())), ("often_n", pa.list_(pa.int64()))])


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in blocks(column):
        yield i, j, *shingle_sets(data, offsets)


def _of(values: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some of the sets, and their sizes."""
    n = np.diff(at)[own]
    return values[ranges(at[:-1][own], n)], n


def number_documents(docs: DataFrame) -> DataFrame:
    """A row per document of docs (doc_id, text, part, line) (NODES): its set's number (null: empty) and size; a block's first row has the tokens that OFTEN or more of the block's sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in _sets(batch.column(1)):
                n, node = np.diff(at), set_numbers(values, at)
                once = np.unique(node, return_index=True)[1]
                tokens = np.sort(_of(values, at, once)[0])
                far = tokens[OFTEN - 1 :] == tokens[: len(tokens) - OFTEN + 1] if len(tokens) >= OFTEN else np.empty(0, bool)
                often = np.unique(tokens[: len(far)][far])
                count = np.searchsorted(tokens, often, "right") - np.searchsorted(tokens, often)
                cuts = np.array([0, *[len(often)] * (j - i)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), *(batch.column(k).slice(i, j - i) for k in (2, 3)), pa.array(node, pa.int64(), mask=node == 0), pa.array(n, pa.int64()), lists(often.view(np.int64), cuts, pa.int64()), lists(count, cuts, pa.int64())],
                    schema=_NODES,
                )

    return docs.select("doc_id", "text", "part", "line").mapInArrow(released(run), NODES)


def _frequent(nodes: DataFrame, rows: int) -> np.ndarray:
    """Tokens that a thousandth of all rows hold (and FREQUENT at least), sorted: so at most 1,000 times a set's mean size, and never more than LISTED."""
    x = F.explode(F.arrays_zip("often", "often_n")).alias("x")
    found = nodes.filter(F.size("often") > 0).select(x).groupBy(F.col("x.often").alias("token")).agg(F.sum("x.often_n").alias("n")).filter(F.col("n") >= max(FREQUENT, rows // 1000))
    return np.sort(found.orderBy(F.col("n").desc(), "token").limit(LISTED).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def _copied(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets with the most rows (COPIES at least, LISTED / 8 of them at most), sorted, and for each the row that stands for it."""
    found = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("part", "line")).alias("x")).filter(F.col("c") >= COPIES)
    t = found.orderBy(F.col("c").desc(), "node").limit(LISTED // 8).orderBy("node").select("node", "x.part", "x.line").toArrow()
    return t["node"].to_numpy(), t["part"].to_numpy(), t["line"].to_numpy()


# --- step 1: tokens that several sets hold ----------------------------------------------------------------

#: Runs of tokens by set; held is the class of each token, sizes are 0 where another record has them.
RUNS = "bucket int, nodes binary, sizes binary, counts binary, tokens binary, held binary"
_RUNS = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("nodes", "sizes", "counts", "tokens", "held"))])
#: Class of the tokens of the frequent list; other classes grow with the logarithm of the count.
TOP = 255


def _dealt(bucket: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, held: np.ndarray | None) -> list[list]:
    """Rows of RUNS from entries: each has a bucket, an owner (index in nodes and sizes) and a token."""
    order = np.lexsort((owner, bucket))
    bucket, owner, tokens = bucket[order], owner[order], tokens[order]
    held = np.zeros(len(tokens), np.uint8) if held is None else held[order]
    cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))) if len(bucket) else np.empty(0, np.int64)
    count, who, where = np.diff(np.append(cut, len(bucket))).astype(np.int32), owner[cut], bucket[cut]
    out, ends = [], np.append(cut, len(bucket))
    for b in np.unique(where).tolist():
        x, y = np.searchsorted(where, b), np.searchsorted(where, b, "right")
        part = slice(ends[x], ends[y])
        out.append([b, nodes[who[x:y]].tobytes(), sizes[who[x:y]].astype(np.int32).tobytes(), count[x:y].tobytes(), tokens[part].tobytes(), held[part].tobytes()])
    return out


def _batch(found: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)


def _undealt(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(nodes, sizes, counts, tokens, held) of rows of RUNS, one after the other."""
    kinds = (np.int64, np.int32, np.int32, np.uint64, np.uint8)
    return tuple(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]] or [np.empty(0, kind)]) for name, kind in zip(_RUNS.names[1:], kinds, strict=True))


def classes(count: np.ndarray) -> np.ndarray:
    return np.minimum(TOP - 1, 8 * np.log2(count)).astype(np.uint8)


def shared_tokens(docs: DataFrame, frequent, copied, buckets: int, homes: int) -> DataFrame:
    """(node, n, tokens, held) of the sets that can link: their tokens that other sets hold too, in order of class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, (many, part, line) = frequent.value, copied.value
        for batch in batches:
            parts, lines = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j, values, at in _sets(batch.column(0)):
                node = set_numbers(values, at)
                ok = node != 0
                if len(many):
                    k = np.minimum(np.searchsorted(many, node), len(many) - 1)
                    ok &= (many[k] != node) | ((part[k] == parts[i:j]) & (line[k] == lines[i:j]))
                own = np.flatnonzero(ok)
                own = own[np.unique(node[own], return_index=True)[1]]
                if not len(own):
                    continue
                tokens, n = _of(values, at, own)
                owner, mine = np.repeat(np.arange(len(own)), n), node[own]
                hot = np.zeros(len(tokens), bool)
                if len(often):
                    hot = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] == tokens
                cold, none = ~hot, np.zeros(len(own), np.int32)
                bucket = (mix(tokens[cold]) % _U(buckets)).astype(np.int32)
                yield _batch(_dealt(bucket, owner[cold], mine, none, tokens[cold], None), _RUNS)
                home = (buckets + mix(mine.view(np.uint64)) % _U(homes)).astype(np.int32)
                # A set's size travels with its frequent tokens; a set without one has an entry that is no token.
                lone = np.flatnonzero(np.bincount(owner[hot], minlength=len(own)) == 0)
                who = np.concatenate((owner[hot], lone))
                yield _batch(_dealt(home[who], who, mine, n, np.concatenate((tokens[hot], np.zeros(len(lone), np.uint64))), np.concatenate((np.full(int(hot.sum()), TOP, np.uint8), np.zeros(len(lone), np.uint8)))), _RUNS)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return table
        nodes, _, counts, tokens, _ = _undealt(table)
        owner = np.repeat(np.arange(len(nodes)), counts)
        order = np.argsort(tokens)
        tokens = tokens[order]
        same = tokens[1:] == tokens[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(tokens) else np.empty(0, bool)
        tokens, node = tokens[several], nodes[owner[order[several]]]
        order = np.lexsort((node, tokens))
        tokens, node = tokens[order], node[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (node[1:] != node[:-1])  # copies in several blocks are one
        tokens, node = tokens[new], node[new]
        cut = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        held = np.diff(np.append(cut, len(tokens)))
        each = np.repeat(held, held)
        tokens, node, each = tokens[each > 1], node[each > 1], each[each > 1]
        who, owner = np.unique(node, return_inverse=True)
        home = (buckets + mix(who.view(np.uint64)) % _U(homes)).astype(np.int32)
        return pa.Table.from_batches([_batch(_dealt(home[owner], owner, who, np.zeros(len(who), np.int32), tokens, classes(each)), _RUNS)])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        nodes, sizes, counts, tokens, held = _undealt(table)
        who, own = np.unique(nodes, return_inverse=True)
        n = np.zeros(len(who), np.int64)
        np.maximum.at(n, own, sizes)
        owner = np.repeat(own, counts)[tokens != 0]
        held, tokens = held[tokens != 0], tokens[tokens != 0]
        able = 4 * np.bincount(owner, minlength=len(who)) >= 3 * n  # too many otherwise, as copies repeat here
        keep = able[owner]
        owner, held, tokens = owner[keep], held[keep], tokens[keep]
        order = np.lexsort((tokens, held, owner))
        owner, held, tokens = owner[order], held[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        owner, held, tokens = owner[new], held[new], tokens[new]
        have = np.bincount(owner, minlength=len(who))
        some = np.flatnonzero((have > 0) & (4 * have >= 3 * n))
        keep = np.isin(owner, some)
        held, tokens, at = held[keep], tokens[keep], np.concatenate(([0], np.cumsum(have[some])))
        raw = held.tobytes()
        return pa.table({"node": pa.array(who[some], pa.int64()), "n": pa.array(n[some], pa.int64()), "tokens": lists(tokens.view(np.int64), at, pa.int64()), "held": pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    sent = docs.select("text", "part", "line").mapInArrow(released(deal), RUNS)
    back = sent.groupBy("bucket").applyInArrow(count, RUNS)
    return back.groupBy("bucket").applyInArrow(gather, "node long, n long, tokens array<long>, held binary")


# --- verification ---------------------------------------------------------------------------------------


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; sets hold all tokens that two sets can share, and their true sizes."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    shared = F.size(F.array_intersect("ta", "tb"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", shared.alias("shared"), "na", "nb")
    return both.filter(100 * F.col("shared") >= 75 * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


# --- steps 2 and 3: posting lists of prefixes -----------------------------------------------------------------

#: Prefixes of a run of sets in one bucket: an entry per token, and per set what the tests need.
PACKED = "bucket int, tokens binary, place binary, member binary, node binary, comp binary, size binary, have binary, last binary, central binary, bits binary"
_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "place", "member", "node", "comp", "size", "have", "last", "central", "bits"))])
_KINDS = {"tokens": np.uint64, "place": np.int32, "member": np.int32, "node": np.int64, "comp": np.int64, "size": np.int32, "have": np.int32, "last": np.uint64, "central": np.float32, "bits": np.uint64}


def ordered(tokens: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Ranks of tokens in global order k: by class, then by a hash."""
    return (mix(tokens ^ _seed(100 + k)) >> _U(8)) | (held.astype(np.uint64) << _U(56))


def bitmaps(tokens: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """WORD_BITS words a set, in which each token turns one bit: sets differ in as many tokens as bits, at least."""
    out = np.zeros(sets * WORD_BITS, np.uint64)
    h = mix(tokens ^ _seed(70))
    at = owner * WORD_BITS + (h % _U(WORD_BITS)).astype(np.int64)
    np.bitwise_xor.at(out, at, _U(1) << ((h >> _U(32)) & _U(63)))
    return out.reshape(sets, WORD_BITS)


def packed(tokens: np.ndarray, held: np.ndarray, at: np.ndarray, node: np.ndarray, comp: np.ndarray, size: np.ndarray, buckets: int) -> list[list]:
    """Rows of PACKED of some sets. Tokens of no other set stand before all others in every order."""
    have = np.diff(at)
    owner = np.repeat(np.arange(len(have)), have)
    bits = bitmaps(tokens, owner, len(have))
    central = (np.bincount(owner, held, len(have)) / np.maximum(size, 1)).astype(np.float32)
    p = prefix_size(size) - (size - have)  # of the tokens at hand; 1 at least, as 4 have >= 3 size
    rows = []
    for k in range(ORDERS):
        key = ordered(tokens, held, k)
        order = np.lexsort((key, owner))
        key = key[order]
        place = np.arange(len(key)) - np.repeat(at[:-1], have)
        last = key[at[:-1] + p - 1]
        inside = place < np.repeat(p, have)
        key, place, member = key[inside], place[inside], owner[inside]
        bucket = (mix(key) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, place, member, bucket = key[order], place[order], member[order], bucket[order]
        for b in np.unique(bucket).tolist():
            part = slice(np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right"))
            who, local = np.unique(member[part], return_inverse=True)
            columns = {"tokens": key[part], "place": place[part], "member": local, "node": node[who], "comp": comp[who], "size": size[who], "have": have[who], "last": last[who], "central": central[who], "bits": bits[who]}
            rows.append([k * buckets + b, *(np.ascontiguousarray(columns[c], _KINDS[c]).tobytes() for c in _PACKED.names[1:])])
    return rows


def _prefixes(sets: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of sets (node, n, tokens, held, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at, values = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values).view(np.uint64)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + 300_000, "right")) - 1)
                held = np.frombuffer(b"".join(batch.column(3).slice(i, j - i).to_pylist()), np.uint8)
                rows = packed(values[at[i] : at[j]], held, at[i : j + 1] - at[i], batch.column(0).to_numpy()[i:j], batch.column(4).to_numpy()[i:j], batch.column(1).to_numpy()[i:j], buckets)
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64], _PACKED)
                i = j

    return sets.select("node", "n", "tokens", "held", "comp").mapInArrow(released(run), PACKED)


class Lists:
    """The posting lists of one bucket and order: entries sorted by token, then by what a step needs."""

    def __init__(self, e: dict[str, np.ndarray]):
        member = e.pop("member")
        self.key, self.place = e.pop("tokens"), e.pop("place")
        self.member, self.set = member, e

    def sort(self, *by: np.ndarray) -> np.ndarray:
        """Sort by token and then by values of sets; returns where the lists begin, and the end."""
        order = np.lexsort((*[x[self.member] for x in reversed(by)], self.key))
        self.key, self.place, self.member = self.key[order], self.place[order], self.member[order]
        return np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1], [True])))

    def tested(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a, b, needed) of those pairs of entries that still can link."""
        x, y, comp, size, have = self.member[i], self.member[j], self.set["comp"], self.set["size"].astype(np.int64), self.set["have"].astype(np.int64)
        ok = comp[x] != comp[y]
        i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        a, b, ha, hb, pa_, pb = size[x], size[y], have[x], have[y], self.place[i], self.place[j]
        least = needed(a, b)
        ok = (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (np.minimum(pa_, pb) + np.minimum(ha - pa_, hb - pb) >= least)
        x, y, a, b, least = x[ok], y[ok], a[ok], b[ok], least[ok]
        if len(x):
            bits = self.set["bits"]
            differ = np.zeros(len(x), np.int64)
            for w in range(WORD_BITS):
                differ += np.bitwise_count(bits[x, w] ^ bits[y, w])
            ok = have[x] + have[y] - differ >= 2 * least
            x, y, a, b, least = x[ok], y[ok], a[ok], b[ok], least[ok]
        # The prefix that ends first holds all shared tokens up to its end; the rest of its set can hold but so many more.
        last, node = self.set["last"], self.set["node"]
        rest = np.where(last[x] <= last[y], a - prefix_size(a), b - prefix_size(b))
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.maximum(1, least - rest)

    def stars(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each entry with the most central one of its list and size band, and with its next in centrality; for two cuts of the bands."""
        for shift in (0.0, 0.5):
            band = np.floor(np.log(np.maximum(self.set["size"], 1)) / np.log(4 / 3) + shift)
            self.sort(band, -self.set["central"], self.set["node"])
            b = band[self.member]
            first = np.flatnonzero(np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (b[1:] != b[:-1]))))
            size = np.diff(np.append(first, len(b)))
            hub, at = np.repeat(first, size), np.arange(len(b))
            yield hub[at > hub], at[at > hub]
            near = at[at > hub + 1]
            yield near - 1, near

    def apart(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of entries of a list, but those within the component that has most of its entries; in parts of bounded size."""
        ends = self.sort(self.set["comp"])
        comp = self.set["comp"][self.member]
        run = np.flatnonzero(np.concatenate(([True], (self.key[1:] != self.key[:-1]) | (comp[1:] != comp[:-1])))) if len(comp) else np.empty(0, np.int64)
        size = np.diff(np.append(run, len(comp)))
        lists_ = np.searchsorted(ends, run, "right") - 1
        most = np.zeros(len(ends) - 1, np.int64)
        np.maximum.at(most, lists_, size)
        # a list's largest component goes to its end
        large = size == most[lists_]
        pick = np.full(len(ends) - 1, -1)
        pick[lists_[large]] = np.flatnonzero(large)
        turn = np.argsort(lists_ * 2 + (np.arange(len(run)) == pick[lists_]), kind="stable")
        order = ranges(run[turn], size[turn])
        self.key, self.place, self.member = self.key[order], self.place[order], self.member[order]
        width = np.diff(ends)
        first = ranges(ends[:-1], width - most)
        count = np.repeat(ends[1:], width - most) - first - 1
        begun = np.concatenate(([0], np.cumsum(count)))
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(begun, begun[at] + 2_000_000, "right")) - 1)
            yield np.repeat(first[at:stop], count[at:stop]), ranges(first[at:stop] + 1, count[at:stop])
            at = stop


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, times, needed) of distinct pairs."""
    a, b, c, need = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, c, need = a[order], b[order], c[order], need[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(c, first) if len(first) else c[:0], need[first]


def met(e: dict[str, np.ndarray], stars: bool) -> tuple[np.ndarray, ...]:
    """(a, b, shared prefix tokens, needed) of the pairs that meet in one bucket."""
    own = Lists(e)
    parts, held = [tuple(np.empty(0, np.int64) for _ in range(4))], 0
    for i, j in own.stars() if stars else own.apart():
        a, b, need = own.tested(i, j)
        if len(a):
            parts.append(_counted([(a, b, np.ones(len(a), np.int64), need)]))
            held += len(parts[-1][0])
        if held > 4_000_000:
            parts = [_counted(parts)]
            held = 0
    return _counted(parts)


PAIRS = "a long, b long, k int, c long, need long"


def _pairs(prefixes: DataFrame, buckets: int, stars: bool) -> DataFrame:
    """Pairs (PAIRS) that meet in the buckets."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        e: dict[str, list] = {c: [] for c in _KINDS}
        sets = 0
        for row in table.to_batches():
            for r in range(row.num_rows):
                for i, c in enumerate(_PACKED.names[1:], 1):
                    e[c].append(np.frombuffer(row.column(i)[r].as_buffer(), _KINDS[c]))
                e["member"][-1] = e["member"][-1] + sets
                sets += len(e["node"][-1])
        flat = {c: np.concatenate(x) for c, x in e.items()}
        flat["bits"] = flat["bits"].reshape(-1, WORD_BITS)
        a, b, c, need = met(flat, stars)
        return pa.table({"a": a, "b": b, "k": pa.array(np.full(len(a), key[0].as_py() // buckets), pa.int32()), "c": c, "need": need})

    return prefixes.groupBy("bucket").applyInArrow(run, PAIRS)


def _candidates(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that reach the needed count of shared prefix tokens under every order."""
    per = lambda k: (F.sum(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}"), F.max(F.when(F.col("k") == k, F.col("need"))).alias(f"need{k}"))
    both = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), *[x for k in range(ORDERS) for x in per(k)])
    for k in range(ORDERS):
        both = both.filter(F.col(f"c{k}") >= F.col(f"need{k}"))
    return both.select("a", "b", "c")


# --- step 4: verification in rounds ---------------------------------------------------------------------


def _linked(candidates: DataFrame, sets: DataFrame, labels: DataFrame, held: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Labels completed by the candidates: verified in rounds, the pairs that share most first, and none within a component."""
    most = 1
    while True:
        side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
        own = lambda x: F.coalesce(F.col(f"label_{x}"), F.col(x))
        candidates = held(candidates.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(own("a") != own("b")).select("a", "b", "c"), "open-pairs")
        if not candidates.limit(1).count():
            return labels
        # A hot set has many partners; the window of one end is bounded by a WindowGroupLimit below the exchange.
        first = lambda x, y: candidates.withColumn("r", F.row_number().over(Window.partitionBy(x).orderBy(F.col("c").desc(), y))).filter(F.col("r") <= most).select("a", "b")
        now = held(first("a", "b").unionByName(first("b", "a")).distinct(), "round")
        labels = extended(labels, held(_links(now, sets), "links"))
        candidates = candidates.join(now, ["a", "b"], "left_anti")
        most *= 8


# --- the join ---------------------------------------------------------------------------------------------


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, part, line, n_shingles, component_id, component) per row of docs (doc_id, text, and part and line, which name the row); component is null for an empty set."""
    spark = docs.sparkSession
    trash: list[str] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        trash.append(path)
        return df

    nodes, _ = stored(number_documents(docs), "nodes")
    rows, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets, homes = max(8, -(-total // BUCKET)), max(4, -(-total // (4 * BUCKET)))
    send = spark.sparkContext.broadcast
    sets = held(shared_tokens(docs, send(_frequent(nodes, rows)), send(_copied(nodes)), buckets, homes), "sets")
    entries = sets.agg(F.sum(F.size("tokens") - F.ceil(F.col("n") * 0.75) + 1)).first()[0] or 0
    lists_ = max(1, -(-entries // LIST_BUCKET))
    meet = lambda labels, stars: _pairs(_prefixes(sets.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")), lists_), lists_, stars)
    labels = spark.createDataFrame([], "node long, label long")
    labels = components(held(_links(held(meet(labels, True).select("a", "b").distinct(), "star-pairs"), sets), "links"))
    candidates = held(_candidates(meet(labels, False)), "candidates")
    labels = _linked(candidates, sets, labels, held)
    first = nodes.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("low"))
    own = first.join(labels, "node", "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("low").alias("component_id"))
    table, _ = stored(own.join(least, "label").select("node", F.col("label").alias("component"), "component_id"), "node-components")
    discard(spark, *trash)
    out = nodes.join(table, "node", "left")
    return out.select("doc_id", "part", "line", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text)."""
    return near_rows(named_rows(docs)).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that aren't the first of their component: that of the smallest doc_id (null last), of one id the one that is read first. Rows without words stay."""
    own, part, line = keyed(docs)
    with scope(docs.sparkSession):
        rows, _ = stored(near_rows(own.select("doc_id", "text", F.col(part).alias("part"), F.col(line).alias("line"))).filter(F.col("component").isNotNull()).select("component", "doc_id", "part", "line"), "grouped")
        rank = F.struct(F.col("doc_id").isNull().alias("open"), "doc_id", "part", "line")
        first = rows.groupBy("component").agg(F.min(rank).alias("x")).select(F.col("x.part").alias("part"), F.col("x.line").alias("line"))
        drop, _ = kept(rows.join(first, ["part", "line"], "left_anti").select(F.col("part").alias(part), F.col("line").alias(line)), "near-copies")
    return join_measured(own, drop, [part, line], "left_anti", drop.count()).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')) END) AS tokens FROM w
), t AS (
  SELECT r, unnest(tokens) AS token FROM s
), met AS (
  SELECT a.r AS a, b.r AS b, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.r < b.r GROUP BY a.r, b.r
), links AS (
  SELECT a, b FROM met JOIN s x ON a = x.r JOIN s y ON b = y.r WHERE 100 * shared >= 75 * (len(x.tokens) + len(y.tokens) - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT r, r AS o FROM s UNION SELECT reach.r, b FROM reach JOIN edges ON o = a
)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.tokens))::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.r JOIN s y ON y.r = o GROUP BY s.r
"""


def brute_force(docs: list[tuple]) -> dict:
    """The same by plain Python, for tests: {doc_id: (n_shingles, component_id)}."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, text in docs:
        w = word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1) if w else 0)}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        shared: dict = {}
        for x in s:
            for o in holders[x]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, i in shared.items():
            if 100 * i >= 75 * (len(s) + len(sets[o]) - i):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
