"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model with absolute discounting in backoff form. Every word has a unigram
weight. Bigrams and trigrams seen at least ``min_count`` times are arcs, histories are states, and
a failure arc with the weight left over by discounting leads from each state to the next shorter
history. Weights sum to one in every state. No word is left out of histories: a word that is seen
less often than ``min_count`` cannot be in an n-gram that is kept.

Counts come from all training documents. No machine holds the whole model: each task cuts its
documents into blocks of bounded size and stores every block once, as places in the block's own
word list. From then on only arrays travel. Words, then bigrams, then those trigrams whose two
bigrams are kept go to buckets dealt by a hash of the whole n-gram, are added up and numbered
there, and answers come back in the order in which the block had sent its own, so they need no
keys. Sums over the n-grams of a history are added up where the history is counted. At last each
block weighs its part of the automaton and scores its documents in one traversal.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import SPACES, let_go, partitions, release_memory, stored
from weekloom.llm.wordarrays import SPACE, WordArrays

START, END, FIRST_WORD = 1, 2, 3  # 0 stands for no third word
BITS = 31
MASK = (1 << BITS) - 1
BUCKET_BYTES = 32 << 20  # text whose n-grams of one length one task counts at a time; blocks times buckets are the arrays sent

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[list(SPACES)] = SPACE


@dataclass(frozen=True)
class LmSettings:
    min_share: float = 0.0  # words with a smaller share of all training tokens make no histories; 0: all words do
    min_count: int = 2
    discount: float = 0.75
    block_bytes: int = 8 << 20


def crc_share(id_col: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


#: What blocks and buckets send each other: kind, bucket, block and up to three packed arrays.
#: ``word`` (to a bucket: the words' lengths, their bytes, training counts; back: numbers, totals), ``two`` and ``three``
#: (to a bucket: n-grams with counts; back: totals, and of kept bigrams their ranks), ``word_used`` and ``two_used`` (to the
#: bucket of a history: ranks, total and number of its kept n-grams; back: the same two in a block's order),
#: ``start_used`` (the same of START, for all blocks).
ARRAYS = "kind string, bucket long, block long, a binary, b binary, c binary"
NAMES = ("kind", "bucket", "block", "a", "b", "c")
#: A block's row of kind ``texts``: training tokens; words of the tokens, buckets of the words, twice the tokens of each text
#: and 1 if it is held out; the rows' ids and marks.
BLOCK_NAMES = ("tokens", "codes", "dealt", "sizes", "ids", "held")


def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _planes(x: np.ndarray) -> bytes:
    """How many bytes a number needs, then these bytes, first all lowest ones: equal bytes stand together."""
    width = x.itemsize if not len(x) or x.min() < 0 else max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(kind).ravel()


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = 12 + np.cumsum(np.frombuffer(data, np.int32, 3))
    heads, last, c = (data[i:j] for i, j in zip((12, *ends), ends, strict=False))
    return np.cumsum(_numbers(heads, np.int64)), _numbers(last, np.int32).astype(np.int64), _numbers(c, np.int32)


def pack_grams(ab: np.ndarray, third: np.ndarray, c: np.ndarray) -> bytes:
    parts = _planes(np.diff(ab, prepend=0)), _planes(third.astype(np.int32)), _planes(c.astype(np.int32))
    return np.array([len(x) for x in parts], np.int32).tobytes() + b"".join(parts)


def bucket_of(ab: np.ndarray, third: np.ndarray, buckets: int) -> np.ndarray:
    h = ab.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + third.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _packed_rows(rows: list[tuple], pack) -> pa.Table:
    """Rows of ARRAYS; arrays of numbers are packed, bytes are taken as they are."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    rows = [(*r, None, None, None)[: len(NAMES)] for r in rows]
    columns = [[r[i] for r in rows] for i in range(len(NAMES))]
    flat = lambda x: _planes(x) if isinstance(x, np.ndarray) else x
    columns[3:] = [[None if x is None else pack(flat(x)) for x in c] for c in columns[3:]]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(NAMES, columns, kinds, strict=True)})


def _rows(table: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(table.column(n).to_pylist() for n in names), strict=True))


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and where each bucket begins in it (and the last one ends)."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def gram_counts(texts: list[np.ndarray], training: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First two words in one number, third word or 0, and training count of all bigrams and trigrams of the texts.

    Texts are numbers between START and END, -1 for words without histories.
    """
    s = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    inner = np.ones(len(s), bool)
    inner[start] = False
    before, words, counts = s[:-1][inner[1:]], s[inner], np.repeat(training, sizes - 1)
    two = Grams.of_words(before, words, counts)
    ab = (two.heads << BITS) | two.last
    three = two.longer(ab, np.ones(len(ab), bool), words, start - np.arange(len(texts)), counts)
    third = np.concatenate([np.zeros(len(ab), np.int64), three.last])
    return np.concatenate([ab, three.heads]), third, np.concatenate([two.n, three.n])


class Grams:
    """Distinct n-grams of one length in a block: a number for all but the last word (``heads``), ``last``, training count ``n``.

    ``place``: of each token, that of the n-gram that ends there, -1 if it has none; ``token``: one where each ends.
    """

    def __init__(self, heads: np.ndarray, last: np.ndarray, ok: np.ndarray, training: np.ndarray):
        at = np.flatnonzero(ok)
        keys, place = _distinct(heads[at], last[at])
        self.place = np.full(len(ok), -1)
        self.place[at] = place
        self.token = np.empty(len(keys), np.int64)
        self.token[place] = at
        self.heads, self.last = heads[self.token], last[self.token]
        self.n = np.bincount(place, weights=training[at], minlength=len(keys)).astype(np.int64)

    @classmethod
    def of_words(cls, before: np.ndarray, words: np.ndarray, training: np.ndarray) -> Grams:
        return cls(before, words, (before >= 0) & (words >= 0), training)

    def longer(self, numbers: np.ndarray, kept: np.ndarray, words: np.ndarray, first: np.ndarray, training: np.ndarray) -> Grams:
        """Of bigrams: the trigrams whose two bigrams are kept; heads are the numbers of their first ones."""
        ok = np.append(kept, False)[self.place]
        before = np.concatenate(([-1], self.place[:-1]))
        both = ok & np.concatenate(([False], ok[:-1]))
        both[first] = False
        heads = np.append(numbers, -1)[before]
        return Grams(heads, words, both, training)

    def buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Order in which a block sends its n-grams, and where the buckets begin in it."""
        return by_bucket(bucket_of(self.heads, self.last, buckets), buckets)

    def messages(self, kind: str, block: int, buckets: int) -> list[tuple]:
        order, starts = self.buckets(buckets)
        return [
            (kind, b, block, pack_grams(self.heads[own], self.last[own], self.n[own]))
            for b, own in ((b, order[starts[b] : starts[b + 1]]) for b in range(buckets))
            if len(own)
        ]


def _distinct(heads: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, as one number if they fit, and the place of each pair among them."""
    if len(heads) and heads.max() > MASK:
        heads = np.unique(heads, return_inverse=True)[1]
    return np.unique((heads << BITS) | last, return_inverse=True)


def _chunks(batches, held_bytes: int):
    """Tables of about ``held_bytes`` of text each, out of record batches with a column ``text``."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = done = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, int(np.searchsorted(ends, done + held_bytes - size)) + 1)
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - done
            lo, done = hi, int(ends[hi - 1])
            if size >= held_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _block_maker(block_bytes: int, buckets: int):
    """Documents to blocks: a row with the texts as places in the block's words, and the words themselves, dealt to buckets.

    Words go by falling frequency in the block; END, the word without letters, is one of them and ends each text.
    """

    def run(batches):
        pack, _ = _codec()
        for i, docs in enumerate(_chunks(batches, block_bytes)):
            yield from block_rows((TaskContext.get().partitionId() << 32) + i, docs, pack)
            del docs
            release_memory()

    def block_rows(block: int, docs: pa.Table, pack):
        held = docs.column("held_out").to_pylist()
        words = WordArrays(docs.column("text").cast(pa.large_binary()).to_pylist(), _BYTES, None)
        sizes = words.size + 1
        x = np.full(int(sizes.sum()), len(words.dictionary))
        x[np.arange(len(words.ids)) + words.text] = words.ids
        often = np.argsort(-np.bincount(x, minlength=len(words.dictionary) + 1), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        codes = rank[x]
        training = np.repeat([not h for h in held], sizes)
        counts = np.bincount(codes, weights=training, minlength=len(often)).astype(np.int64)
        names = pa.concat_arrays([words.dictionary, pa.array([b""], pa.binary())])
        dealt = (np.fromiter(map(zlib.crc32, names.to_pylist()), np.int64, len(names)) % buckets)[often]
        order, starts = by_bucket(dealt, buckets)
        offsets, data = _bytes_of(names.take(pa.array(often[order])))
        lengths, sent = np.diff(offsets).astype(np.int32), counts[order]
        rows = []
        for b in range(buckets):
            lo, hi = starts[b], starts[b + 1]
            if lo < hi:
                rows.append(("word", b, block, lengths[lo:hi], data[offsets[lo] : offsets[hi]], sent[lo:hi]))
        table = _packed_rows(rows, pack)
        tokens = pa.array([int(training.sum())], pa.int64())
        marked = 2 * sizes + np.array([bool(h) for h in held])
        own = [pa.array([pack(_planes(v.astype(np.int32)))], pa.binary()) for v in (codes, dealt, marked)]
        ends = pa.array([0, docs.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, docs.column(c).combine_chunks()) for c in ("doc_id", "held_out")]
        extra = dict(zip(BLOCK_NAMES, [tokens, *own, *lists], strict=True))
        first = pa.table({"kind": pa.array(["texts"]), "block": pa.array([block], pa.int64()), **extra})
        return pa.concat_tables([first, table], promote_options="default").select([*NAMES, *BLOCK_NAMES]).to_batches()

    return run


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of an array of binaries that is not a slice."""
    _, offsets, data = words.buffers()
    return np.frombuffer(offsets, np.int32)[: len(words) + 1].astype(np.int64), memoryview(data or b"")


def _word_adder(least: float, buckets: int):
    """All words of one bucket: numbers and totals to each block, and how many words there are in training.

    A number is the word's rank by falling count, dealt between the buckets; -1 for words seen less than ``least`` times.
    """

    def add(table: pa.Table) -> pa.Table:
        pack, unpack = _codec()
        bucket = table.column("bucket")[0].as_py()
        blocks, lengths, data, n = zip(*_rows(table, "block", "a", "b", "c"), strict=True)
        lengths = [_numbers(unpack(x), np.int32) for x in lengths]
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64)))
        n = np.concatenate([_numbers(unpack(x), np.int64) for x in n])
        data = b"".join(map(unpack, data))
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        place, size = coded.indices.to_numpy(), len(coded.dictionary)
        total = np.bincount(place, weights=n, minlength=size).astype(np.int64)
        is_end = pc.binary_length(coded.dictionary).to_numpy() == 0
        often = np.flatnonzero((total >= least) & ~is_end)
        often = often[np.argsort(-total[often], kind="stable")]
        number = np.full(size, -1)
        number[often] = FIRST_WORD + np.arange(len(often)) * buckets + bucket
        number[is_end] = END
        if size and number.max() > MASK:
            raise ValueError("too many words to number")
        at = np.concatenate(([0], np.cumsum([len(x) for x in lengths])))
        rows = [
            ("word", bucket, block, number[place[lo:hi]].astype(np.int32), total[place[lo:hi]])
            for block, lo, hi in zip(blocks, at, at[1:], strict=False)
        ]
        found = np.array([np.count_nonzero(total), total[is_end].sum()], np.int64)
        table = _packed_rows([*rows, ("types", bucket, None)], pack)
        none = [None] * len(rows)
        return table.append_column("types", pa.array([*none, found[0]], pa.int64())).append_column("ends", pa.array([*none, found[1]], pa.int64()))

    return add


def _sums(kind: str, heads: np.ndarray, first: int, total: np.ndarray, buckets: int) -> list[tuple]:
    """What histories have used, dealt to the buckets that have numbered them: ranks, totals, numbers of n-grams."""
    heads, place = np.unique(heads, return_inverse=True)
    n, types = (np.bincount(place, weights=w, minlength=len(heads)).astype(np.int64) for w in (total, None))
    order, starts = by_bucket((heads - first) % buckets, buckets)
    return [
        (kind, b, None, np.diff((heads[own] - first) // buckets, prepend=0), n[own], types[own])
        for b, own in ((b, order[starts[b] : starts[b + 1]]) for b in range(buckets))
        if len(own)
    ]


def _gram_adder(kind: str, min_count: int, buckets: int):
    """All n-grams of one bucket: totals to each block (0: not kept), and what their histories have used.

    Kept bigrams are numbered like words, and each block learns the ranks of its own.
    """

    def add(table: pa.Table) -> pa.Table:
        pack, unpack = _codec()
        bucket = table.column("bucket")[0].as_py()
        blocks, data = zip(*_rows(table, "block", "a"), strict=True)
        found = [unpack_grams(unpack(x)) for x in data]
        at = np.concatenate(([0], np.cumsum([len(x[0]) for x in found])))
        heads, last, n = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, place = np.unique((heads << BITS) | last, return_inverse=True)
        total = np.bincount(place, weights=n).astype(np.int64)
        kept = total >= max(1, min_count)
        total[~kept] = 0
        rank = np.where(kept, np.cumsum(kept) - 1, -1)
        if kept.sum() * buckets > MASK and kind == "two":
            raise ValueError("too many bigrams to number")
        rows = []
        for block, lo, hi in zip(blocks, at, at[1:], strict=False):
            mine = rank[place[lo:hi]]
            rows.append((kind, bucket, block, total[place[lo:hi]], *([np.diff(mine[mine >= 0], prepend=0)] if kind == "two" else [])))
        heads, total = keys[kept] >> BITS, total[kept]
        if kind == "three":
            return _packed_rows(rows + _sums("two_used", heads, 0, total, buckets), pack)
        start = heads == START
        rows += _sums("word_used", heads[~start], FIRST_WORD, total[~start], buckets)
        table = _packed_rows([*rows, ("start_used", bucket, None)], pack)
        used = [None] * len(rows)
        return table.append_column("used", pa.array([*used, total[start].sum()], pa.int64())).append_column(
            "types", pa.array([*used, start.sum()], pa.int64())
        )

    return add


def _history_adder(buckets: int):
    """Histories of one kind and bucket: to each block, in the order of its own, what they have used."""

    def add(table: pa.Table) -> pa.Table:
        pack, unpack = _codec()
        read = lambda x, kind=np.int64: _numbers(unpack(x), kind)
        rows = _rows(table, "kind", "bucket", "block", "a", "b", "c")
        asked = []
        for kind, bucket, block, a, b, _ in rows:
            if kind == "two":
                asked.append(("two_used", bucket, block, np.cumsum(read(b))))
            elif kind == "word":
                number = read(a, np.int32).astype(np.int64)
                asked.append(("word_used", bucket, block, np.where(number >= FIRST_WORD, (number - FIRST_WORD) // buckets, -1)))
        sums = [(np.cumsum(read(a)), read(b), read(c)) for kind, _, _, a, b, c in rows if kind.endswith("_used")]
        at, n, types = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in sums)]) for i in range(3))
        size = 1 + max((int(x.max()) for x in (at, *(r[3] for r in asked)) if len(x)), default=-1)
        # The last place is for words without histories.
        n, types = (np.append(np.bincount(at, weights=w, minlength=size), 0).astype(np.int64) for w in (n, types))
        return _packed_rows([(kind, bucket, block, n[own], types[own]) for kind, bucket, block, own in asked], pack)

    return add


class Block:
    """A block's texts and what the buckets have answered.

    ``codes``: the block's words at each token; ``x``: their numbers; ``first``: where a text begins.
    """

    def __init__(self, rows: pa.Table, buckets: int):
        _, self.unpack = _codec()
        self.buckets, self.block = buckets, rows.column("block")[0].as_py()
        texts = rows.filter(pc.is_valid(rows.column("codes")))
        self.codes, self.dealt, sizes = (_numbers(self.unpack(texts.column(c)[0].as_py()), np.int32) for c in ("codes", "dealt", "sizes"))
        self.sizes, held = sizes >> 1, sizes & 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(1 - held, self.sizes)
        self.rows = sorted(_rows(rows, "kind", "bucket", "a", "b"), key=lambda r: r[1] or 0)
        self.order = by_bucket(self.dealt, buckets)[0]
        self.number = self.of_words("word", 2, np.int32).astype(np.int64)
        self.x = self.number[self.codes]
        before = np.concatenate(([START], self.x[:-1]))
        before[self.first] = START
        self.two = Grams.of_words(before, self.x, self.training)

    def answers(self, kind: str, column: int, width=np.int64) -> np.ndarray:
        """Array of all answers of a kind, bucket by bucket."""
        found = [_numbers(self.unpack(r[column]), width) for r in self.rows if r[0] == kind]
        return np.concatenate(found) if found else np.zeros(0, width)

    def of_words(self, kind: str, column: int, width=np.int64) -> np.ndarray:
        out = np.empty(len(self.dealt), width)
        out[self.order] = self.answers(kind, column, width)
        return out

    def find_bigrams(self) -> np.ndarray:
        """Sets ``total2`` and finds the trigrams that can be kept; the kept bigrams in the order in which they were sent."""
        order, _ = self.two.buckets(self.buckets)
        self.total2 = np.zeros(len(order), np.int64)
        self.total2[order] = self.answers("two", 2)
        kept = order[self.total2[order] > 0]
        number = np.full(len(order), -1)
        ranks = [(np.cumsum(_numbers(self.unpack(r[3]), np.int64)), r[1]) for r in self.rows if r[0] == "two"]
        number[kept] = np.concatenate([r * self.buckets + b for r, b in ranks]) if ranks else 0
        self.three = self.two.longer(number, self.total2 > 0, self.x, self.first, self.training)
        return kept


def _bigram_sender(buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        own = Block(rows, buckets)
        return _sent(own.two.messages("two", own.block, buckets))

    return send


def _trigram_sender(buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        own = Block(rows, buckets)
        own.find_bigrams()
        return _sent(own.three.messages("three", own.block, buckets))

    return send


def _sent(rows: list[tuple]) -> pa.Table:
    out = _packed_rows(rows, _codec()[0])
    release_memory()
    return out


class Automaton:
    """States: 0 the root, then one per word of the block and START, then one per bigram history."""

    def __init__(self, counts, used, base, two, three, discount: float):
        """``counts``, ``used``, ``base``: of each word as a history (NaN: no arcs leave) and its unigram weight, START last.

        ``two``: (first word, second, count, used or NaN); ``three``: (place of the first bigram, of the second, count).
        """
        a, b, n, spent = two
        k = len(counts)
        left = np.where(np.isnan(used), 1.0, 1 - used / np.maximum(counts, 1))
        p2 = (n - discount) / counts[a] + left[a] * base[b]
        history = ~np.isnan(spent)
        left2 = np.where(history, 1 - spent / n, 1.0)
        up, onward, m = three
        p3 = (m - discount) / n[up] + left2[up] * p2[onward]
        self.weights = np.log10(p2), np.log10(p3)
        self.state = np.where(history, k + np.cumsum(history), b + 1)
        self.fail = np.concatenate([[0.0], np.log10(left), np.log10(left2[history])])
        self.down = np.concatenate([np.zeros(k + 1, np.int64), b[history] + 1])
        self.fall = np.where(np.arange(len(self.fail)) > k, self.fail + self.fail[self.down], self.fail)
        self.width = k

    def walk(self, x: np.ndarray, first: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """log10 weight of each token on the walks of some texts, one after the other.

        ``x``: words of the tokens, -1 for those without histories; ``first``: where a text begins; ``one``: unigram weights;
        ``two``, ``three``: arcs that end at each token, -1 for none.
        The state behind a word is the longest history that is kept, whatever arcs led to it, so all walks are followed
        at once: from each state an arc, or the failure arc to the next shorter history and on from there.
        """
        after = np.where(two >= 0, np.append(self.state, 0)[two], x + 1)
        state = np.concatenate(([0], after[:-1]))
        state[first] = self.width  # START is the last word
        out = np.where(x < 0, self.fall[state], 0.0) + one
        arc = three >= 0
        out[arc] = self.weights[1][three[arc]]
        rest = np.flatnonzero((x >= 0) & ~arc)
        at = state[rest]
        longer = at > self.width
        out[rest[longer]] += self.fail[at[longer]]
        at = np.where(longer, self.down[at], at)
        arc = two[rest] >= 0
        out[rest[arc]] += self.weights[0][two[rest[arc]]] - one[rest[arc]]
        out[rest[~arc]] += self.fail[at[~arc]]
        return out


def _places(kept: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Numbers among the kept of places in all, -1 for those not kept and for -1."""
    return np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)[of]


def _scorer(tokens, types, ends, start_used, discount, buckets):
    floor = math.log10(tokens + types + 1)
    spare = discount * types / tokens / (types + 1) if tokens else 1.0

    def arcs(own: Block) -> tuple:
        """The block's kept bigrams and trigrams as arcs, and which of them end at each token."""
        sent = own.find_bigrams()
        n, many = own.answers("two_used", 2), own.answers("two_used", 3)
        used = np.full(len(own.total2), np.nan)
        used[sent] = np.where(many > 0, n - discount * many, np.nan)
        kept = own.total2 > 0
        token = own.two.token[kept]
        before = np.concatenate(([0], own.codes[:-1]))
        before[own.first] = len(own.dealt)
        two = before[token], own.codes[token], own.total2[kept], used[kept]
        two_at = _places(kept, own.two.place)
        total3 = np.zeros(len(own.three.n), np.int64)
        total3[own.three.buckets(buckets)[0]] = own.answers("three", 2)
        kept = total3 > 0
        token = own.three.token[kept]
        return two, (two_at[token - 1], two_at[token], total3[kept]), two_at, _places(kept, own.three.place)

    def score_block(rows: pa.Table) -> pa.Table:
        """Tokens, known tokens, base score and score of every text of the block."""
        own = Block(rows, buckets)
        c = own.of_words("word", 3)
        one = np.maximum(c - discount, 0) / max(tokens, 1) + spare
        n, many = own.of_words("word_used", 2), own.of_words("word_used", 3)
        used = np.where(many > 0, n - discount * many, np.nan)
        two, three, two_at, three_at = arcs(own)
        machine = Automaton(np.append(c, ends), np.append(used, start_used), np.append(one, 1.0), two, three, discount)
        weights = machine.walk(np.where(own.x >= 0, own.codes, -1), own.first, np.log10(one)[own.codes], two_at, three_at)
        texts = rows.filter(pc.is_valid(rows.column("codes")))
        out = pa.table(
            {
                "doc_id": _listed(texts, "ids"),
                "held_out": _listed(texts, "held"),
                "n_tokens": pa.array(own.sizes, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64)[own.codes], own.first)),
                "train_tokens": pa.array(np.full(len(own.sizes), tokens)),
                "base_score": pa.array(np.add.reduceat((np.log10(c + 1) - floor)[own.codes], own.first)),
                "score": pa.array(np.add.reduceat(weights, own.first)),
            }
        )
        release_memory()
        return out

    return score_block


def _listed(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks().flatten()


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", settings: LmSettings = LmSettings()) -> DataFrame:
    """Fit on the rows that are not ``held_out`` and score all rows.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null or empty text is
    the end token alone. Rows are scored one by one, repeated or not; a null id is carried along.
    Without training rows every token is unknown and weighs nothing. Columns other than the two
    named are not read, but for what ``held_out`` uses.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // settings.block_bytes), partitions(spark))
    buckets = max(1, size // BUCKET_BYTES)
    kind = dict(rows.dtypes)["doc_id"]
    own = f"tokens long, codes binary, dealt binary, sizes binary, ids array<{kind}>, held array<boolean>"
    blocks = stored(rows.coalesce(parts).mapInArrow(_block_maker(settings.block_bytes, buckets), f"{ARRAYS}, {own}"), "lm_blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    least = max(1, settings.min_count, settings.min_share * tokens)
    words = blocks.where("kind = 'word'").select(*NAMES).groupBy("bucket")
    words = stored(words.applyInArrow(_word_adder(least, buckets), f"{ARRAYS}, types long, ends long"), "lm_words")
    types, ends = words.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0))).first()
    let_go(spark)

    texts = blocks.where("kind = 'texts'").select("kind", "block", "codes", "dealt", "sizes")
    of_words = words.where("kind = 'word'").select(*NAMES)
    numbers = of_words.withColumn("b", F.lit(None).cast("binary"))  # without the totals
    sender = _dealt(texts, numbers, parts=parts)
    bigrams = sender.applyInArrow(_bigram_sender(buckets), ARRAYS).groupBy("bucket")
    bigrams = stored(bigrams.applyInArrow(_gram_adder("two", settings.min_count, buckets), f"{ARRAYS}, used long, types long"), "lm_bigrams")
    starts = bigrams.where("kind = 'start_used'").agg(F.sum("used"), F.sum("types")).first()
    start_used = starts[0] - settings.discount * starts[1] if starts[1] else math.nan
    let_go(spark)

    of_bigrams = bigrams.where("kind = 'two'").select(*NAMES)
    sender = _dealt(texts, numbers, of_bigrams, parts=parts)
    trigrams = sender.applyInArrow(_trigram_sender(buckets), ARRAYS).groupBy("bucket")
    trigrams = stored(trigrams.applyInArrow(_gram_adder("three", settings.min_count, buckets), ARRAYS), "lm_trigrams")
    let_go(spark)

    asked = numbers.unionByName(of_bigrams.withColumn("a", F.lit(None).cast("binary")))
    sums = bigrams.where("kind = 'word_used'").select(*NAMES).unionByName(trigrams.where("kind = 'two_used'"))
    histories = asked.unionByName(sums).groupBy(F.substring_index("kind", "_", 1), "bucket")
    used = stored(histories.applyInArrow(_history_adder(buckets), ARRAYS), "lm_histories")
    let_go(spark)

    texts = blocks.where("kind = 'texts'").select("kind", "block", "codes", "dealt", "sizes", "ids", "held")
    scorer = _scorer(tokens, types, ends, start_used, settings.discount, buckets)
    return _dealt(texts, of_words, of_bigrams, trigrams.where("kind = 'three'"), used, parts=parts).applyInArrow(
        scorer,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _dealt(texts: DataFrame, *answers: DataFrame, parts: int):
    """Blocks with their texts and answers."""
    for found in answers:
        texts = texts.unionByName(found, allowMissingColumns=True)
    return texts.drop("c").repartition(parts, "block").groupBy("block")
