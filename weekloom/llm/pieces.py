"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text's pieces are a best path through the lattice of vocabulary pieces. A giant document is
sliced into chunks. At each cut the state is the piece that ends at or reaches over the cut; a
chunk's transfer matrix holds, for each pair of states at its two ends, the weight of the best
path between them. Matrices combine associatively (sum along paths, maximum over states) in a
tree over the chunks, which fixes the states at all cuts; every chunk is then traced by itself.

For unigram vocabularies weights are the pieces' scores. For BPE vocabularies a sequence of pieces
is the encoding exactly if every two neighbours are the encoding of their joined text, so paths
weigh nothing and neighbours that are not are no path. Between clean cuts, where a mark follows a letter, units are encoded by
themselves, each distinct one once; documents up to ``CHUNK`` characters are units throughout.

The vocabularies in use leave texts as they are but for a space mark before the text and in place
of each space (identity normalization), and no piece goes on with a mark after a letter.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import arrow_map, id_text, partitions, stored

MARK = "▁"
CHUNK = 16384
FAN = 64
CLEAN = (0, "")  # a cut between words: nothing reaches over it, and neighbours do not matter
CACHE_ENTRIES = 200_000
ROWS = 4096  # texts whose distinct units are encoded together; each of up to CHUNK characters


class Lattice:
    """Pieces with weights, and which pieces may be neighbours."""

    def __init__(self, weights: dict[str, float], joined: Callable[[str, str], bool], free: bool = False):
        self.weights, self.joined = weights, joined
        self.free = free  # paths weigh nothing
        self.width = max(map(len, weights), default=1)
        self.words: dict[str, tuple[float, list[str]]] = {}

    def arcs(self, text: str, i: int):
        """Pieces that start at ``i``; a character that is no piece stands for itself."""
        if text[i] not in self.weights:
            yield text[i]
        for j in range(i + 1, min(len(text), i + self.width) + 1):
            if text[i:j] in self.weights:
                yield text[i:j]

    def forward(self, text: str, at: int, piece: str, stop: int) -> list[dict]:
        """Best paths from ``piece`` ending at ``at``: by end position, {last piece: (weight, previous piece)}.

        Pieces start before ``stop``; those that end at or behind it are the states there.
        """
        ends: list[dict] = [{} for _ in range(len(text) + 1)]
        ends[at][piece] = (0.0, None)
        for i in range(at, stop):
            here = ends[i]
            if not here:
                continue
            for sub in self.arcs(text, i):
                best = None
                for before, (w, _) in here.items():
                    if (best is None or w > best[0]) and self.joined(before, sub):
                        best = (w, before)
                if best is not None:
                    w = best[0] + self.weights.get(sub, 0.0)
                    there = ends[i + len(sub)]
                    if sub not in there or w > there[sub][0]:
                        there[sub] = (w, best[1])
        return ends

    @staticmethod
    def back(ends: list[dict], at: int, start: int, piece: str) -> list[str]:
        out = []
        while at > start:
            out.append(piece)
            at, piece = at - len(piece), ends[at][piece][1]
        return out[::-1]

    def word(self, word: str) -> tuple[float, list[str]]:
        """Weight and pieces of a text between two clean cuts."""
        found = self.words.get(word)
        if found is None:
            n = len(word)
            ends = self.forward(word, 0, "", n)
            last = max(ends[n], key=lambda p: (ends[n][p][0], p))
            found = ends[n][last][0], self.back(ends, n, 0, last)
            if len(self.words) < CACHE_ENTRIES:
                self.words[word] = found
        return found


def clean_cut(text: str, i: int) -> bool:
    return i == 0 or i == len(text) or text[i - 1] != MARK and text[i] == MARK


class Chunk:
    """One slice with the characters around it; ``first`` and ``last`` of its document."""

    def __init__(self, lattice: Lattice, left: str, body: str, right: str):
        self.lattice, self.text = lattice, left + body + right
        self.lo, self.hi = len(left), len(left) + len(body)
        cuts = [i for i in range(self.lo + 1, self.hi) if clean_cut(self.text, i)]
        self.cuts = cuts

    def entries(self) -> list[tuple[int, str]]:
        if clean_cut(self.text, self.lo):
            return [CLEAN]
        found = []
        for s in range(max(0, self.lo - self.lattice.width), self.lo):
            for sub in self.lattice.arcs(self.text, s):
                if s + len(sub) >= self.lo:
                    found.append((s + len(sub) - self.lo, sub))
        return found

    def _exits(self, ends: list[dict]) -> dict[tuple[int, str], tuple[float, int, str]]:
        """State at the upper end: weight, and where and with which piece the path ends."""
        if clean_cut(self.text, self.hi):
            return {CLEAN: max((w, self.hi, p) for p, (w, _) in ends[self.hi].items())} if ends[self.hi] else {}
        return {(e - self.hi, p): (w, e, p) for e in range(self.hi, len(ends)) for p, (w, _) in ends[e].items()}

    def middle(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def transfer(self) -> list[tuple]:
        """(state below, state above, weight) of every feasible pair."""
        lat, out = self.lattice, []
        if not self.cuts:
            for state in self.entries():
                ends = lat.forward(self.text, self.lo + state[0], state[1], self.hi)
                out += [(state, above, w) for above, (w, _, _) in self._exits(ends).items()]
            return out
        first, last = self.cuts[0], self.cuts[-1]
        between = 0.0 if lat.free else sum(lat.word(word)[0] for word in self.middle())
        tail = self._exits(lat.forward(self.text, last, "", self.hi))
        for state in self.entries():
            ends = lat.forward(self.text[:first], self.lo + state[0], state[1], first)
            if ends[first]:
                head = max(w for w, _ in ends[first].values())
                out += [(state, above, head + between + w) for above, (w, _, _) in tail.items()]
        return out

    def trace(self, below: tuple[int, str], above: tuple[int, str]) -> list[str]:
        """Pieces that start in this chunk on the best path between two states."""
        head, _, tail = self.ends_of(below, above)
        return head + [p for word in self.middle() for p in self.lattice.word(word)[1]] + tail

    def ends_of(self, below: tuple[int, str], above: tuple[int, str]) -> tuple[list[str], tuple[int, int], list[str]]:
        """The best path between two states: pieces up to the first clean cut, where whole units stand, pieces behind them."""
        lat, start = self.lattice, self.lo + below[0]
        if not self.cuts:
            ends = lat.forward(self.text, start, below[1], self.hi)
            _, at, piece = self._exits(ends)[above]
            return lat.back(ends, at, start, piece), (0, 0), []
        first, last = self.cuts[0], self.cuts[-1]
        head = lat.forward(self.text[:first], start, below[1], first)
        best = max(head[first], key=lambda p: (head[first][p][0], p))
        tail = lat.forward(self.text, last, "", self.hi)
        _, at, piece = self._exits(tail)[above]
        return lat.back(head, first, start, best), (first, last), lat.back(tail, at, last, piece)


def combine(matrices: list[list[tuple]]) -> list[tuple]:
    """Max-plus product of matrices in order."""
    total = matrices[0]
    for nxt in matrices[1:]:
        rows: dict = {}
        for a, b, w in nxt:
            rows.setdefault(a, []).append((b, w))
        best: dict = {}
        for a, b, w in total:
            for c, v in rows.get(b, ()):
                if (a, c) not in best or w + v > best[a, c]:
                    best[a, c] = w + v
        total = [(a, c, w) for (a, c), w in best.items()]
    return total


def states_between(matrices: list[list[tuple]], below, above) -> list:
    """States at all cuts, both ends included, of the best path from ``below`` to ``above``."""
    best, back = {below: 0.0}, []
    for matrix in matrices:
        nxt, came = {}, {}
        for a, b, w in matrix:
            if a in best and (b not in nxt or best[a] + w > nxt[b]):
                nxt[b], came[b] = best[a] + w, a
        best = nxt
        back.append(came)
    path = [above]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def bpe(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """Merge the neighbours whose joined piece scores best, the leftmost first, until none is a piece."""
    symbols = list(symbols)
    while True:
        pairs = [(-rank[j], i) for i in range(len(symbols) - 1) if (j := symbols[i] + symbols[i + 1]) in rank]
        if not pairs:
            return symbols
        i = min(pairs)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def bpe_lattice(rank: dict[str, float]) -> Lattice:
    known: dict[tuple[str, str], bool] = {}

    def joined(a: str, b: str) -> bool:
        if (a, b) not in known:
            if len(known) > 2 * CACHE_ENTRIES:
                known.clear()
            known[a, b] = bpe(a + b, rank) == ([a, b] if a else [b])
        return known[a, b]

    return Lattice(dict.fromkeys(rank, 0.0), joined, True)


def unigram_lattice(scores: dict[str, float]) -> Lattice:
    return Lattice(scores, lambda a, b: True)


class Vocabulary:
    """Ids and pieces of a model file, which lies at the same place on every machine.

    No piece goes on with a mark after a letter, so texts are encoded unit by unit: marks and the letters up to the next
    mark.
    """

    def __init__(self, path: str, kind: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        self.ids = {self.model.id_to_piece(i): i for i in plain}
        self.byte_ids = {int(self.model.id_to_piece(i)[3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.raw = pa.array([raw.get(i, b"") for i in range(n)], pa.large_binary())
        scores = {p: self.model.get_score(i) for p, i in self.ids.items()}
        self.lattice = bpe_lattice(scores) if kind == "bpe" else unigram_lattice(scores)

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece becomes its bytes, or unknown where the vocabulary has no bytes."""
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.model.unk_id())
        return out

    def encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units (spaces for marks), one after the other, and how many each has."""
        # The library puts a mark before the text; a unit of marks alone it would take for an empty text.
        found = self.model.encode(pc.utf8_slice_codeunits(units, 1).to_pylist(), num_threads=1)
        for i in np.flatnonzero(pc.equal(pc.utf8_ltrim(units, " "), "").to_numpy(zero_copy_only=False)):
            found[i] = self.numbers(self.lattice.word(MARK * len(units[int(i)].as_py()))[1])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[bytes]) -> pa.ListArray:
        """Ids of every text. Distinct units are looked up once a call; their ids are laid out by place."""
        marked = [b" " + t.replace(MARK.encode(), b" ") if t else t for t in texts]
        raw = np.frombuffer(b"".join(marked), np.uint8)
        ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
        space = raw == ord(" ")
        head = np.zeros(len(raw) + 1, bool)
        head[0], head[ends] = True, True
        before = np.concatenate((np.zeros(1, bool), space))[:-1]
        starts = np.flatnonzero(head[:-1] | (space & ~before))
        offsets = pa.array(np.append(starts, len(raw)), pa.int64())
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(raw)]).dictionary_encode()
        flat, sizes = self.encoded(coded.dictionary.cast(pa.large_string()))
        unit = coded.indices.to_numpy()
        width = sizes[unit] if len(unit) else np.zeros(0, np.int64)
        first = np.cumsum(sizes) - sizes
        after = np.cumsum(width)
        at = np.arange(int(after[-1]) if len(after) else 0) + np.repeat((first[unit] if len(unit) else unit) - (after - width), width)
        per_text = np.zeros(len(texts), np.int64)
        np.add.at(per_text, np.searchsorted(ends, starts, "right"), width)
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[at], pa.int32()))

    def decode(self, ids: pa.ListArray, first: list[bool]) -> pa.Array:
        """Texts of lists of ids; where ``first``, the mark before the text goes."""
        values = ids.flatten()
        raw = self.raw.take(values)
        _, at, data = raw.buffers()
        at = np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = memoryview(data if data is not None else b"")
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        texts = []
        for lo, hi, is_first in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), first, strict=True):
            text = bytes(data[lo:hi])
            texts.append(text[1:] if is_first and text[:1] == b" " else text)
        made = pa.array(texts, pa.binary())
        try:
            return made.cast(pa.string())
        except pa.ArrowInvalid:  # ids that are not of one text
            return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


def _slicer(width: int, chunk: int):
    def run(batches):
        for batch in batches:
            for doc, text, row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = MARK + text.replace(" ", MARK)
                rows, held = [], 0
                for j, lo in enumerate(range(0, len(text), chunk)):
                    hi = lo + chunk
                    rows.append((doc, row, j, text[max(0, lo - width) : lo], text[lo:hi], text[hi : hi + width]))
                    held += chunk
                    if held > 4_000_000:
                        yield _slices(rows, batch.column(0).type)
                        rows, held = [], 0
                if rows:
                    yield _slices(rows, batch.column(0).type)

    return run


def _slices(rows, kind):
    kinds = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["doc_id", "key", "chunk", "before", "body", "after"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _packed(matrix: list[tuple]) -> str:
    return json.dumps([[a, b, w] for a, b, w in matrix])


def _unpacked(text: str) -> list[tuple]:
    return [(tuple(a), tuple(b), w) for a, b, w in json.loads(text)]


def _transferer(path: str, kind: str):
    lattice = Vocabulary(path, kind).lattice

    def of_batch(batch):
        slices = zip(*[batch.column(c).to_pylist() for c in ("before", "body", "after")], strict=True)
        found = [_packed(Chunk(lattice, *s).transfer()) for s in slices]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("chunk"), pa.array(found, pa.string())], ["key", "chunk", "matrix"]
        )

    return of_batch


def _product(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    total = combine([_unpacked(m) for m in table.column("matrix").to_pylist()])
    return pa.table(
        {
            "key": table.column("key").slice(0, 1),
            "chunk": pa.array([table.column("chunk")[0].as_py() // FAN], pa.int32()),
            "matrix": pa.array([_packed(total)], pa.string()),
        }
    )


def _descend(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    ends = json.loads(table.column("ends")[0].as_py())
    path = states_between([_unpacked(m) for m in table.column("matrix").to_pylist()], tuple(ends[0]), tuple(ends[1]))
    pairs = [json.dumps(p) for p in zip(path, path[1:], strict=False)]
    return pa.table({"key": table.column("key"), "chunk": table.column("chunk"), "ends": pa.array(pairs, pa.string())})


def scan(matrices: DataFrame, chunks: int) -> DataFrame:
    """(key, chunk, ends): the states at both ends of each chunk. ``matrices``: key, chunk, matrix.

    Up the tree ``FAN`` matrices become one until every document has one; down again the states at
    the ends of a group give those at the ends of its members. A task holds ``FAN`` matrices.
    """
    levels = [matrices]
    while chunks > 1:
        chunks = -(-chunks // FAN)
        grouped = levels[-1].groupBy("key", (F.col("chunk") / FAN).cast("int").alias("group"))
        levels.append(stored(grouped.applyInArrow(_product, "key long, chunk int, matrix string"), "matrices"))
    ends = levels[-1].select("key", "chunk", F.lit(json.dumps([CLEAN, CLEAN])).alias("ends"))
    for level in reversed(levels[:-1]):
        above = ends.select("key", F.col("chunk").alias("group"), "ends")
        members = level.withColumn("group", (F.col("chunk") / FAN).cast("int")).join(above, ["key", "group"])
        ends = members.groupBy("key", "group").applyInArrow(_descend, "key long, chunk int, ends string")
    return ends


def _tracer(path: str, kind: str):
    words = Vocabulary(path, kind)

    def of_batch(batch):
        ids = []
        for before, body, after, ends in zip(*[batch.column(c).to_pylist() for c in ("before", "body", "after", "ends")], strict=True):
            below, above = json.loads(ends)
            chunk = Chunk(words.lattice, before, body, after)
            head, (lo, hi), tail = chunk.ends_of(tuple(below), tuple(above))
            # The units start with a mark, which the vocabulary puts there itself.
            middle = words.encode([chunk.text[lo + 1 : hi].replace(MARK, " ").encode("utf-8", "surrogatepass")]) if hi > lo + 1 else None
            if hi == lo + 1:
                head += [MARK]
            own = [np.array(words.numbers(head), np.int32), np.array(words.numbers(tail), np.int32)]
            ids.append(np.concatenate([own[0], middle.flatten().to_numpy(), own[1]]) if middle is not None else np.concatenate(own))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "chunk", "ids"])

    return of_batch


def _whole(path: str, kind: str):
    words = Vocabulary(path, kind)

    def of_batch(batch):
        ids = words.encode([t.as_buffer().to_pybytes() for t in batch.column(1)])
        zero = pa.array(np.zeros(batch.num_rows), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), zero, ids], ["doc_id", "chunk", "ids"])

    return of_batch


def encode(
    docs: DataFrame, path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, width: int = 64
) -> DataFrame:
    """doc_id, chunk, ids: the ids of a document are those of its chunks in order.

    ``kind``: bpe or unigram. ``width``: longest piece at most. A null or empty text is one chunk
    without ids. Rows are encoded one by one, whether or not their ids are null or repeat; a chunk
    of a repeated giant row comes once for each row. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    id_kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {id_kind}, chunk int, ids array<int>"
    short = rows.where(F.length("text") <= chunk).mapInArrow(arrow_map(_whole, path, kind, rows_at_once=ROWS), schema)
    giant = rows.where(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id())
    slices = giant.mapInArrow(_slicer(width, chunk), f"doc_id {id_kind}, key long, chunk int, before string, body string, after string")
    slices = stored(slices.repartition(partitions(spark), "key", "chunk"), "slices")
    most = slices.agg(F.coalesce(F.max("chunk"), F.lit(-1))).first()[0] + 1
    if not most:
        return short
    matrices = slices.mapInArrow(arrow_map(_transferer, path, kind), "key long, chunk int, matrix string")
    ends = scan(stored(matrices, "matrices"), most)
    traced = slices.join(ends, ["key", "chunk"]).mapInArrow(arrow_map(_tracer, path, kind), schema)
    return short.unionByName(traced)


def _decoder(path: str, kind: str):
    words = Vocabulary(path, kind)

    def of_batch(batch):
        ids = batch.column("ids")
        texts = words.decode(ids, [c == 0 for c in batch.column("chunk").to_pylist()])
        data = ids.flatten().to_numpy().astype("<u4", copy=False)
        sizes = np.array([len(x) for x in ids], np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes))).tolist()
        crc = [zlib.crc32(data[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]
        columns = [batch.column("doc_id"), batch.column("chunk"), pa.array(sizes), pa.array(crc, pa.int64()), texts]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "n_tokens", "ids_crc32", "text"])

    return of_batch


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """doc_id, chunk, n_tokens, ids_crc32, text of every chunk; the texts of a document's chunks join to its text."""
    id_kind = dict(encoded.dtypes)["doc_id"]
    schema = f"doc_id {id_kind}, chunk int, n_tokens long, ids_crc32 long, text string"
    return encoded.select("doc_id", "chunk", "ids").mapInArrow(arrow_map(_decoder, path, kind), schema)
