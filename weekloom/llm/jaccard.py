"""Exact similarity join of shingle sets with PartEnum signatures.

Two sets link when their Jaccard similarity is at least 0.8. Sets go to bands of about equal size;
in a band, linked sets differ in at most ``k`` elements. The shingle domain is partitioned: with
k differences over more than k partitions, some partitions are free of them, so linked sets share
the signature of a partition's content. In small bands each partition is divided once more and the
subsets of its parts are enumerated, one part left out at a time. In larger bands a set with T
sure matches leaves out the T - 1 signatures that cover the fewest elements; by the order this
puts on signatures, one shared signature always stays. No link is lost.

Sets that share a signature form groups. Equal sets are one class from the start. In a group, sets
first meet leaders only; groups that then lie in one component are done. What is left meets across
components in blocks, where a parity sketch (a lower bound of the difference) drops pairs that
cannot link; a pair that stands in several groups is left to the earlier ones where they are seen. All
pairs that pass are decided on the whole sets.

That finds the components, not every link inside them. All links lie inside components; where they
are asked for, those of each class are counted there: block by block, every pair on the whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.collocations import Polynomials
from weekloom.llm.common import SPACES, arrow_map, id_text, let_go, stored
from weekloom.llm.components import components
from weekloom.llm.wordarrays import SPACE, WordArrays

SHINGLE = 5
SKETCH_BITS = 512
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 20
BEFORE = 8  # groups of a set before one in which its pairs are looked for
SLACK = 0.25
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A-Z becomes a-z; the bytes that separate words become spaces.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[0x41:0x5B] += 32
_BYTES[list(SPACES)] = SPACE


_of_word = Polynomials(0x9E3779B97F4A7C15 | 1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct 64-bit shingles of every text in order; a text of fewer than five words is one shingle, without words none."""
    words = WordArrays(texts, _BYTES, None)
    h = np.zeros(0, np.uint64)
    if len(words.dictionary):
        _, at, data = words.dictionary.buffers()
        at = np.frombuffer(at, np.int32)[: len(words.dictionary) + 1]
        total, inverse = _of_word.prefix(np.frombuffer(data, np.uint8)[: at[-1]].astype(np.uint64) + np.uint64(1))
        h = mix((total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]] + np.diff(at).astype(np.uint64))[words.ids]

    def keys(h: np.ndarray, width: int) -> np.ndarray:
        key = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for i in range(width):  # a polynomial of well-mixed word hashes, mixed once at the end
            key = (key + h[i : i + len(key)]) * _P
        return mix(key)

    whole = keys(h, SHINGLE)
    out = []
    for lo, n in zip(words.first.tolist(), words.size.tolist(), strict=True):
        out.append(np.unique(whole[lo : lo + n - SHINGLE + 1] if n >= SHINGLE else keys(h[lo : lo + n], n)) if n else np.empty(0, np.uint64))
    return out


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column]


def set_id(s: np.ndarray) -> int:
    """64-bit identity of a set."""
    total = int(mix(s * _P).sum(dtype=np.uint64)) ^ (len(s) * 0x9E3779B97F4A7C15)
    return int(np.int64(np.uint64(total & 0xFFFFFFFFFFFFFFFF)))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell: sets differ in at least as many elements as sketches in bits."""
    cells = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(cells.astype(np.uint8) & 1).tobytes()


def bands(m: int) -> list[int]:
    """Upper ends of the bands that a set of size ``m`` takes part in: its own and those its links may lie in."""
    r = 1 << max(0, (m - 1).bit_length())
    found = [r]
    while 4 * (r + 1) <= 5 * m:  # the next band's smallest set may link with this one
        r *= 2
        found.append(r)
    return found


def most_differences(m: int, r: int) -> int:
    """Elements in which a set of size ``m`` and a linked one of size up to ``r`` differ at most."""
    return (m + min(r, 5 * m // 4)) // 9


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of a set in all its bands. Sets that only link with equal ones have none."""
    m, out = len(s), []
    for r in bands(m):
        k, top = most_differences(m, r), 2 * r // 9
        if not k:
            continue
        if top <= 3:
            out.append(_enumerated(s, r, top))
        else:
            out.append(_partitioned(s, r, top, k))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _named(sums: np.ndarray, r: int, place: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(place.astype(np.uint64) + np.uint64(r << 32)))


def _enumerated(s: np.ndarray, r: int, top: int) -> np.ndarray:
    """Partitions with at most one difference in one of them; each in three parts, of which two are taken."""
    n1 = top // 2 + 1
    high = s >> np.uint64(32)
    cell = (high * np.uint64(3 * n1)) >> np.uint64(32)
    sums = np.zeros(3 * n1, dtype=np.uint64)
    np.add.at(sums, cell.astype(np.int64), mix(s))
    parts = sums.reshape(n1, 3)
    left_out = parts.sum(axis=1, dtype=np.uint64)[:, None] - parts
    return _named(left_out.ravel(), r, np.arange(3 * n1))


def _partitioned(s: np.ndarray, r: int, top: int, k: int) -> np.ndarray:
    n1 = top + 1 + int(np.ceil(SLACK * (top + 1)))
    cell = (((s >> np.uint64(32)) * np.uint64(n1)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sums = np.add.reduceat(mix(s[order]), starts)
    size = np.diff(np.concatenate([starts, [len(s)]]))
    found = _named(sums, r, cell[starts])
    sure = n1 - k - (n1 - len(starts))  # non-empty partitions that a linked set surely shares
    if sure >= 1:
        keep = np.lexsort((found, -size))[: len(found) - sure + 1]
        return found[keep]
    empty = np.setdiff1d(np.arange(n1), cell[starts])
    return np.concatenate([found, _named(np.zeros(len(empty), np.uint64), r, empty)])


def _describer():
    def of_batch(batch):
        sets = shingle_sets(_bytes_of(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) for s in sets], pa.int64()),
                pa.array([sketch(s) for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set", "sketch"],
        )

    return of_batch


def _signer():
    """Signatures of the sets that this task has not met yet."""
    seen: set[int] = set()

    def of_batch(batch):
        found, owners, counts = [], [], []
        for s in shingle_sets(_bytes_of(batch.column(0))):
            if len(s) < SHINGLE - 1 or (ident := set_id(s)) in seen:
                continue
            if len(seen) < 2_000_000:
                seen.add(ident)
            signs = signatures(s)
            found.append(signs)
            owners.append(ident)
            counts.append(len(signs))
        signs = np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signs), pa.array(np.repeat(np.array(owners, dtype=np.int64), counts))], ["sig", "set"]
        )

    return of_batch


def _shingler():
    def of_batch(batch):
        sets = shingle_sets(_bytes_of(batch.column(1)))
        # Rows that share an id may differ in text: only the text of the class counts.
        own = [i for i, (s, ident) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if set_id(s) == ident]
        kept = pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), kept], ["set", "elements"])

    return of_batch


def _sketches(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, SKETCH_BITS // 64)
    return table.column("set").to_numpy(), table.column("n_shingles").to_numpy(), bits


def may_link(n: np.ndarray, bits: np.ndarray, other_n, other_bits: np.ndarray) -> np.ndarray:
    """False only for pairs that surely do not link, by size and by sketch."""
    differ = np.bitwise_count(bits ^ other_bits).sum(axis=-1, dtype=np.int64)
    return (9 * differ <= n + other_n) & (5 * np.minimum(n, other_n) >= 4 * np.maximum(n, other_n))


def _pairs(a: list, b: list) -> pa.Table:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _leaders(table: pa.Table) -> pa.Table:
    """Every set with the first leader that it may link with; a set without one leads."""
    table = table.sort_by("set")
    ident, n, bits = _sketches(table)
    rest = np.arange(len(ident))
    a, b = [], []
    while len(rest) > 1:
        lead, rest = rest[0], rest[1:]
        near = may_link(n[rest], bits[rest], n[lead], bits[lead])
        a.append(np.full(int(near.sum()), ident[lead]))
        b.append(ident[rest[near]])
        rest = rest[~near]
    return _pairs(a, b)


def _across(table: pa.Table) -> pa.Table:
    """Pairs of different components that may link; blocks i and j of a group, or one block with itself.

    A pair that also shares one of the last groups ``before`` this one is left to those: of all groups that hold a pair, the
    first always brings it out.
    """
    ident, n, bits = _sketches(table)
    label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
    lists = table.column("before").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    before = -1 - np.arange(len(ident) * BEFORE).reshape(-1, BEFORE)  # in no other row
    owner = np.repeat(np.arange(len(ident)), size)
    before[owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    j = table.column("j")[0].as_py()
    left, right = np.flatnonzero(block != j), np.flatnonzero(block == j)
    itself = not len(left)
    if itself:
        left = right
    a, b = [], []
    for x in left:
        ok = right[(label[right] != label[x]) & may_link(n[right], bits[right], n[x], bits[x])]
        if itself:
            ok = ok[ok > x]
        if len(ok):
            ok = ok[~(before[ok][:, :, None] == before[x]).any((1, 2))]
        a.append(np.full(len(ok), ident[x]))
        b.append(ident[ok])
    return _pairs(a, b)


def _link_counts(table: pa.Table) -> pa.Table:
    """(set, links) of blocks i and j of a component, or of one block with itself, decided on the whole sets."""
    ident, block = table.column("set").to_numpy(), table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    lists = table.column("elements").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    values, place = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    begin = np.cumsum(size) - size
    left = np.flatnonzero(block == i)
    right = np.flatnonzero(block == j)
    right = right[np.argsort(size[right], kind="stable")]
    n = size[right].astype(np.int64)
    found = np.concatenate([np.empty(0, np.int64), *[place[begin[x] : begin[x] + size[x]] for x in right]])
    start = np.concatenate([[0], np.cumsum(n)])
    links = np.zeros(len(ident), dtype=np.int64)
    mark = np.zeros(len(values), dtype=bool)
    for x in left:
        m, own = int(size[x]), place[begin[x] : begin[x] + size[x]]
        lo, hi = np.searchsorted(5 * n, 4 * m), np.searchsorted(4 * n, 5 * m, side="right")
        if lo >= hi:
            continue
        mark[own] = True
        common = np.add.reduceat(mark[found[start[lo] : start[hi]]], start[lo:hi] - start[lo], dtype=np.int64)
        mark[own] = False
        linked = (100 * common >= 80 * (m + n[lo:hi] - common)) & (ident[right[lo:hi]] != ident[x])
        links[x] += linked.sum()
        if i != j:
            links[right[lo:hi]] += linked
    return pa.table({"set": ident, "links": links})


def link_counts(linked: DataFrame, elements: DataFrame) -> DataFrame:
    """(set, n_links) of the linked classes (set, label, n_shingles): all links, by whole sets.

    Each block of a component meets itself and every other block of it once. Counts leave a
    block, not pairs.
    """
    sizes = linked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m"))
    sizes = stored(sizes, "component_sizes")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_ELEMENTS)).cast("int").alias("blocks")
    pairs = linked.join(sizes.where("n = 2").select("label"), "label").select("set", F.lit(1).cast("long").alias("n_links"))
    members = linked.join(sizes.where("n > 2").select("label", blocks), "label").join(elements, "set")
    dealt = (
        members.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "set", "elements", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    counts = dealt.groupBy("label", "i", "j").applyInArrow(_link_counts, "set long, links long")
    return pairs.unionByName(counts.groupBy("set").agg(F.sum("links").alias("n_links")))


def candidate_groups(docs: DataFrame) -> DataFrame:
    """(g, set): sets that share a signature; groups of the same members are one group."""
    signed = docs.select("text").mapInArrow(arrow_map(_signer), "sig long, set long")
    by_sig = Window.partitionBy("sig").orderBy("set")
    whole = by_sig.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = signed.select(
        "set", F.lag("set").over(by_sig).alias("before"), F.min("set").over(whole).alias("least"), F.max("set").over(whole).alias("most"),
        F.sum(F.hash("set").cast("long")).over(whole).alias("g1"), F.sum(F.hash("set", F.lit(1)).cast("long")).over(whole).alias("g2"),
    )
    rows = rows.where((F.col("least") != F.col("most")) & (F.col("before").isNull() | (F.col("before") != F.col("set"))))
    return rows.select(F.xxhash64("g1", "g2", "least", "most").alias("g"), "set").distinct()


def decide(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that link, decided on the whole sets."""
    both = (
        pairs.distinct()
        .join(elements.select(F.col("set").alias("a"), F.col("elements").alias("x")), "a")
        .join(elements.select(F.col("set").alias("b"), F.col("elements").alias("y")), "b")
    )
    common = both.withColumn("c", F.size(F.array_intersect("x", "y")))
    return common.where(100 * F.col("c") >= 80 * (F.size("x") + F.size("y") - F.col("c"))).select("a", "b")


@dataclass
class Joined:
    """Tables of a similarity join: every row with its set, classes of equal sets, their links' components, whole sets."""

    rows: DataFrame  # doc_id, n_shingles, set
    classes: DataFrame  # set, rep, n_shingles
    labels: DataFrame  # rep, label
    linked: DataFrame  # set, label, n_shingles of classes with a link
    elements: DataFrame  # set, elements


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach); with ``links`` also n_links.

    A null or empty text, or one without words, has no shingle and links with nothing. Rows with
    equal sets are one class. Rows that repeat an id with different texts are classes of their own, each with its links. A
    row with a null id takes the component of a named row with the same set, or none, and is no one's partner. Columns
    other than the two named are not read. n_links: how many classes of other texts the row's class links with, all of
    them; every pair inside a component is decided for that, so that work grows with the square of a component.
    """
    found = similarity_join(docs, id_col, text_col)
    known = found.classes.select("set", "rep").join(found.labels, "rep", "left").select("set", F.coalesce("label", "rep").alias("component"))
    both = found.rows.join(known, "set", "left")
    own = F.col("n_shingles") > 0
    columns = ["doc_id", "n_shingles", F.when(own, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        both = both.join(link_counts(found.linked, found.elements), "set", "left")
        columns.append(F.coalesce(F.when(own, F.col("n_links")), F.lit(0).cast("long")).alias("n_links"))
    return both.select(*columns)


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Joined:
    """The links between classes of equal sets, as components."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    described = stored(rows.mapInArrow(arrow_map(_describer), f"doc_id {kind}, n_shingles long, set long, sketch binary"), "sets")
    named = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("set").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    classes = stored(classes, "classes")
    groups = stored(candidate_groups(rows.where("doc_id IS NOT NULL")), "groups")

    # Sketches and whole sets of the classes that are in any group, from one document of each.
    met = stored(groups.select("set").distinct().join(classes, "set"), "met")
    sketches = named.select("doc_id", "set", "sketch").join(met.withColumnRenamed("rep", "doc_id"), ["doc_id", "set"]).dropDuplicates(["set"])
    sketches = stored(sketches.select("set", "n_shingles", "sketch"), "sketches")
    # Texts meet their classes in one exchange, however few there are.
    texts = rows.join(met.select(F.col("rep").alias("doc_id"), "set").hint("merge"), "doc_id").select("set", "text")
    elements = texts.mapInArrow(arrow_map(_shingler), "set long, elements array<long>").dropDuplicates(["set"])
    elements = stored(elements, "elements")

    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("a"), F.max("set").alias("b"))
    sizes = stored(sizes, "sizes").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    pairs = sizes.where("n = 2").select("a", "b")  # most groups are one pair, and are decided at once
    members = groups.join(sizes.where("n > 2").select("g", "blocks"), "g").withColumn("block", F.pmod(F.hash("set"), F.col("blocks")))
    members = stored(members.join(sketches, "set"), "members")
    leaders = members.groupBy("g", "block").applyInArrow(_leaders, "a long, b long")
    links = stored(decide(pairs.unionByName(leaders), elements), "links")

    let_go(links.sparkSession)
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = members.join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn(
        "label", F.coalesce("label", "set")
    )
    placed = stored(placed, "placed")
    mixed = placed.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("g")
    earlier = Window.partitionBy("set").orderBy("g").rowsBetween(-BEFORE, -1)
    # Each block meets itself and every other block of its group once.
    dealt = (
        placed.join(mixed, "g")
        .withColumn("before", F.transform(F.collect_list("g").over(earlier), lambda x: F.shiftrightunsigned(x, 1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    more = decide(dealt.groupBy("g", "i", "j").applyInArrow(_across, "a long, b long"), elements)
    links = stored(links.unionByName(more).distinct(), "all_links")
    del more, dealt, labels
    let_go(links.sparkSession)

    reps = classes.select("set", "rep")
    edges = links.join(reps.withColumnRenamed("set", "a").withColumnRenamed("rep", "u"), "a").join(
        reps.withColumnRenamed("set", "b").withColumnRenamed("rep", "v"), "b"
    )
    labels = components(edges).withColumnRenamed("node", "rep")
    ends = links.select(F.col("a").alias("set")).unionByName(links.select(F.col("b").alias("set"))).distinct()
    linked = stored(ends.join(classes, "set").join(labels, "rep").select("set", "label", "n_shingles"), "linked")
    return Joined(described.select("doc_id", "n_shingles", "set"), classes, labels, linked, elements)
