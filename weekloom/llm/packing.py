"""Best-fit packing of token pieces into sequences, planned on a histogram of lengths.

Only the number of pieces of each length reaches the driver: at most ``size`` numbers. Best-fit
decreasing runs over these counts and yields patterns (lengths of one sequence) with how often
each is used; their number depends on ``size`` alone. Tasks then unfold the patterns into slots,
and pieces take slots by an equality join on (length, rank within length). The rank adds the
row number within a salted bucket of the length to the sizes of the buckets before it, so a
length that a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import arrow_map, id_text, stored

#: Texts of these characters are split alike by the stdlib's character classes and by the
#: tokenizer's; others take the tokenizer's own way.
_UNSURE = re.compile("[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]")
#: The pre-tokenizer's pattern in stdlib classes: [^\W\d_] are letters, \d are numbers.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CACHE_ENTRIES = 300_000


class Ids(dict):
    """Token ids (little-endian 32 bit) of words of the pre-tokenizer, kept while there is room."""

    def __init__(self, piece):
        super().__init__()
        self.piece = piece

    def __missing__(self, word: str) -> bytes:
        ids = self.piece(word)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE_ENTRIES:
            self[word] = packed
        return packed


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Strings that a tokenizer's file names as tokens of their own, with their ids."""
    with open(tokenizer_path, encoding="utf-8") as file:  # of the installed tokenizers, on every machine
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """Text to packed token ids. The ranks are the byte-level vocabulary of the tokenizer's own file.

    ``added`` strings are cut out first, the longest where several begin, and stand for one id each.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:  # a file of the installed tokenizers, on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = Ids(own.encode_ordinary)

    def plain(text: str) -> bytes:
        if _UNSURE.search(text):
            found = own.encode_ordinary(text)
            return struct.pack(f"<{len(found)}I", *found)
        return b"".join(map(ids.__getitem__, _SPLIT.findall(text)))

    if not added:
        return plain
    apart = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> bytes:
        parts = apart.split(text)
        if len(parts) == 1:
            return plain(text)
        return b"".join(struct.pack("<I", added[x]) if i % 2 else plain(x) for i, x in enumerate(parts))

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first of several may be shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = [0] * (first > 0) + list(range(first, n, size))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _cutter(ranks_path: str, pattern: str, end_id: int, size: int, added: dict[str, int] | None):
    encode = encoder(ranks_path, pattern, added)
    end = struct.pack("<I", end_id)

    def of_batch(batch):
        ids, pieces, starts, lengths, sums = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed = memoryview(encode(text) + end)
            for k, (start, length) in enumerate(cut(len(packed) // 4, size)):
                ids.append(doc)
                pieces.append(k)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(packed[4 * start : 4 * (start + length)]))
        columns = [pa.array(ids, batch.column(0).type), pa.array(pieces, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return of_batch


def token_pieces(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    added: dict[str, int] | None = None,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with ``end_id`` behind them."""
    rows = id_text(docs, id_col, text_col)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(arrow_map(_cutter, ranks_path, pattern, end_id, size, added), schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts: [(pattern, sequences)], pattern: [(length, repeats)].

    Sequences that look alike are one group. A length goes to the group with the least room that
    fits, as many times as fit, until its count is used; a group splits when only some of its
    sequences are needed. Each length splits at most two groups, so there are O(size) patterns.
    """
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern, number: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, number))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, number = size, [], left  # new sequences, as many as may be needed
            else:
                room = rooms[at]
                pattern, number = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            times = room // length
            full = min(number, left // times)
            rest = left - full * times
            used = full
            if full:
                put(room - times * length, [*pattern, (length, times)], full)
            if full < number and rest:
                put(room - rest * length, [*pattern, (length, rest)], 1)
                used, rest = used + 1, 0
            if number > used and pattern:
                put(room, pattern, number - used)
            left = rest
    return [(p, n) for room in rooms for p, n in groups[room]]


def slot_runs(planned) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces in a sequence, first sequence, sequences, offset) of every pattern's lengths."""
    ranks: dict[int, int] = {}
    sequence, rows = 0, []
    for pattern, number in planned:
        offset = 0
        for length, times in pattern:
            rows.append((length, ranks.get(length, 0), times, sequence, number, offset))
            ranks[length] = ranks.get(length, 0) + times * number
            offset += times * length
        sequence += number
    return rows


CHUNK = 16384


def slots(spark, planned) -> DataFrame:
    """length, rank, sequence_id, offset: one row per planned place, unfolded in two steps by the tasks."""
    runs = spark.createDataFrame(slot_runs(planned), "length long, first long, times long, sequence long, number long, offset long")
    chunks = runs.withColumn("lo", F.explode(F.expr(f"sequence(0L, times * number - 1, {CHUNK}L)")))
    chunks = chunks.repartition("length", "first", "lo")
    places = chunks.withColumn("i", F.explode(F.expr(f"sequence(lo, least(lo + {CHUNK - 1}, times * number - 1))")))
    return places.select(
        "length",
        (F.col("first") + F.col("i")).alias("rank"),
        F.expr("sequence + i div times").alias("sequence_id"),
        F.expr("offset + (i % times) * length").alias("offset"),
    )


def rank_within_length(pieces: DataFrame, total: int, rows_per_bucket: int = 20_000, least: int = 64) -> DataFrame:
    """Add ``rank``: 0, 1, ... within each length, by salted buckets."""
    buckets = max(least, -(-total // rows_per_bucket))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["length", "bucket"]).withColumn("rank", F.col("_base") + F.col("_row")).drop("bucket", "_row", "_base")


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Give every piece a sequence and an offset.

    ``pieces`` must be a stored table, as it is read several times: doc_id, piece, start, length,
    ids_crc32. An empty table gives an empty result; equal rows take different places; a null id is
    a value like others.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    planned = plan(counts, size)
    ranked = rank_within_length(pieces, sum(counts.values()))
    placed = ranked.join(slots(spark, planned), ["length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_packing(
    docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Tokenize every document, cut what is longer than ``size``, pack all pieces. A null text is empty."""
    return pack(stored(token_pieces(docs, ranks_path, pattern, end_id, size, id_col, text_col, added), "pieces"), size)
