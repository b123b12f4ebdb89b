"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, counted level by level, verified against the text.

A task turns its texts into arrays of words and hashes every n-gram with prefix polynomials over the words.
Spark adds the counts of fingerprints. A phrase can only be frequent if its words and its pairs are, so the
frequent words leave a bit table that the pass over pairs looks into, and the frequent pairs one for longer
phrases. Bit tables let some infrequent phrases through and never stop a frequent one. The last pass goes over
the text again: every occurrence of a frequent fingerprint is compared word by word with the first of its
task, and counts and pointers are added up by the phrase itself, so that fingerprints which two phrases
share cost work but change no count. Tasks send sorted arrays, one to each bucket of fingerprints or phrases,
instead of a row for each.

A null text is empty, a null language is ``und``; rows that repeat count each time; ids may be null or repeat
(they only serve as pointers); an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weekloom.llm.common import partitions, release_memory, stored
from weekloom.llm.wordarrays import BREAK, SPACE, WordArrays, chunks

UNKNOWN = "und"
#: Bytes of text whose words are held as arrays at once (more only for one longer text), and counted fingerprints held.
CHUNK_BYTES, HELD = 4 << 20, 4_000_000
#: Bits of a bit table: 32 an entry, between these bounds; the larger one, 128 MB, bounds what is broadcast.
LEAST_BITS, MOST_BITS = 20, 30
SLICE = 32_768

WORD_BASE, PHRASE_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[list(b".,;:!?\x0a\x0b\x0c\x0d")] = BREAK
_BYTES[ord("\t")] = SPACE


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of a fingerprint over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Polynomials:
    """Prefix polynomials modulo 2**64 of an odd base; keeps the powers and their inverses."""

    def __init__(self, base: int):
        self.bases, self.powers = (base, pow(base, -1, 1 << 64)), [np.ones(1, np.uint64)] * 2

    def prefix(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums before each place, and the inverse powers that shift a difference back to its start."""
        if len(self.powers[0]) <= len(values):
            size = 1 << max(10, len(values).bit_length())
            for i, base in enumerate(self.bases):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                self.powers[i] = np.cumprod(p, dtype=np.uint64)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[0][: len(values)], dtype=np.uint64, out=total[1:])
        return total, self.powers[1]


class Words(WordArrays):
    """Words of some texts with their fingerprints, in which the language has a part."""

    def __init__(self, texts: list[bytes], langs: list[str], of_word: Polynomials, of_phrase: Polynomials):
        super().__init__(texts, _BYTES)
        self.langs, self.lang = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
        seeds = np.array([_seed(str(x)) for x in self.langs], np.uint64)
        self.hashes = np.zeros(0, np.uint64)
        if len(self.dictionary):
            _, at, data = self.dictionary.buffers()
            at = np.frombuffer(at, np.int32)[: len(self.dictionary) + 1]
            total, inverse = of_word.prefix(np.frombuffer(data, np.uint8)[: at[-1]].astype(np.uint64) + np.uint64(1))
            words = _mixed((total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]])
            self.hashes = _mixed(words[self.ids] ^ seeds[self.lang[self.text]])
        self.total, self.inverse = of_phrase.prefix(self.hashes)

    def prints(self, n: int, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the n-grams that start at ``at``."""
        if n == 1:
            return self.hashes[at]
        return _mixed((self.total[at + n] - self.total[at]) * self.inverse[at] + np.uint64(n))

    def starts(self, n: int, allowed: np.ndarray | None = None, span: int = 1) -> np.ndarray:
        """Where n-grams inside one piece start; ``allowed`` marks parts of ``span`` words that all must hold."""
        size = len(self.ids) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        good = self.piece[:size] == self.piece[n - 1 :]
        if allowed is not None:
            for k in range(n - span + 1):
                good &= allowed[k : k + size]
        return np.flatnonzero(good)


class Bits:
    """A bit table of fingerprints."""

    def __init__(self, bits: int, data: np.ndarray):
        self.mask, self.data = np.uint64((1 << bits) - 1), data

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = prints & self.mask
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _chunks(batches):
    """Words and ids of the rows, ``CHUNK_BYTES`` of text at once."""
    polynomials = Polynomials(WORD_BASE), Polynomials(PHRASE_BASE)
    for rows in chunks(batches, CHUNK_BYTES):
        ids, texts, langs = zip(*rows, strict=True)
        yield Words(list(texts), list(langs), *polynomials), ids


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


PACKED = "bucket int, lang string, n long, prints binary, counts binary"
PRINTS = "lang string, print long, n long"


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, the lowest bytes of all first: Spark's shuffle compresses the empty high ones away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bounds(buckets: int) -> np.ndarray:
    """Fingerprints where the buckets after the first begin: equal parts of all 64-bit numbers."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _counter(select, buckets: int):
    """For mapInArrow: counted fingerprints that ``select(words)`` yields, packed by bucket, and the words of each language."""

    def rows(keys, counts):
        edges = [0, *np.searchsorted(keys, _bounds(buckets)).tolist(), len(keys)]
        out = []
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            if hi > lo:
                steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                out.append((k, None, None, _planes(steps), _planes(counts[lo:hi].astype(np.int64))))
        return packed(out)

    def packed(out):
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.record_batch(cols, ["bucket", "lang", "n", "prints", "counts"])

    def run(batches):
        held, size, words_of = [], 0, {}
        for words, _ in _chunks(batches):
            of_lang = np.bincount(words.lang[words.text], minlength=len(words.langs))
            for lang, n in zip(words.langs.tolist(), of_lang.tolist(), strict=True):
                words_of[lang] = words_of.get(lang, 0) + n
            for prints in select(words):
                if len(prints):
                    held.append(_added([(prints, np.ones(len(prints), np.int64))]))
                    size += len(held[-1][0])
            if size >= HELD:
                held = [_added(held)]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*_added(held))
        if words_of:
            yield packed([(-1, lang, n, None, None) for lang, n in words_of.items()])
        del held
        release_memory()

    return run


def _adder(min_count: int):
    """For applyInArrow over one bucket: its fingerprints that reach ``min_count`` in all tasks together."""

    def run(table: pa.Table) -> pa.Table:
        langs, totals = table.column("lang").to_pylist(), table.column("n").to_pylist()
        parts, sums = [], {}
        for lang, n, prints, counts in zip(langs, totals, *(table.column(c).to_pylist() for c in ("prints", "counts")), strict=True):
            if prints is None:
                sums[lang] = sums.get(lang, 0) + n
            else:
                parts.append((np.cumsum(_from_planes(prints, np.uint64), dtype=np.uint64), _from_planes(counts, np.int64)))
        keys, counts = _added(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        kept = counts >= min_count
        keys, counts = keys[kept].view(np.int64), counts[kept]
        return pa.table({
            "lang": pa.array([*sums, *[None] * len(keys)], pa.string()),
            "print": pa.array([*[None] * len(sums), *keys.tolist()], pa.int64()),
            "n": pa.array([*sums.values(), *counts.tolist()], pa.int64()),
        })

    return run


def _counted(texts: DataFrame, select, min_count: int, name: str) -> DataFrame:
    """Fingerprints found ``min_count`` times or more; rows without one hold the words of a language.

    A task sends one row of packed, sorted fingerprints to each bucket; a bucket is as large as a shuffle partition.
    """
    sent = texts.mapInArrow(_counter(select, partitions(texts.sparkSession)), PACKED)
    return stored(sent.groupBy("bucket").applyInArrow(_adder(min_count), PRINTS), name)


def _bit_table(frequent: DataFrame):
    """The bit table of the fingerprints in a broadcast variable; Spark sets the bits, the driver lays slices of 4 KB side by side."""
    spark = frequent.sparkSession
    found = frequent.where(F.col("print").isNotNull())
    bits = min(MOST_BITS, max(LEAST_BITS, int(found.count() * 32).bit_length()))
    at = F.col("print").bitwiseAND(F.lit((1 << bits) - 1))
    place = found.select(F.floor(at / SLICE).alias("slice"), (at % SLICE).alias("bit"))
    data = np.zeros((1 << bits) // 8, np.uint8)
    width = SLICE // 8
    for row in place.groupBy("slice").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        data[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast((bits, data))


def _every_word(words: Words):
    yield words.hashes


def _pairs(word_bits):
    def select(words: Words):
        good = Bits(*word_bits.value).has(words.hashes)
        yield words.prints(2, words.starts(2, good))

    return select


def _frequent_pairs(words: Words, word_bits: Bits, pair_bits: Bits) -> np.ndarray:
    """At each word: whether a pair that starts here can be frequent."""
    good = np.zeros(len(words.ids), bool)
    at = words.starts(2, word_bits.has(words.hashes))
    good[at[pair_bits.has(words.prints(2, at))]] = True
    return good


def _longer(word_bits, pair_bits, longest: int):
    def select(words: Words):
        pairs = _frequent_pairs(words, Bits(*word_bits.value), Bits(*pair_bits.value))
        for n in range(3, longest + 1):
            yield words.prints(n, words.starts(n, pairs, 2))

    return select


FOUND = ("lang", "phrase", "n_words", "n", "first_doc", "first_word")


def _found_types(id_type: pa.DataType) -> list[pa.DataType]:
    return [pa.string(), pa.binary(), pa.int32(), pa.int64(), id_type, pa.int64()]


def _verified(word_bits, pair_bits, long_bits, longest: int, id_type: pa.DataType, buckets: int):
    """For mapInArrow: phrases with a frequent fingerprint, counted by their text, with the first occurrence; lists by bucket."""

    def run(batches):
        found: dict[tuple[str, bytes], list] = {}
        one, two, more = (Bits(*b.value) for b in (word_bits, pair_bits, long_bits))

        def rows():
            by_bucket: list[list] = [[] for _ in range(buckets)]
            for (lang, phrase), made in found.items():
                by_bucket[zlib.crc32(phrase) % buckets].append((lang, phrase, *made))
            cols = [pa.array([k for k, x in enumerate(by_bucket) if x], pa.int32())]
            for k, kind in enumerate(_found_types(id_type)):
                cols.append(pa.array([[r[k] for r in x] for x in by_bucket if x], pa.list_(kind)))
            return pa.record_batch(cols, ["bucket", *FOUND])

        for words, ids in _chunks(batches):
            pairs = _frequent_pairs(words, one, two)
            vocabulary, langs = words.dictionary.to_pylist(), words.langs.tolist()
            lang = words.lang[words.text]

            def add(at, n, count, words=words, langs=langs, lang=lang, ids=ids, vocabulary=vocabulary):
                text = int(words.text[at])
                key = (langs[lang[at]], b" ".join([vocabulary[i] for i in words.ids[at : at + n].tolist()]))
                if (known := found.get(key)) is None:
                    found[key] = [n, count, ids[text], int(at - words.first[text])]
                else:
                    known[1] += count

            for n in range(1, longest + 1):
                if n == 1:
                    at = np.flatnonzero(one.has(words.hashes))
                elif n == 2:
                    at = np.flatnonzero(pairs)
                else:
                    at = words.starts(n, pairs, 2)
                    at = at[more.has(words.prints(n, at))]
                if not len(at):
                    continue
                _, first, group = np.unique(words.prints(n, at), return_index=True, return_inverse=True)
                origin = at[first[group]]
                same = lang[at] == lang[origin]
                for k in range(n):
                    same &= words.ids[at + k] == words.ids[origin + k]
                counts = np.bincount(group[same], minlength=len(first))
                for place, count in zip(at[first].tolist(), counts.tolist(), strict=True):
                    add(place, n, count)
                for place in at[~same].tolist():  # another phrase with the same fingerprint
                    add(place, n, 1)
            if len(found) >= HELD // 8:
                yield rows()
                found.clear()
        if found:
            yield rows()
        release_memory()

    return run


def _phrase_adder(min_count: int, id_type: pa.DataType):
    """For applyInArrow over one bucket: its phrases that reach ``min_count`` in all tasks together."""

    def run(table: pa.Table) -> pa.Table:
        found: dict[tuple, list] = {}
        place = lambda doc, word: (doc is not None, doc, word)  # noqa: E731  ids in order, none before all
        for row in range(table.num_rows):
            lists = [table.column(c)[row].values.to_pylist() for c in FOUND]
            for lang, phrase, n_words, n, doc, word in zip(*lists, strict=True):
                if (known := found.get((lang, phrase))) is None:
                    found[lang, phrase] = [n_words, n, doc, word]
                else:
                    known[1] += n
                    if place(doc, word) < place(*known[2:]):
                        known[2:] = doc, word
        kept = [(*key, *made) for key, made in found.items() if made[1] >= min_count]
        cols = zip(*kept, strict=True) if kept else [[]] * len(FOUND)
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, _found_types(id_type), strict=True)], list(FOUND))

    return run


def frequent_phrases(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_count: int = 100, longest: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words found ``min_count`` times or more in a language, and the words of each.

    First table: lang, phrase, n_words, n, first_doc, first_word (the first occurrence by id and word, from 0).
    Second: lang, words. Both are stored.
    """
    texts = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang")
    )
    singles = _counted(texts, _every_word, min_count, "words")
    one = _bit_table(singles)
    two = _bit_table(_counted(texts, _pairs(one), min_count, "pairs"))
    more = _bit_table(_counted(texts, _longer(one, two, longest), min_count, "longer"))
    kind = texts.schema["id"].dataType
    types = dict(zip(FOUND, ("string", "binary", "int", "long", kind.simpleString(), "long"), strict=True))
    packed = ", ".join(["bucket int", *(f"{c} array<{t}>" for c, t in types.items())])
    arrow_id = to_arrow_type(kind)
    seen = texts.mapInArrow(_verified(one, two, more, longest, arrow_id, partitions(texts.sparkSession)), packed)
    phrases = seen.groupBy("bucket").applyInArrow(_phrase_adder(min_count, arrow_id), ", ".join(f"{c} {t}" for c, t in types.items()))
    phrases = stored(phrases.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    return phrases, singles.where(F.col("print").isNull()).select("lang", F.col("n").alias("words"))


def _part(start, size):
    """``size`` words of a phrase from word ``start`` (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


#: Each language is ranked in this many parts first; ``top`` rows of each go on.
SALTS = 64


def collocations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_count: int = 100, longest: int = 5, top: int = 2000,
) -> DataFrame:
    """The ``top`` best collocations of each language; module docstring for the method and odd rows.

    A phrase of 2 or more words scores ``floor(1000 * a * n / (l * r))`` at the cut into two parts where that is
    smallest. A phrase that never stands outside a longer frequent one is left out. Integers of up to 38
    digits make the scores exact. Ties go by count, then by the phrase's bytes.
    """
    phrases, totals = frequent_phrases(docs, id_col, text_col, lang_col, min_count, longest)
    whole = phrases.where("n_words > 1")
    size = F.col("n_words")
    cuts = whole.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("head", _part(F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("k") + 1, size - F.col("k")))
    counts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.withColumn("above", F.lit(1000).cast("decimal(4,0)") * (big("n") * big("words"))).withColumn("below", big("l") * big("r"))
    scored = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "n_words", "n", "words", "first_doc", "first_word")
    best = scored.agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = F.expr(
        "flatten(transform(sequence(2, n_words - 1), s -> transform(sequence(1, n_words - s + 1),"
        " b -> array_join(slice(split(phrase, ' '), b, s), ' '))))"
    )
    parts = whole.where("n_words > 2").select("lang", "n", F.explode(spans).alias("phrase"))
    parts = parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(parts, ["lang", "phrase"], "left").where("longer IS NULL OR longer < n")
    flat = kept.select(
        "lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("words").alias("n"),
        F.col("cut.score").alias("score"), "first_doc", "first_word",
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    for by in (["lang", "salt"], ["lang"]):
        ranked = flat.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        flat = ranked.where(F.col("rank") <= top).drop("salt", *(["rank"] if len(by) > 1 else []))
    return flat.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc", "first_word")
