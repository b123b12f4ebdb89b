"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds a bounded sample of labelled text. A document is parsed
into longest matches against each automaton: a phrase ends where no path goes on. The language
that needs the fewest phrases per character wins.

The sample is bounded: ``pieces`` short passages per language, each from another document, and at
most ``total_chars`` characters in all languages together. The automata are fitted on the driver
and broadcast; their size follows from these parameters alone. Documents are parsed whole, in
segments that a task walks in lockstep with array operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import arrow_map
from weekloom.llm.lm import crc_share

UNDETERMINED = "und"
PAD, GAP, OTHER = 0, 1, 2
SEGMENT = 512
LANES = 16384
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangSettings:
    """Bounds of the sample."""

    pieces: int = 256
    piece_chars: int = 256
    total_chars: int = 256 << 10
    max_languages: int = 512


def byte_classes(texts: list[str]) -> np.ndarray:
    """Class of each byte: letters by themselves, all else that is ASCII a gap, high bytes if seen."""
    classes = np.full(256, OTHER, dtype=np.uint8)
    classes[:128] = GAP
    classes[ord("a") : ord("z") + 1] = np.arange(3, 29)
    seen = sorted({b for t in texts for b in t.lower().encode("utf-8", "replace") if b >= 128})
    classes[seen] = np.arange(29, 29 + len(seen))
    return classes


def codes_of(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, runs of gaps made one, and where each text starts (and the end)."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    codes = classes[np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)]
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    gap = codes == GAP
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)])]
    return codes[keep], ends


def suffix_automaton(codes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def parse_table(pieces: list[str], classes: np.ndarray) -> np.ndarray:
    """Next state (times the width) and, in the lowest bit, whether a phrase ended; by state and class.

    Pieces are joined by a class that no text has, so no phrase runs from one piece into the next.
    """
    width = int(classes.max()) + 1
    joined: list[int] = []
    for piece in pieces:
        codes, _ = codes_of([piece], classes)
        joined += codes.tolist()
        joined.append(PAD)
    moves = suffix_automaton(joined)
    table = np.zeros((len(moves), width), dtype=np.int64)
    known = np.zeros((len(moves), width), dtype=bool)
    for state, out in enumerate(moves):
        if out:
            to = list(out)
            table[state, to] = list(out.values())
            known[state, to] = True
    table = np.where(known, table * width << 1, (table[0] * width << 1) | 1)
    table[:, PAD] = (np.arange(len(moves)) * width) << 1  # padding stays where it is
    return table.astype(np.int32).ravel()


@dataclass
class LangModel:
    languages: list[str]
    classes: np.ndarray
    tables: list[np.ndarray]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per language (rows: texts) and characters of each text."""
        codes, starts = codes_of(texts, self.classes)
        size = np.diff(starts)
        number = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), number)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        at = starts[:-1][owner] + inside * SEGMENT
        left = np.minimum(SEGMENT, size[owner] - inside * SEGMENT)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes, np.zeros(SEGMENT, np.uint8)]), SEGMENT)
        found = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for lo in range(0, len(owner), LANES):
            lanes = windows[at[lo : lo + LANES]]
            lanes[np.arange(SEGMENT) >= left[lo : lo + LANES, None]] = PAD
            steps = np.ascontiguousarray(lanes.T).astype(np.int32)
            for k, table in enumerate(self.tables):
                state = np.zeros(steps.shape[1], dtype=np.int32)
                count = np.ones(steps.shape[1], dtype=np.int32)
                for step in steps:
                    state += step
                    np.take(table, state, out=state, mode="clip")
                    count += state & 1
                    state >>= 1
                np.add.at(found[:, k], owner[lo : lo + LANES], count)
        return found, size

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and the share by which the best one beats the second."""
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        found, size = self.phrases([t or "" for t in texts])
        best = found.argmin(axis=1)
        rate = np.sort(found / np.maximum(size, 1)[:, None], axis=1)
        margin = 1 - rate[:, 0] / np.maximum(rate[:, 1], 1e-12) if len(self.languages) > 1 else np.ones(len(texts))
        langs, scores = [], []
        for text, b, m in zip(texts, best.tolist(), np.clip(margin, 0, 1).tolist(), strict=True):
            letters = text is not None and any(x.group().isalpha() for x in _LETTER.finditer(text))
            langs.append(self.languages[b] if letters else UNDETERMINED)
            scores.append(m if letters else 0.0)
        return langs, scores


def sample(rows: DataFrame, settings: LangSettings) -> dict[str, list[str]]:
    """Bounded passages by language. ``rows``: doc_id, text, lang; only rows with all of text and lang count.

    Documents are drawn by hash: the smallest of each of ``pieces`` hash buckets, so counts meet
    before rows move and no language is gathered in one task.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(settings.pieces)))
    least = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    languages = sorted(r[0] for r in least.select("lang").distinct().limit(settings.max_languages + 1).collect())
    if len(languages) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    n = settings.piece_chars
    start = F.pmod(F.shiftright("h", 8), F.greatest(F.lit(1), F.length("text") - n + 1).cast("long")).cast("int") + 1
    # At most pieces * max_languages rows of two short columns.
    picked = rows.join(F.broadcast(least), ["lang", "bucket", "h"]).select("lang", "bucket", F.substring("text", start, F.lit(n)).alias("piece"))
    found: dict[str, list[str]] = {x: [] for x in languages}
    share = settings.total_chars // max(1, len(languages))
    taken = picked.groupBy("lang", "bucket").agg(F.max("piece").alias("piece")).collect()
    for lang, _, piece in sorted(taken):
        if sum(map(len, found[lang])) + len(piece) <= share:
            found[lang].append(piece)
    return {k: v for k, v in found.items() if v}


def fit(rows: DataFrame, settings: LangSettings = LangSettings()) -> LangModel:
    pieces = sample(rows, settings)
    classes = byte_classes([p for v in pieces.values() for p in v])
    return LangModel(list(pieces), classes, [parse_table(v, classes) for v in pieces.values()])


def _predictor(shared, keep_text):
    model = LangModel(*shared.value)

    def of_batch(batch):
        langs, scores = [], []
        texts = batch.column("text").to_pylist()
        for lo in range(0, len(texts), 2048):
            a, b = model.predict(texts[lo : lo + 2048])
            langs += a
            scores += b
        names = [n for n in batch.schema.names if keep_text or n != "text"]
        columns = [batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
        )

    return of_batch


def predict(docs: DataFrame, model: LangModel, keep_text: bool = False) -> DataFrame:
    """``docs``: text and further columns, which stay; adds lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.classes, model.tables))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if keep_text or n != "text") + ", lang_pred string, score double"
    return docs.mapInArrow(arrow_map(_predictor, shared, keep_text), schema)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: tuple[int, int] = (5, 0),
    settings: LangSettings = LangSettings(),
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; held-out rows are never learned from.

    A null text or one without a letter is ``und`` with score 0, as is everything where nothing could
    be learned. Ties go to the first language in the alphabet. Repeated rows are judged one by one;
    a null id is not held out. Columns other than the three named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", crc_share("doc_id", *fold))
    model = fit(rows.where(~F.col("held_out")), settings)
    return predict(rows.select("doc_id", "held_out", "text"), model)
