"""Line-first cleaning: rules on lines, failing lines removed, then a verdict on what is left.

Every line is judged by itself: navigation (menus of short items between bars or arrows),
symbols (decoration), shouting, stutter (words said again at once), boilerplate phrases, and missing punctuation on stubs. Lines
that fail are removed. A document is rejected when its base counts fail or when the removed
lines held more than ``max_lost`` of its word characters.

One pass without a shuffle: every document is judged from its own text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weekloom.llm.common import SPACES, arrow_map, id_text

SYMBOLS = b"#*$%&|<>"

#: Fixed phrases of site furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "subscribe to our newsletter",
    "enable javascript",
    "click here",
    "lorem ipsum",
    "share on facebook",
    "sign up for",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    nav_separators: int = 3
    nav_words_per_item: float = 3.0
    symbol_share: float = 0.10
    caps_share: float = 0.7
    stub_words: int = 2
    stutter_share: float = 0.3
    max_lost: float = 0.5


END_MARKS = (".", "!", "?", ":", ";", "…", '"', "'", ")", "”", "»", "。", "！", "？")
_SEPARATOR = re.compile(r"[|»›>•·]")
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)))
_MARKS = re.compile(r"[#*$%&<>]|!!")


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    # Words are numbered within the text; 64-bit keys of windows by a multiplicative roll.
    key = np.zeros(n - window + 1, dtype=np.uint64)
    for i in range(window):
        key = (key + ids[i : n - window + 1 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(key, np.unique(twice)))
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return int((np.cumsum(mark)[:n] > 0).sum())


def line_fails(line: str, rules: LineRules = LineRules()) -> str | None:
    """Name of the first rule that the line breaks; None for a good line."""
    stripped = line.strip()
    words = stripped.split()
    if not words:
        return None
    bars = len(_SEPARATOR.findall(stripped))
    if bars >= rules.nav_separators and len(words) <= rules.nav_words_per_item * (bars + 1):
        return "navigation"
    marks = len(_MARKS.findall(stripped))
    if marks and marks >= rules.symbol_share * len(stripped) or marks > len(words) / 2:
        return "symbols"
    letters = sum(map(str.isalpha, stripped)) if stripped.upper() == stripped else 0
    if letters and len(words) >= 3 and letters >= rules.caps_share * len("".join(words)):
        return "shouting"
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    if stutters >= 3 and stutters > rules.stutter_share * len(words):
        return "stutter"
    low = stripped.lower()
    if _PHRASES.search(low):
        return "boilerplate"
    if len(words) <= rules.stub_words and not stripped.endswith(END_MARKS) and not stripped[-1].isdigit():
        return "stub"
    return None


def clean(text: str, rules: LineRules = LineRules()) -> tuple[str, int, int]:
    """The text without failing lines, the number of these, and the word characters they held."""
    kept, dropped, lost = [], 0, 0
    for line in text.split("\n"):
        if line_fails(line, rules) is None:
            kept.append(line)
        else:
            dropped += 1
            lost += len("".join(line.split()))
    return "\n".join(kept), dropped, lost


def assess(text: str, rules: LineRules = LineRules()) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.encode("utf-8", "surrogatepass").strip():
            seen.add(line)
    n = len(words)
    repeats = repeat_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    cleaned, dropped, lost = clean(text, rules)
    keep = not failed and lost <= rules.max_lost * max(1, word_chars)
    return n, word_chars, n_symbols, dups, repeats, failed, keep, dropped, lost, cleaned


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_dropped_lines long, lost_chars long"
)
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")[1:]] + ["clean_text"]


def _assessor(rules: LineRules, with_text: bool):
    def of_batch(batch):
        rows = [assess(t, rules) for t in batch.column(1).to_pylist()]
        width = len(_TYPES) - (not with_text)
        columns = [pa.array([r[i] for r in rows], _TYPES[i]) for i in range(width)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_NAMES[:width]])

    return of_batch


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = False
) -> DataFrame:
    """One row per document with its counts and the verdict; ``with_text`` adds the cleaned text.

    A null or empty text has no words and fails. Repeated rows are judged one by one, a null id is
    carried along, columns other than the two named are not read.
    """
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    schema = SCHEMA.replace("doc_id long", f"doc_id {kind}", 1) + (", clean_text string" if with_text else "")
    return rows.mapInArrow(arrow_map(_assessor, rules, with_text), schema)


def _filter(rules: LineRules):
    def of_batch(batch):
        texts = batch.column("text").to_pylist()
        kept, at = [], []
        for i, text in enumerate(texts):
            row = assess(text or "", rules)
            if row[6]:
                kept.append(row[9])
                at.append(i)
        batch = batch.take(pa.array(at, pa.int64()))
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))

    return of_batch


def cleaned_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, all columns as they are, with ``text`` cleaned."""
    return docs.mapInArrow(arrow_map(_filter, rules), docs.schema)
