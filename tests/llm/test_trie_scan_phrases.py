import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from weekloom.llm import collocations, licenses, prefix_trie, ranking
from weekloom.llm.wordarrays import WordArrays

TURNS = "conv_id long, turn long, role string, text string, key string, position long, dist long, i string"


# --- prefix trie -----------------------------------------------------------------------

def talk(seed=3, n=160):
    """Conversations with shared starts, copies, ties, null turns, roles, texts and ids, repeated rows, missing bases."""
    rng = random.Random(seed)
    words = ["hi", "HELLO", "wie geht's", "", None, "x" * 70 + "a", "x" * 70 + "b", "日本"]
    rows = []
    for c in rng.sample(range(460), n):
        if c // 100 == 3 and c % 100 == 0:
            continue  # no base for 301 .. 399
        for turn in range(rng.choice((1, 2, 3, 5, 9))):
            rows.append((c, turn if rng.random() < 0.8 else rng.choice((None, 1, 1)), rng.choice(("user", "assistant", None)), rng.choice(words)))
    for c in (100, 200, 1200):
        rows += [(c, t, "user", f"base {t % 2}") for t in range(7)]
    for c in (1201, 1205, 1210):  # copies of one long talk
        rows += [(c, t, "user", "same") for t in range(40)]
    rows += [(1300, None, None, None)] * 3 + [(1301, 0, "user", "only")] + [(None, 0, "user", "lost")] * 2
    return [(*r, "k", 5, 6, "z") for r in rows]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(m) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (
            m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def test_trie_by_brute_force(spark):
    rows = talk()
    found = plain(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)))
    assert found == sorted(brute_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_in_small_chunks(spark, monkeypatch):
    """Lists of many stretches, sums of several levels, ids in many blocks."""
    monkeypatch.setattr(ranking, "SMALL", 40)
    monkeypatch.setattr(ranking, "CHUNK", 6)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 2)
    rows = talk(8, 40)
    found = plain(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3)))
    assert found == sorted(brute_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    lost = spark.createDataFrame([(None, 0, "user", "x", "", 0, 0, "")], TURNS)
    assert prefix_trie.prefix_trie(lost).count() == 0


@pytest.mark.parametrize("size", [1, 7, 700])
def test_list_rank(spark, monkeypatch, size):
    monkeypatch.setattr(ranking, "SMALL", 50)
    order = [0, *random.Random(size).sample(range(1, size), size - 1)]
    arcs = spark.createDataFrame([(a, b, 1) for a, b in zip(order, [*order[1:], -1], strict=True)], "arc long, to long, dist long")
    assert {r.arc: r.position for r in ranking.list_rank(arcs).collect()} == {a: i for i, a in enumerate(order)}


# --- license scan ----------------------------------------------------------------------

def brute_scan(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    more, best = set(), 0.0
    for _, label, band, needed, own in licenses.template_rows(licenses.TEMPLATES, licenses.PERCENT):
        for lo in range(0, max(1, len(ws)), band):
            held = len(set(ws[lo : lo + 2 * band]) & set(own))
            if held >= needed:
                more.add(label)
                best = max(best, held / len(own))
    base = ",".join(sorted(labels))
    return (len(ws), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels | more)), 1.0 if places else best)


def notices():
    rng = random.Random(5)
    filler = ["lorem", "the", "of", "License", "licensed", "under", "x1", "ünder", "and", "software", "4.0"]
    rows = [(0, None), (1, ""), (2, "...---"), (3, "MIT License, the Apache\tLICENSE and General Public\n License; mit license")]
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for drop in (0, 1, 2, 5):
            kept = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), drop)]
            mixed = [rng.choice(filler) for _ in range(rng.randrange(60))] + kept + [rng.choice(filler) for _ in range(rng.randrange(60))]
            rows.append((100 + 10 * k + drop, " ".join(mixed)))
    rows.append((500, " ".join(rng.choice(filler) for _ in range(5000)) + " released under the mit license " + "word " * 5000))
    rows += [(500, "apache license"), (None, "general public license"), (None, None), (501, " ".join(t for _, t in licenses.TEMPLATES))]
    return rows


def test_scan_by_brute_force(spark):
    rows = notices()
    docs = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], "doc_id long, text string, row string, word string, band int")
    key = lambda r: (r[0] is not None, r[0] or 0, repr(r[1:]))
    found = sorted((tuple(r) for r in licenses.license_labels(docs.repartition(3)).collect()), key=key)
    assert found == sorted(((i, *brute_scan(t)) for i, t in rows), key=key)


def test_scan_leaves_other_families_alone():
    for label, text in licenses.TEMPLATES:
        assert brute_scan(text)[5] == label


def test_scan_of_nothing(spark, nothing, corpus):
    assert licenses.license_labels(nothing).count() == 0
    found = licenses.license_labels(corpus).collect()
    assert len(found) == corpus.count() and {r.labels for r in found} == {""} and {r.score for r in found} == {0.0}


# --- collocations ----------------------------------------------------------------------

def brute_collocations(rows, min_count, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    whole = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, p), a in whole.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    by = defaultdict(list)
    for (lang, p), a in whole.items():
        if longer[lang, p] >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang, found in by.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def spoken():
    rng = random.Random(11)
    rows = []
    words = ["a", "B", "ß", "c\x00", "long-word", "\x1c", "e"]
    for i in range(120):
        text = " ".join(rng.choice(words) + rng.choice(("", "", "", ",", "\n", "\t", ". ")) for _ in range(rng.randrange(80)))
        rows.append((i % 50, text + " new york city hall " * (i % 3), rng.choice(("en", "de", None, "und"))))
    rows += [(None, None, "en"), (1, "", None), (2, " ,. \t", "de"), rows[5], rows[5]]
    return rows


def numbers(df):
    return sorted(tuple(r) for r in df.drop("first_doc", "first_word").collect())


def test_collocations_by_brute_force(spark):
    rows = spoken()
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "doc_id long, text string, lang string, phrase string, n long, print long")
    for top in (2000, 7):
        assert numbers(collocations.collocations(docs.repartition(3), min_count=8, top=top)) == brute_collocations([r[1:] for r in rows], 8, top)


def test_shared_fingerprints_change_no_count(spark, monkeypatch):
    """Fingerprints of 4 bits and bit tables that let all pass: the text still decides."""
    rows = spoken()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(collocations, "_mixed", lambda h: h & np.uint64(15))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(collocations, "HELD", 100)
    assert numbers(collocations.collocations(docs, min_count=8)) == brute_collocations([r[1:] for r in rows], 8, 2000)


def test_first_occurrence(spark):
    docs = spark.createDataFrame([(7, "x new york", "en"), (3, "y, z new york", "en")], "doc_id long, text string, lang string")
    found = collocations.collocations(docs, min_count=2).collect()
    assert [(r.phrase, r.first_doc, r.first_word) for r in found] == [("new york", 3, 2)]


def test_collocations_of_nothing(nothing):
    assert collocations.collocations(nothing).count() == 0


def test_word_arrays_cut_at_texts():
    words = WordArrays([b"ab c.d", b"", b"e", b"f  g"], collocations._BYTES)
    assert [words.dictionary[int(i)].as_py() for i in words.ids] == [b"ab", b"c", b"d", b"e", b"f", b"g"]
    assert words.text.tolist() == [0, 0, 0, 2, 3, 3] and words.size.tolist() == [3, 0, 1, 2]
    assert words.piece[1] != words.piece[2] != words.piece[3] != words.piece[4] == words.piece[5]
