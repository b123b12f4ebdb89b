"""Every stage of the pipeline against brute force on its own input."""

import corpus_pipeline as P
import pytest
from weekloom.llm import linededup, quality


def line_rule(rows, min_chars=40, min_docs=5):
    holders = {}
    for r in rows:
        for line in r.text.split("\n"):
            key = linededup.line_key(line)
            if len(key.decode()) >= min_chars and r.doc_id is not None:
                holders.setdefault(key, set()).add(r.doc_id)
    out = []
    for r in rows:
        kept = [
            x for x in r.text.split("\n") if r.doc_id is None or len(h := holders.get(linededup.line_key(x), ())) < min_docs or max(h) == r.doc_id
        ]
        out.append((r.doc_id, "\n".join(kept)))
    return out


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def order(pairs):
    return sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_stages(name, request, spark):
    docs = request.getfixturevalue(name)
    before = docs.collect()
    for stage, fn in P.STAGES[:-1]:
        out = fn(spark, docs, "").cache()
        assert tuple(out.columns) == P.COLUMNS
        rows = out.collect()
        got = order((r.doc_id, r.text) for r in rows)
        if stage == "language":
            letters = lambda t: bool(t) and any(c.isalpha() for c in t)
            assert got == order((r.doc_id, r.text) for r in before if letters(r.text))
        elif stage == "quality":
            judged = [(r.doc_id, quality.assess(r.text)) for r in before]
            assert got == order((i, a[9]) for i, a in judged if a[6])
        elif stage == "line_dedup":
            assert got == order((i, t) for i, t in line_rule(before) if t.strip(" \t\n\r\x0b\x0c"))
        else:
            sets = [(r.doc_id, shingle_set(r.text)) for r in before if r.doc_id is not None]
            parents = {i: i for i, _ in sets}  # the smallest id of a component stays
            for i, a in sets:
                for j, b in sets:
                    if i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                        x, y = i, j
                        while parents[x] != x:
                            x = parents[x]
                        while parents[y] != y:
                            y = parents[y]
                        parents[max(x, y)] = min(x, y)
            gone = {i for i in parents if parents[i] != i}
            assert got == order((r.doc_id, r.text) for r in before if r.doc_id not in gone)
        if stage in ("quality", "line_dedup"):
            assert all(r.n_chars == len(r.text) for r in rows)
        docs, before = out, rows
    packed = P.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before}


def test_stages_of_nothing(nothing, spark):
    docs = nothing
    for _, fn in P.STAGES:
        docs = fn(spark, docs, "")
    assert docs.count() == 0
