import hashlib
import random

import pytest
from weekloom.llm import html_text, langid, linededup, merkle, quality


def test_line_rules():
    fails = quality.line_fails
    assert fails("Home | About | News | Contact") == "navigation"
    assert fails("One*** two### three$$$ four&&&") == "symbols"
    assert fails("STOP SHOUTING AT US") == "shouting"
    assert fails("All rights reserved by nobody in particular.") == "boilerplate"
    assert fails("go go go go go on") == "stutter"
    assert fails("Menu") == "stub"
    assert fails("A plain sentence, as most are.") is None
    assert fails("") is None


def test_repeat_words_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert quality.repeat_words(words) == len(hit)


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_quality_counts(name, request):
    docs = request.getfixturevalue(name)
    rows = quality.quality_rules(docs, with_text=True).collect()
    texts = [r.text or "" for r in docs.collect()]
    assert len(rows) == len(texts)
    known = {}
    for r in docs.collect():
        known.setdefault(r.doc_id, []).append(r.text or "")
    for r in rows:
        text = known[r.doc_id][0]
        words = text.encode().split()
        if len(known[r.doc_id]) == 1:
            assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
            assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
            lines = text.split("\n")
            assert r.n_dup_lines == sum(bool(x.strip(" \t\n\r\x0b\x0c")) and x in lines[:i] for i, x in enumerate(lines))
        assert not (r.base_failed and r.kept)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def brute_lines(rows, min_chars=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = linededup.line_key(line)
            if len(key.decode()) >= min_chars and i is not None:
                holders.setdefault(key, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(linededup.line_key(x), ())) < min_docs or max(h) == i]
        out.setdefault(i, []).append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_line_dedup_by_brute_force(name, request):
    docs = request.getfixturevalue(name)
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    for batches, fanout in ((1, 2), (6, 2)):
        found = {}
        for r in linededup.line_dedup(docs, batches=batches, fanout=fanout).collect():
            found.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.kept_text))
        assert {i: sorted(v) for i, v in found.items()} == want
    assert sum(n for v in want.values() for _, n, _ in v) > 5
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_hold_a_hash_once_however_they_are_merged(spark):
    """A line of four documents in several batches and levels counts four, one of five counts five."""
    four = [f"line {k} of more than forty characters that four documents share" for k in range(150)]
    five = [f"line {k} of more than forty characters that five documents share" for k in range(150)]
    rows = [(i, "\n".join([*(four if i % 50 == 7 and i < 200 else []), *(five if i % 50 == 9 else []), f"own line {i} " * 5])) for i in range(250)]
    for batches, fanout in ((4, 3), (6, 2)):
        found = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fanout=fanout)
        assert {r.doc_id: r.n_dropped for r in found.where("n_dropped > 0").collect()} == {i: 150 for i in (9, 59, 109, 159)}


def test_line_dedup_of_nothing(nothing):
    assert linededup.line_dedup(nothing).count() == 0


def test_fingerprints_by_brute_force(corpus):
    rows = sorted((r.doc_id, r.text or "") for r in corpus.collect())
    found = {r.doc_id: r for r in merkle.edited_fingerprints(corpus).collect()}
    assert len(found) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = found[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(text, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert len({v for s in prints.values() for v in s}) == len(prints)


def brute_tree(text):
    """Sections of paragraphs of leaf digests, and the digests above them."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def leaves(paragraph):
        out, last = [], 0
        for at in range(1, len(paragraph) + 1):
            if at > 1 and paragraph[at - 2] in ".!?" and paragraph[at - 1] in " \t\x0b\f\r" or at - last == merkle.LEAF_CHARS:
                out.append(paragraph[last:at])
                last = at
        return [*out, paragraph[last:]]

    tree = [[[md5(x) for x in leaves(p)] for p in s.split("\n")] for s in text.split("\n\n")]
    paragraphs = [[md5("".join(p)) for p in s] for s in tree]
    sections = [md5("".join(s)) for s in paragraphs]
    return tree, paragraphs, sections, hashlib.sha256("".join(sections).encode()).hexdigest()


def brute_likeness(one, other):
    (t1, p1, s1, r1), (t2, p2, s2, r2) = brute_tree(one), brute_tree(other)
    if r1 == r2:
        return 1.0
    empty = hashlib.md5(b"").hexdigest()

    def open_leaves(t, p, s, other_p, other_s):
        mine = [(d, x) for ps, ts, sd in zip(p, t, s, strict=True) if sd not in other_s for d, x in zip(ps, ts, strict=True)]
        theirs = {d for ps, sd in zip(other_p, other_s, strict=True) if sd not in s for d in ps}
        return {x for d, xs in mine if d not in theirs for x in xs if x != empty}

    a, b = open_leaves(t1, p1, s1, p2, s2), open_leaves(t2, p2, s2, p1, s1)
    total = sum(len({x for s in t for p in s for x in p if x != empty}) for t in (t1, t2))
    return max(0.0, 1 - (len(a - b) + len(b - a)) / total) if total else 0.0


def test_tree_and_likeness_by_brute_force(spark):
    rng = random.Random(9)
    words = ["Some words.", "more! ", "and then", "x" * 70, "é?", "", "tail"]
    texts = ["".join(rng.choice(words) + rng.choice((" ", "\n", "\n\n", " ")) for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    texts += ["", "same\n\nsame", "same\n\nsame"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in merkle.edited_fingerprints(docs).collect()}
    roots = {r.doc_id: r.root for r in merkle.fingerprints(docs).select("doc_id", "root").collect()}
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert roots[i] == brute_tree(text)[3]
        assert found[i].near_edited == pytest.approx(brute_likeness(text, edited))
        assert found[i].near_next == pytest.approx(brute_likeness(text, after))
        new, old = brute_tree(edited)[1], brute_tree(text)[1]
        place = next(((a, b) for a, s in enumerate(new) for b, p in enumerate(s) if a >= len(old) or b >= len(old[a]) or old[a][b] != p), (None, None))
        assert (found[i].edited_section, found[i].edited_paragraph) == place


def test_fingerprint_plan_has_no_python(corpus):
    plan = merkle.edited_fingerprints(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fingerprints_of_odd_rows_and_nothing(odd, nothing):
    assert merkle.edited_fingerprints(odd).count() >= odd.count()
    assert merkle.edited_fingerprints(nothing).count() == 0
    assert merkle.fingerprints(nothing).count() == 0


def test_differing_paragraphs_locate_an_edit(spark):
    from pyspark.sql import functions as F

    texts = [(1, "a one.\nb two.\n\nc three.\nd four."), (2, "a one.\nb two.\n\nc three.\nd FOUR.")]
    prints = merkle.fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    one = prints.where("doc_id = 1").select(F.col("paragraphs").alias("x"))
    two = prints.where("doc_id = 2").select(F.col("paragraphs").alias("y"))
    found = one.crossJoin(two).select(merkle.differing_paragraphs(F.col("x"), F.col("y")).alias("d")).first().d
    assert [tuple(x) for x in found] == [(1, 1)]


def test_suffix_automaton_knows_all_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    moves = langid.suffix_automaton(text)

    def known(s):
        at = 0
        for c in s:
            at = moves[at].get(c)
            if at is None:
                return False
        return True

    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for a in range(1, 4):
        for b in range(1, 4):
            for c in range(1, 4):
                assert known((a, b, c)) == ((a, b, c) in subs)
    assert all(known(s) for s in subs)


def test_phrases_by_brute_force():
    sample = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs"]
    classes = langid.byte_classes(sample)
    model = langid.LangModel(["x"], classes, [langid.parse_table(sample, classes)])
    joined = []
    for s in sample:
        joined += [*langid.codes_of([s], classes)[0].tolist(), 0]

    def has(s):
        return any(joined[i : i + len(s)] == s for i in range(len(joined) - len(s) + 1))

    for text in ("the box", "jumps zz over", "qqq", "fox fox fox with dozens of jugs ... 12"):
        codes = langid.codes_of([text], classes)[0].tolist()
        count, start = 1, 0
        for i in range(len(codes)):
            if not has(codes[start : i + 1]):
                count, start = count + 1, i if has(codes[i : i + 1]) else i + 1
        assert model.phrases([text])[0][0, 0] == count


def test_languages_held_out(corpus, corpus_rows):
    found = {r.doc_id: r for r in langid.identify(corpus).collect()}
    truth = {r[0]: (r[1], r[2]) for r in corpus_rows}
    assert len(found) == len(truth)
    good = [found[i].lang_pred == lang for i, (text, lang) in truth.items() if text and len(text) > 100 and lang and i < 60]
    assert sum(good) >= 0.95 * len(good)
    for i in (80, 81, 82, 83, 89):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_of_odd_rows_and_nothing(odd, nothing, spark):
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(unlabelled).first().lang_pred == "und"


PAGES = [
    ("<p>a <b>b</b>\n c<p>d", "a b c\n\nd"),
    ("<ul><li>one<li>two<ul><li>in</ul></ul>", "- one\n- two\n  - in"),
    ("<ol start=3><li>p<li>q</ol>", "3. p\n4. q"),
    ("<table><tr><th>A<th>Bcd<tr><td>1<td>22<tr><td rowspan=2>x<td>y<tr><td>z</table>", "A | Bcd\n--+----\n1 | 22\nx | y\n  | z"),
    ("x<script>if (a<b) y()</script><style>p{}</style><div hidden>no</div><i style='Display: NONE'>no</i>z", "xz"),
    ("<div>one</div>two<br>three", "one\ntwo\nthree"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("&lt;p&gt; &amp; &eacute;<!-- <p>no -->", "<p> & é"),
    ("<blockquote><p>q</blockquote>", "> q"),
    ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("a < b <", "a < b <"),
    ("<p", ""),
    ("", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_rendering(page, text):
    assert html_text.render(page) == text


HEADS = [
    ("<html><head><title>T</title><body><p>Hello</p>", "Hello"),
    ("<head><title>T</title><meta charset=utf-8>\n<p>Hello", "Hello"),
    ("<head><script>x</script> Hello <b>you</b>", "Hello you"),
    ("<HEAD>\n<link rel=x><!-- c --><style>p{}</style>\n<BODY>Hello", "Hello"),
    ("<head><noscript><style>p{}</style><body>Hello", "Hello"),
    ("<head><title>T</title></head><body>Hello<head><p>you", "Hello\n\nyou"),
    ("<head><template><p>no</p></template><title>T</title>", ""),
]


@pytest.mark.parametrize("page,text", HEADS)
def test_head_ends_where_content_starts(page, text):
    assert html_text.render(page) == text


SHOWN = [
    ("<table><p>note</p><tr><td>a<td>b</table>", "note |\na    | b"),
    ("<table><tr><div>note</div><td>a</table>", "note | a"),
    ("<table><tr><form><td>price</td></form></tr></table>", "price"),
    ("<table><form><tr><td>price</td></tr></form></table>", "price"),
    ("<table><tr><span><td>price</td></span></tr></table>", "price"),
    ("<table><tr><td>a</td><input type=hidden><td>b</table>", "a | b"),
    ("<table><thead><b>top</b><tr><td>a</table>", "top\na"),
    ("<table><tr><td>a</td></tr><table><tr><td>b</table>c", "a\n\nb\n\nc"),
    ("<p aria-hidden=true>shown", "shown"),
    ("<select><option>one<option label=two>2<optgroup label=more><option>three</select>x", "one\ntwo\nmore\nthree\nx"),
    ('<div class="a"">one</div><p>two "three"</p>', 'one\n\ntwo "three"'),
    ("<p title=it's>one</p><p>it's</p>", "one\n\nit's"),
    ("<p title='a > b' hidden>no</p><p title = \"<p>\">yes", "yes"),
    ('<p "hidden">shown', "shown"),
    ('<p title="open', ""),
]


@pytest.mark.parametrize("page,text", SHOWN)
def test_all_that_shows_is_rendered(page, text):
    assert html_text.render(page) == text


def test_tables_nested_deep_keep_their_text():
    for rest in ("<table>one<tr>two<td>three", "<table><tr><td>one<td>two<p>three", "<table><p>one</p><tr><div>two</div><td>three"):
        for depth in range(245, 260):
            found = html_text.render("<div>" * depth + rest)
            assert all(x in found for x in ("one", "two", "three")), (depth, rest)


def test_rendering_survives_deep_pages():
    assert html_text.render("<div>" * 50_000 + "deep") == "deep"
    assert "x" in html_text.render("<ul><li>" * 3000 + "x")
    assert html_text.render("<b>" * 3000 + "x" + "</b>" * 3000) == "x"
    assert len(html_text.render("<p>word " * 20_000).split()) == 20_000


def test_page_texts(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "<p>x"), (3, "<p>x")], "page_id long, html string")
    found = sorted((r.page_id or 0, r.text) for r in html_text.page_texts(pages).collect())
    assert found == [(0, "x"), (1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html_text.page_texts(pages.limit(0)).count() == 0


def test_lines_of_documents_with_text_ids(spark):
    line = "A line of more than forty characters that many documents share."
    rows = [(f"d{i}", f"{line}\nown {i}") for i in range(7)] + [(None, line)]
    found = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {f"d{i}": (2, int(i < 6)) for i in range(7)} | {None: (1, 0)}


def test_deeply_nested_cells_render_at_once():
    import time


    began = time.time()
    for cell in ("<table><tr>", "<table><tr><td>", "<table><tr><div>"):
        assert "deep" in html_text.render(cell * 200 + "deep")
    assert time.time() - began < 5
