import base64
import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weekloom.llm import jaccard, lm, warc


def brute_sets(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * either:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_components_by_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(corpus).collect()}
    assert found == brute_components(rows)


def test_components_of_odd_rows_and_nothing(odd, nothing):
    found = jaccard.similarity_components(odd).collect()
    assert len(found) == odd.count()
    unnamed = sorted(((r.n_shingles, r.component_id) for r in found if r.doc_id is None))
    assert unnamed[0] == (0, None) and unnamed[1][1] == 5  # a null text, and a copy of document 5
    assert jaccard.similarity_components(nothing).count() == 0


def test_chain_of_links(spark):
    """Neighbours link, ends do not: one component whichever set leads."""
    base = [f"w{i}" for i in range(120)]
    texts = [(k, " ".join(base[4 * k : 4 * k + 60])) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs).collect()}
    assert found == brute_components(texts)
    assert {c for _, c in found.values()} == {0}


def brute_links(rows):
    """Links of each distinct set to other distinct sets."""
    sets = {i: frozenset(brute_sets(t)) for i, t in rows}
    other = set(sets.values()) - {frozenset()}
    count = {s: sum(100 * len(s & o) >= 80 * len(s | o) for o in other if o != s) for s in other}
    return {i: count.get(s, 0) for i, s in sets.items()}


def test_all_links_are_counted(corpus, spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    near = [(k, " ".join([*base[: 20 * k], f"changed{k}", *base[20 * k + 1 :]])) for k in range(3)]
    near += [(10 + k, " ".join(f"v{i}" if i != 9 * k else f"x{k}" for i in range(400))) for k in range(40)]
    near += [(60, near[0][1]), (61, "one two three four"), (62, None)]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    want = brute_links(near)
    assert [want[k] for k in range(3)] == [2, 2, 2]
    assert {r.doc_id: r.n_links for r in jaccard.similarity_components(docs).collect()} == want
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # several blocks of one component
    assert {r.doc_id: r.n_links for r in jaccard.similarity_components(docs).collect()} == want
    found = {r.doc_id: r.n_links for r in jaccard.similarity_components(corpus).collect()}
    assert found == brute_links([(r.doc_id, r.text) for r in corpus.collect()])


def test_linked_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(5, 900))
        whole = jaccard.mix(rng.integers(0, 2**62, 2 * n).astype(np.uint64))
        common = int(np.ceil(0.8 * n))
        spare = n - common
        a = np.unique(np.concatenate([whole[:common], whole[common : common + spare // 2]]))
        b = np.unique(np.concatenate([whole[:common], whole[n : n + spare - spare // 2]]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < 80 * either or len(a) == both == len(b):
            continue
        assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size, (n, len(a), len(b))
        bits = [np.frombuffer(jaccard.sketch(x), dtype=np.uint64) for x in (a, b)]
        assert jaccard.may_link(np.array([len(a)]), bits[0][None], len(b), bits[1])[0]


def brute_scores(rows, settings):
    counts, tokens = Counter(), {}
    for i, (key, text) in enumerate(rows):
        words = (text or "").encode().lower().split() + [b""]
        tokens[i] = (key, words)
        if key is None or zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(words)
    n, v, d = sum(counts.values()), len(counts), settings.discount
    short = {w for w, c in counts.items() if c >= settings.min_share * n} | {b""}
    two, three = Counter(), Counter()
    for key, words in tokens.values():
        if key is None or zlib.crc32(str(key).encode()) % 7 != 2:
            s = ["<s>", *words]
            two.update(zip(s, s[1:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    ok = lambda g: all(x == "<s>" or x in short for x in g)
    two = {g: c for g, c in two.items() if c >= settings.min_count and ok(g)}
    three = {g: c for g, c in three.items() if c >= settings.min_count and ok(g)}
    single = dict(counts) | {"<s>": counts[b""]}
    used2, used3 = Counter(), Counter()
    for (a, _), c in two.items():
        used2[a] += c - d
    for (a, b, _), c in three.items():
        used3[a, b] += c - d

    def p1(w):
        return max(counts[w] - d, 0) / n + d * v / n / (v + 1)

    def p2(a, w):
        left = 1 - used2[a] / single[a] if a in used2 else 1
        return ((two[a, w] - d) / single[a] if (a, w) in two else 0) + left * p1(w)

    def p3(a, b, w):
        if (a, b) not in two:
            return p2(b, w)
        left = 1 - used3[a, b] / two[a, b] if (a, b) in used3 else 1
        return ((three[a, b, w] - d) / two[a, b] if (a, b, w) in three else 0) + left * p2(b, w)

    out = []
    for key, words in tokens.values():
        s = ["<s>", *words]
        score = math.log10(p2("<s>", words[0])) + sum(math.log10(p3(*g)) for g in zip(s, s[1:], s[2:], strict=False))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        out.append((key, len(words), sum(counts[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_lm_scores_by_brute_force(name, request):
    docs = request.getfixturevalue(name)
    settings = lm.LmSettings(min_share=5e-3, block_bytes=20_000)
    found = lm.lm_scores(docs, lm.crc_share("doc_id", 7, 2), settings=settings).collect()
    want = brute_scores([(r.doc_id, r.text) for r in docs.collect()], settings)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)


def test_lm_counts_all_words(corpus):
    """By default every word makes histories, however small its share, and parts of a block add up."""
    settings = lm.LmSettings(block_bytes=20_000)
    found = lm.lm_scores(corpus, lm.crc_share("doc_id", 7, 2), settings=settings).collect()
    want = {r[0]: r for r in brute_scores([(r.doc_id, r.text) for r in corpus.collect()], lm.LmSettings(min_share=0.0))}
    rare = lm.lm_scores(corpus, lm.crc_share("doc_id", 7, 2), settings=lm.LmSettings(min_share=1e-2)).collect()
    assert {r.doc_id: r.score for r in found} == pytest.approx({i: r[5] for i, r in want.items()}, rel=1e-9)
    assert sum(r.score for r in found) > sum(r.score for r in rare)


def test_gram_arrays():
    import numpy as np

    texts = [np.array(t) for t in ([1, 3, 4, 3, 4, 2], [1, 2], [1, 2**30, -1, 3, 4, 2])]
    ab, third, c = lm.gram_counts(texts, [True, True, False])
    got = {(int(x) >> lm.BITS, int(x) & lm.MASK, int(y)): int(n) for x, y, n in zip(ab, third, c, strict=True)}
    assert got == {
        (1, 3, 0): 1, (3, 4, 0): 2, (4, 3, 0): 1, (4, 2, 0): 1, (1, 2, 0): 1, (1, 2**30, 0): 0,
        (1, 3, 4): 1, (3, 4, 3): 1, (4, 3, 4): 1, (3, 4, 2): 1,
    }
    for x, y in zip(lm.unpack_grams(lm.pack_grams(ab, third, c)), (ab, third, c), strict=True):
        assert x.tolist() == y.tolist()


def test_lm_weights_sum_to_one(corpus):
    """The model's probabilities of all next words after a history sum to one."""
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split() + [b""])
    n, v, d = sum(counts.values()), len(counts), 0.75
    total = sum(max(c - d, 0) / n + d * v / n / (v + 1) for c in counts.values()) + d * v / n / (v + 1)
    assert total == pytest.approx(1)


def test_lm_arrays_only(corpus, monkeypatch):
    """Between blocks and buckets travel arrays, not a row for each word; many buckets and small blocks change no score."""
    rows, words = [], set()
    monkeypatch.setattr(lm, "BUCKET_BYTES", 10_000, raising=False)
    monkeypatch.setattr(lm, "stored", lambda df, name, put=lm.stored: rows.append((found := put(df, name)).count()) or found)
    settings = lm.LmSettings(block_bytes=30_000)
    found = lm.lm_scores(corpus, lm.crc_share("doc_id", 7, 2), settings=settings).collect()
    texts = [(r.doc_id, r.text) for r in corpus.collect()]
    for _, text in texts:
        words.update((text or "").lower().split())
    assert sum(rows) < len(words)
    want = {r[0]: r for r in brute_scores(texts, settings)}
    assert {r.doc_id: r.n_known for r in found} == {i: r[2] for i, r in want.items()}
    assert {r.doc_id: r.base_score for r in found} == pytest.approx({i: r[4] for i, r in want.items()}, rel=1e-9)
    assert {r.doc_id: r.score for r in found} == pytest.approx({i: r[5] for i, r in want.items()}, rel=1e-9)


def test_trigrams_of_kept_bigrams_travel():
    import numpy as np

    s = np.array([3, 4, 5, 6, 3, 4, 5, 7])
    two = lm.Grams.of_words(np.append(lm.START, s[:-1]), s, np.ones(len(s), int))
    kept = two.n >= 2  # 3 4 and 4 5
    three = two.longer(np.where(kept, np.cumsum(kept) - 1, -1), kept, s, np.array([0]), np.ones(len(s), int))
    assert [(int(h), int(w), int(n)) for h, w, n in zip(three.heads, three.last, three.n, strict=True)] == [(0, 5, 2)]
    assert three.place.tolist() == [-1, -1, 0, -1, -1, -1, 0, -1]


def test_blocks_are_cut_in_order():
    import pyarrow as pa

    texts = ["abc", "", "d" * 9, "ef", "", "ghij"]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (texts[:2], [], texts[2:])]
    for size, want in ((4, [["abc", "", "d" * 9], ["ef", "", "ghij"]]), (1, [["abc"], ["", "d" * 9], ["ef"], ["", "ghij"]]), (99, [texts])):
        assert [t.column("text").to_pylist() for t in lm._chunks(batches, size)] == want


def test_lm_without_training_rows(corpus, nothing):
    held = lm.lm_scores(corpus, F.lit(True)).collect()
    assert len(held) == corpus.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in held)
    assert lm.lm_scores(nothing, F.lit(False)).count() == 0


def test_chunks_join_to_the_payload():
    for payload in (b"", b"abc", b"x" * 100, b"..WARC/1.1\r\n..WARC/1.1\r\n", b"WARC/1.1\r\n" * 9):
        for size in (3, 10, 64):
            parts = [bytes(p) for p in warc.chunks_of(payload, size)]
            assert b"".join(parts) == payload
            assert all(len(p) <= size and warc.VERSION_LINE not in p for p in parts)


def test_archives_round_trip(spark, tmp_path):
    big = "é<p>" * 30_000
    rows = [
        (1, "http://a/", "same"), (2, "http://b c/\n", "same"), (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", big),
        (7, "u", big), (8, "u", "x WARC/1.1\r\nWARC-Type: fake\r\n\r\n y"), (9, "u", "tail\r\n\r\n"), (9, "u", "tail\r\n\r\n"),
        (None, "u", "same"), (10, "u", "one\ntwo\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    found = warc.round_trip(pages, segment_bytes=1000).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, _, t in rows:
        texts.setdefault(i, (t or "").encode())
    last = {}
    for i, t in texts.items():
        last[t] = max(last.get(t, -1), -1 if i is None else i)
    for r in found:
        payload = texts[r.page_id]
        assert r.intact
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        refers = last[payload] if r.page_id is not None and last[payload] != r.page_id else None
        assert (r.record_type, r.refers_to) == ("revisit" if refers is not None else "response", refers)
    few = warc.round_trip(pages, segment_bytes=1000, min_revisit_bytes=100).collect()
    assert {r.page_id for r in few if r.record_type == "revisit"} == {6}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_of_repeated_rows_of_several_segments(spark, tmp_path):
    """Repeated ids, with equal and with other payloads, and null ids: every row comes back whole."""
    big, other = "é<p>" * 3000, "other " * 2000
    rows = [(1, "u", big), (1, "v", big), (1, "u", big), (1, "u", other), (2, "u", other), (2, "u", other), (0, "u", other)]
    rows += [(None, "u", big), (None, "u", big), (None, "u", other), (None, None, "small"), (3, "u", other[:-1]), (3, "u", big[:-1])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "warc"), segment_bytes=1000)
    found = warc.read_archives(spark, str(tmp_path / "warc")).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = Counter((i, u, len(t.encode()), digest(t), 2 if t == other and i in (0, 1) else None) for i, u, t in rows)
    assert Counter((r.record_id, r.url, r.payload_bytes, r.payload_digest, r.refers_to) for r in found) == want
    assert all(r.intact for r in found)
    heads = [r.headers for r in warc.read_records(spark, str(tmp_path / "warc")).select("headers").collect()]
    names = Counter(h["WARC-Record-ID"] for h in heads)
    assert set(names.values()) == {1}
    assert {h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h} <= set(names)


def test_archives_hold_raw_bytes(spark):
    payload = bytes(range(256)) * 20
    rows = spark.createDataFrame([(1, "u", bytearray(payload))], "page_id long, url string, html binary")
    r = warc.round_trip(rows, segment_bytes=700).first()
    assert r.intact and r.payload_bytes == len(payload)
    assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_one_id_with_two_texts(spark):
    """Each text is a class of its own: document 3 links with the second text of id 1."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k in range(2):
        found = sorted((r.doc_id, r.component_id) for r in jaccard.similarity_components(docs, links=bool(k)).collect())
        assert found == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_text_ids_come_back_from_archives(spark):
    ids = ["http://a/1", "http://a/2", "x y>z", "", "~", None, "100%"]
    rows = [(i, "http://u", "same" if k < 2 else f"page {k}" * 20000 if k == 2 else f"page {k}") for k, i in enumerate(ids)]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert set(found) == set(ids)
    assert found["http://a/1"].record_type == "revisit" and found["http://a/1"].refers_to == "http://a/2"
    assert found["x y>z"].payload_bytes == len("page 2" * 20000) and all(r.intact is not False for r in found.values())
