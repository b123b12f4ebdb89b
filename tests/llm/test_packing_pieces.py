import random
import struct
import zlib
from bisect import bisect_left, insort

import pytest
from weekloom.llm import packing, pieces
from weekloom.llm.queries import split_pattern, vocabulary

RANKS, MODEL = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model")


def brute_bins(lengths, size):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        room = size if i == len(rooms) else rooms.pop(i)
        bins += room == size
        insort(rooms, room - n)
    return bins


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        counts = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(1, 30))}
        planned = packing.plan(counts, 40)
        used = {}
        for pattern, number in planned:
            assert sum(n * times for n, times in pattern) <= 40
            for n, times in pattern:
                used[n] = used.get(n, 0) + times * number
        assert used == counts
        assert sum(n for _, n in planned) == brute_bins([n for n, c in counts.items() for _ in range(c)], 40)
    assert packing.plan({}, 40) == []


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_ids_are_the_tokenizers(corpus_rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encode = packing.encoder(RANKS, split_pattern())
    odd = ["", "  \n\n a", "don't  x² y\x1c z", "_a_b__ 12½ x", "日本 語", "\x85a", "it's we'LL ''s", "tab\t\tx  ", "a b"]
    for text in [*odd, *(r[1] or "" for r in corpus_rows)]:
        ids = own.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_packing_places_every_piece_once(name, request):
    docs = request.getfixturevalue(name)
    encode = packing.encoder(RANKS, split_pattern())
    found = packing.best_fit_packing(docs, RANKS, split_pattern(), size=256).collect()
    want = []
    for row in docs.collect():
        ids = encode(row.text or "") + struct.pack("<I", 0)
        for k, (start, n) in enumerate(packing.cut(len(ids) // 4, 256)):
            want.append((row.doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert len(sequences) == brute_bins([w[3] for w in want], 256)


def test_packing_of_nothing(nothing):
    assert packing.best_fit_packing(nothing, RANKS, split_pattern()).count() == 0


def scanned(words, text, chunk):
    text = pieces.MARK + text.replace(" ", pieces.MARK)
    cut = [pieces.Chunk(words.lattice, text[max(0, a - 20) : a], text[a : a + chunk], text[a + chunk : a + chunk + 20]) for a in range(0, len(text), chunk)]
    matrices = [c.transfer() for c in cut]
    tree = [pieces.combine(matrices[i : i + 3]) for i in range(0, len(matrices), 3)]
    (a, b, w), (c, d, v) = pieces.combine(tree)[0], pieces.combine(matrices)[0]
    assert (a, b) == (c, d) and w == pytest.approx(v)
    states = pieces.states_between(matrices, pieces.CLEAN, pieces.CLEAN)
    return [p for c, a, b in zip(cut, states, states[1:], strict=False) for p in c.trace(a, b)]


def test_scan_equals_the_library(corpus_rows):
    words = pieces.Vocabulary(MODEL, "bpe")
    texts = ["    a    b     c", "aaaaaaaaaaaaaaaa    ", "日本語日本\x00 é", "x" * 60, "1234567890" * 9, "<s>  ▁▁ ▁x", " ", " " * 37]
    for chunk in (3, 7, 50):
        for text in texts + [r[1][:200] for r in corpus_rows[:15]]:
            assert words.numbers(scanned(words, text, chunk)) == words.model.encode(text), (chunk, text)


def test_unigram_scan_finds_the_best_sum():
    rng = random.Random(3)
    scores = {p: -rng.random() * len(p) - 0.1 for p in {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)}}
    scores = {p: s for p, s in scores.items() if "▁" not in p.lstrip("▁")} | {"a": -2.0, "b": -2.1, "▁": -2.2}

    class Words:
        lattice = pieces.unigram_lattice(scores)

    for _ in range(60):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 30)))
        whole = pieces.MARK + text.replace(" ", pieces.MARK)
        best = [0.0] + [-1e9] * len(whole)
        for j in range(1, len(whole) + 1):
            best[j] = max(best[i] + scores[whole[i:j]] for i in range(max(0, j - 4), j) if whole[i:j] in scores)
        for chunk in (2, 5, 11):
            found = scanned(Words, text, chunk)
            assert "".join(found) == whole
            assert sum(scores[p] for p in found) == pytest.approx(best[-1])


@pytest.mark.parametrize("name", ["corpus", "odd"])
def test_encode_and_decode_whole_texts(name, request):
    docs = request.getfixturevalue(name)
    model = pieces.Vocabulary(MODEL, "bpe").model
    rows = pieces.encode(docs, MODEL, chunk=300).collect()
    by_id, texts = {}, {}
    spark = docs.sparkSession
    decoded = pieces.decode(spark.createDataFrame(rows, "doc_id long, chunk int, ids array<int>"), MODEL).collect()
    for r in sorted(rows, key=lambda r: r.chunk):
        by_id.setdefault((r.doc_id, r.chunk), []).append(r.ids)
    for r in sorted(decoded, key=lambda r: r.chunk):
        texts.setdefault((r.doc_id, r.chunk), []).append(r.text)
    for row in docs.where("doc_id IS NOT NULL").collect():
        chunks = sorted(c for i, c in by_id if i == row.doc_id)
        ids = [x for c in chunks for x in by_id[row.doc_id, c][0]]
        assert ids == model.encode(row.text or "")
        assert "".join(texts[row.doc_id, c][0] for c in chunks) == (row.text or "")
    assert len({i for i, _ in by_id}) == docs.select("doc_id").distinct().count()


def test_encoding_of_nothing(nothing):
    assert pieces.decode(pieces.encode(nothing, MODEL), MODEL).count() == 0


def test_the_added_token_is_one_id(spark):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|>b", "<|endoftext|><|endoftext|>", "x <|endoftext| y", "  <|endoftext|>  ", "plain", ""]
    added = packing.added_tokens(vocabulary("byte_bpe_50k.json"))
    own, real = packing.encoder(RANKS, split_pattern(), added), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for text in texts:
        ids = list(struct.unpack(f"<{len(own(text)) // 4}I", own(text)))
        assert ids == real.encode(text, add_special_tokens=False).ids, text


def test_unknown_characters_without_byte_pieces():
    words = pieces.Vocabulary(MODEL, "bpe")
    words.byte_ids = {}
    assert words.numbers(["\U0010fffe", "\U0010ffff"]) == [words.model.unk_id()] * 2
