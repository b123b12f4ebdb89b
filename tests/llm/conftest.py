import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket string, `set` string, label string, length string"

SYLLABLES = {
    "en": "the and ing tion er on th re wh ly ed".split(),
    "de": "der und ung sch ich ein keit ver zu ge lich".split(),
    "fr": "le des eau que ent ou ai tre aux é è".split(),
}


def prose(rng, lang, n):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for i in range(0, n, 12):
        words[i] = words[i].capitalize()
        words[min(n - 1, i + 11)] += "."
    return "\n".join(" ".join(words[i : i + 24]) for i in range(0, n, 24))


def small_corpus():
    """Prose in three languages with exact and near copies, shared lines, nulls, empties, one long text, repeated rows."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append([i, prose(rng, lang, rng.choice((4, 15, 40, 120, 300))), lang])
    shared = "This line of more than forty characters stands in many documents."
    for i in range(0, 30, 3):
        rows[i][1] = f"{rows[i][1]}\n  {shared.upper() if i % 2 else shared}\t"
    for i, k in ((60, 5), (61, 5), (62, 8)):
        rows.append([i, rows[k][1], rows[k][2]])
    base = prose(rng, "en", 200)
    for i in range(63, 75):  # near copies, each with its own small change
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"changed{i}"
        rows.append([i, " ".join(words), "en"])
    rows += [[80, None, "en"], [81, "", None], [82, " \n\t ", "de"], [83, "12345 !!! 678", "fr"], [84, "a", "en"]]
    rows += [[85, prose(rng, "de", 6000), "de"], [86, "one two three four", "en"], [87, "one two three four", "en"]]
    rows += [[88, "word " * 400, "en"], [89, "\n\n\n", "en"], [90, "x" * 5000, "en"], [91, "日本語 テキスト é́ \U0001f600 ½", None]]
    return [(i, t, lang, "src", 0, "x", "y", "z", "w", "v") for i, t, lang in rows]


@pytest.fixture(scope="session")
def corpus_rows():
    return small_corpus()


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, corpus_rows):
    """The corpus with repeated rows and rows without an id."""
    more = [*corpus_rows, corpus_rows[3], corpus_rows[70], (None, corpus_rows[5][1], "en", None, None, None, None, None, None, None)]
    return spark.createDataFrame([*more, (None,) * 10], SCHEMA).repartition(2).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
