import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size int, h long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sha", "vor", "el", "qui", "no", "bas", "der"]
    words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rnd.choice(["", "", "", ".", ",\n"]) for w in words)


def make_rows():
    """Documents with nulls, empty and long texts, exact and near copies, shared passages and repeated rows."""
    rows = []
    passage = prose(999, 120)
    for i in range(24):
        rows.append([i, prose(i, 90 + 7 * i), "en" if i % 2 else "de", f"s{i % 3}"])
    rows[3][1] = rows[2][1]
    rows[4][1] = rows[2][1]
    for i in (6, 9, 12):
        rows[i][1] = prose(i, 40) + "\n" + passage + "\n" + prose(i + 50, 30)
    rows[14][1] = rows[13][1].replace("ka", "zu", 1)
    rows[15][1] = prose(70, 6000)
    rows += [
        [24, None, "en", "s0"],
        [25, "", "en", None],
        [26, "  \n\t ", None, "s1"],
        [27, "ab", "de", "s2"],
        [28, "123 456 !!!", None, None],
        [29, "héé ünï çéd <|endoftext|> 日本  x \n y", "fr", "s1"],
        [30, "ha " * 400, "en", "s1"],
        [31, "A" * 900, "en", "s1"],
        [None, "no id here " + prose(80, 60), None, "s2"],
        [32, rows[16][1], "en", "s1"],
        [32, rows[16][1], "en", "s1"],
        [33, "one\x0btwo\x0cthree", "en", "s1"],
    ]
    return [(*r, 0, "other", 7, 3) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "false")
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA.replace("TEXT string", "x string")).toDF(
        "doc_id", "text", "lang", "source", "n_chars", "TEXT", "size", "h"
    )


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
