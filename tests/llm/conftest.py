import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = SCHEMA + ", body long, keep binary, fp long, part int, _c0 string, TEXT string, shard int"
WORDS = {
    "en": "the of and to in that is was for with his they this from have were which their said there".split(),
    "fr": "le la les des une est dans pour que qui sur avec pas plus sont mais nous vous être été".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "ing", "ée", "s", "x"]) for _ in range(n))


def corpus() -> list[tuple]:
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        text = "\n".join(sentence(rng, lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    shared = "this very long line stands in a great many documents of the corpus"
    rows += [(200 + i, f"{sentence(rng, 'en', 9)}\n  {shared.upper() if i % 2 else shared}\t\nend {i}", "en", "src0", 0) for i in range(7)]
    base = sentence(rng, "en", 120)
    rows += [(300 + i, base, "en", "src1", len(base)) for i in range(4)]
    words = base.split()
    for i in range(3):
        changed = list(words)
        changed[i * 30] = "changed"
        rows.append((310 + i, " ".join(changed), "en", "src1", 0))
    rows += [
        (400, None, None, None, None), (401, "", "en", None, 0), (402, " \t\n ", "fr", "s", 4), (403, "123 456 !!", "en", "s", 10), (None, "text without an id", "en", "s", 18),
        (404, "漢字 と ½ ² ́ \xa0x y \x85 😀 İΣ", None, "s", 9), (405, "x" * 200_000, "en", "s", 200_000), (405, "x" * 200_000, "en", "s", 200_000),
        (406, "\n" * 50, "en", "s", 50), (407, "one", "en", "s", 3), (408, "a\x00b  c \r\n d", "en", "s", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = (5, b"k", 6, 7, "c", "T", 9)
    return spark.createDataFrame([(*r, *extra) for r in rows], CLASH).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)
