import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard int, kind string, batch string, blob string, "
          "spans string, print double, row string, tokens string")
SYLLABLES = {"en": "the th in er on re ed nd ha at en es".split(), "de": "der sch ung ein ver keit ach ich tz pf ü ä".split(),
             "fr": "le eau tion que ment oi é è ai ou eux an".split(), "es": "el ción os as que do ar ñ ó ez ll mi".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Prose in four languages with copies, near copies, chains of near copies, nulls, empties, ties and very long texts."""
    rng = random.Random(5)
    texts = []
    for i in range(60):
        lang = list(SYLLABLES)[i % 4]
        texts.append((prose(rng, lang, rng.choice([1, 3, 4, 5, 6, 20, 80, 200])), lang))
    base, lang = prose(rng, "en", 160), "en"
    texts += [(base, lang)] * 4
    for k in range(12):  # near copies of one text, and of each other
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = prose(rng, "en", 1)
        texts.append((" ".join(w), lang))
    step = base.split()
    for k in range(10):  # a chain: each is near the one before, the ends are far apart
        step = [*step[6:], *prose(rng, "en", 6).split()]
        texts.append((" ".join(step), lang))
    texts += [(None, None), (None, "en"), ("", "de"), (" \t\n ", None), ("x", "en"), ("A b", None), ("1234 5678", "fr")]
    texts += [(prose(rng, "fr", 30_000), "fr"), ("longword" * 20_000, "en")]
    texts.append((texts[0][0].upper() if texts[0][0] else "", "en"))
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base, "en", None, None))  # no id
    rows.append((None, "alone without a name here", "en", None, None))
    return [(*r, 1, "k", None, "b", "s", 0.5, "r", "t") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain_rows():
    return [(r[0], r[1]) for r in odd_rows()]
