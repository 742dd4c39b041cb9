import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, row string, fp long"


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(3)
    syllables = "ka lo mi tu ren sa vor del pin gal os ter".split()
    common = "the of and to in a is that".split()

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.35 else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls in all columns, empty, blank and long texts, repeated rows and ids, and further columns whose names operators use."""
    rng = random.Random(4)
    rows = [(k, prose(rng.randint(5, 120)), "en", f"s{k % 3}") for k in range(40)]
    long = prose(6000)
    rows += [(40, long, "en", "s0"), (41, long + " x", None, None), (42, "", "de", "s1"), (43, None, None, "s1"), (44, " \n\t ", "en", None)]
    rows += [(None, prose(30), "en", "s2"), (None, None, None, None), (45, rows[3][1], "en", "s0"), (46, rows[3][1], "en", "s0"), rows[5], rows[5]]
    rows += [(47, "é" * 500 + "　日本 text \U0001f600", "fr", "s1"), (48, "a" * 1500, "en", "s1"), (49, "One two", "en", "s1"), (50, "one TWO", "en", "s1")]
    return [(*r, len(r[1]) if r[1] is not None else None, 0.5, 7, "x", 9) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(r[0], int("x" not in (r[1] or "")), int("tulo" in (r[1] or "")), 0.0) for r in odd_rows] + [(1, None, None, 0.0), (None, 1, 1, 0.0), (999, 1, 0, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, score double")
