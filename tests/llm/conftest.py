import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, host string, part int"


def words(rng, n, start=0):
    return " ".join(f"w{rng.randrange(400) + start}" for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    base, rows = words(rng, 120), []
    for i in range(40):
        rows.append((i, words(rng, rng.randrange(1, 60)), ["en", "de", None][i % 3], ["a", "b", None][i % 3], i, "x", "y", 1))
    near = base.split()
    near[5] = "changed"
    rows += [
        (100, base, "en", "a", 1, None, None, None), (101, base, "en", "b", 1, None, None, None), (102, " ".join(near), "en", "a", 1, None, None, None),
        (103, None, None, None, None, None, None, None), (104, "", "en", "a", 0, "", "", 0), (105, " \t\n", "en", "a", 3, "", "", 0),
        (None, "no id here at all", "en", "a", 1, "", "", 0), (None, None, None, None, None, None, None, None), (None, base, "en", None, 1, "", "", 0),
        (107, words(rng, 30_000), "en", "a", 1, "", "", 0), (108, "x" * 200_000, "en", "a", 1, "", "", 0), (109, "1234 5678 !!", "en", "b", 1, "", "", 0),
        (110, "same row twice", "de", "b", 1, "s", "t", 2), (110, "same row twice", "de", "b", 1, "s", "t", 2), (110, "one id and another text", "de", "b", 1, "s", "t", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that operators use inside, or add.
CLASHING = (
    "row key own src rate parts steps copies replica shuffle_key place s h b t r n x before position shard slot c _key _src _rate _s _h _b _r _x _id _none _row "
    "token block load text_key lang_pred score2 ambiguous width item_shingles licenses verdict rule"
).split()


@pytest.fixture(scope="session")
def clashing(messy):
    """The messy rows with columns of such names, whose values tell whether they were kept."""
    from pyspark.sql import functions as F

    return messy.select("*", *[F.lit(f"keep {n}").alias(n) for n in CLASHING]).repartition(3).cache()


def kept_whole(rows):
    """Whether every clashing column still has its value."""
    return all(r[n] == f"keep {n}" for r in rows for n in CLASHING)
