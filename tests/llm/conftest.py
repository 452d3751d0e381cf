import random

import pytest

WORDS = "the of and to in a is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows: prose, copies, near copies, shared lines, nulls, empties, blanks, a very long text."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([3, 30, 120, 400]))) for i in range(60)]
    base = prose(rng, 200).split(" ")
    for i in range(60, 75):
        own = list(base)
        for _ in range(i - 60):
            own[rng.randrange(len(own))] = f"new{rng.randint(0, 9999)}"
        rows.append((i, " ".join(own)))
    rows += [(75 + i, rows[5][1]) for i in range(4)]
    line = "A line that a number of documents share, word by word."
    rows += [(80 + i, "\n".join([prose(rng, 30), "  " + (line if i % 2 else line.upper()), prose(rng, 20)])) for i in range(5)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "\n"), (94, "é" * 40 + "\n" + "ß straße x")]
    rows += [(95, prose(rng, 20_000)), (96, ("again " * 3_000).strip()), (97, rows[3][1].upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"key": F.lit(1), "part": F.lit("x"), "band": F.lit(2), "h1": F.lit(3.0)}).repartition(3)
