import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and stone river light garden winter paper window copper market silver valley engine letter music orange bridge candle forest harbor island jacket kitten ladder mirror needle oyster pencil quartz ribbon saddle timber velvet walnut yellow zephyr".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near-copies, odd characters, empties and nulls."""
    rng = random.Random(7)
    base = ["\n".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    near = []
    for t in base[:12]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    odd = [None, "", " \t\n", "One", "one two", "É é ÉTÉ été", "x " * 3000, "a b c", "😀 smile 😀", "ÀÉ\tTHE OF"]
    return base + near + base[:3] + odd + odd[:2]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 5 else None, 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, "no id at all here my friend", "en", "src1", None))
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that operators use inside."""
    return docs.withColumns({n: F.lit(1) for n in ("key", "did", "fp", "part", "rank", "words", "start", "removed", "score", "_s", "total", "label", "features", "stratum")})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
