import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

WORDS = ["alpha", "Beta", "gamma", "delta", "eps", "zeta,", "eta.", "theta", "ÉTÉ", "kappa", "mit", "license"]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, edge cases; ids from 0."""
    rng = random.Random(5)
    shared, base = passage(rng, 40), passage(rng, 120)
    out = [None, "", "   \n", "one", "one two", "one two", "license\nMIT License  mit license", passage(rng, 6000)]
    out += [passage(rng, rng.randrange(5, 200)) for _ in range(25)]
    out += [out[-1]] * 3 + [passage(rng, 30) + " " + shared + "\n" + passage(rng, 30) for _ in range(4)]
    out += [shared + " " + shared, shared, passage(rng, 34)]
    for _ in range(40):
        w = base.split()
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", [None, "b", "a", "ä"][i % 4] if i % 3 else "hot", len(t or ""), 1.5, i, "x") for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, rk string"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
