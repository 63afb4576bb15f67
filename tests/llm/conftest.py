import pytest

DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """Makes a documents table; extra columns have names that operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("did", "_text", "rank", "node", "bucket", "part", "n"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def prose():
    """Deterministic text of n words."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(WORDS)[:3] for _ in range(r.randint(1, 3))) for _ in range(n))

    return make


ODD = [(None, None), (1, None), (2, ""), (3, "  \n "), (4, "x"), (4, "x"), (5, "é" * 5000), (6, "w " * 3000), (7, "日本語 😀")]


@pytest.fixture
def odd():
    return list(ODD)
