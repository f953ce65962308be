import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from weftplan.llm.common import ship

    ship(spark)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture
def hard_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, a clashing extra column."""
    long = prose(1, 30_000)
    rows = [(1, "a b c"), (2, None), (3, ""), (4, long), (5, long), (6, "a b c"), (6, "a b c"), (None, "a b c"), (None, None), (7, " \t\n "), (8, "x" * 100_000), (9, "Ünïcode ÄÖ\r\nline\n\nline "), (10, prose(2, 400)), (11, prose(2, 400) + " tail")]
    return spark.createDataFrame([(i, t, "clash", 1.5) for i, t in rows], "doc_id long, text string, component_id string, score double")
