"""What the tests of the corpus operators share."""

import pytest

from rivalscope.llm.common import ship

WORDS = "red green blue stone river lamp Glass ÉTÉ über nine0 ten".split()
EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "one"), (5, "x" * 30000)]


@pytest.fixture(scope="session")
def spk(spark):
    ship(spark)
    return spark


def docs(spark, rows):
    """With extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "z", 2, "d", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n long, key string, _n long, _d string, _k1 long")


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))
