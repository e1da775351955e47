"""Every registered query of the library's own operators: against SQL where SQL can state it."""

import pytest
from compare import connect, same

from kadastra.plans import ORACLE_SQL, QUERIES

#: Queries that SQL can't state; tests/test_brute.py holds them against plain Python.
BRUTE = {"ret2_approximate_top_k", "eva10_p_values", "gra13_negative_pairs", "win12_packed_sentences", "win13_packed_lines", "win13_packed_questions", "win14_recursive_split", "win14_question_pairs"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(ORACLE_SQL) == BRUTE
