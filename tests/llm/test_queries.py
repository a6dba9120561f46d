"""Registered queries on the smallest tables: equal to SQL where there is some, else they run with the stated columns."""

import pytest

from tests.test_queries import compare
from tidewire.llm import queries as Q

COLUMNS = {
    "p1_found": {"key_a", "key_b"}, "p3_found": {"processed_article_id", "topic"}, "p4_found": {"entity_id_a", "entity_id_b"}, "p5_found": {"raw_article_id", "line_no"},
    "p6_found": {"raw_article_id", "field_name"}, "p7_found": {"raw_article_id", "line_no"}, "p8_found": {"doc_id", "item_id"}, "p10_found": {"doc_id", "reading_level"},
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    query = Q.queries()[name]
    if name in COLUMNS:
        assert set(query(spark, sf).columns) == COLUMNS[name]
    compare(spark, sf, name, query, Q.oracle_sql().get(name))
