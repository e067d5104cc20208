import pytest
from plenarium.llm.queries import QUERIES

COLUMNS = {"p2_found": ["fact_id", "entity_clean"], "p4_found": ["country", "attention_id"], "p5_found": ["fact_id", "iso3"], "p6_found": ["record_table", "record_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, smallest, name):
    df = QUERIES[name](spark, smallest)
    assert df.count() > 0
    assert df.columns == COLUMNS.get(name, df.columns)
