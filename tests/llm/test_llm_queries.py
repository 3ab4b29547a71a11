"""Every query against its SQL, or its contract, on the smallest tables."""

import pytest
from oracle import DATA, compare

from troupe.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["character_id", "anidb_character_id"], "p2_found": ["vector_id", "neighbour_id"], "p3_found": ["seiyuu_id", "topic", "character_id"], "p4_found": ["character_id_a", "character_id_b"],
    "p5_found": ["cluster_id", "character_id"], "p6_found": ["kind", "term", "mark"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, name, f"{DATA}/sf0.001", QUERIES[name], ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.columns == COLUMNS.get(name, df.columns)
    found = df.collect()
    assert len(found) > 0 and (not name.endswith("_found") or len({tuple(map(str, r)) for r in found}) == len(found))
