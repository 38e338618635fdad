import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import DATA, assert_equal  # noqa: E402

from quernstone.llm import queries  # noqa: E402

Q, O = queries.queries(), queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["cpt_id", "markup"], "p2_found": ["sft_id", "defect"], "p3_found": ["filename_a", "filename_b"], "p4_found": ["sft_id_a", "sft_id_b"], "p5_found": ["cpt_id", "cut"],
    "p7_found": ["tab", "row_id", "slice_kind", "slice_value"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_oracle(spark, name):
    assert_equal(spark, Q[name], O[name])


@pytest.mark.parametrize("name", sorted(Q))
def test_query_runs_with_its_columns_and_distinct_rows(spark, name):
    df = Q[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows or name == "p5_found"  # the smallest tables have no text over the limit
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_every_problem_has_a_query():
    assert {int(k[1:].split("_")[0]) for k in Q} == set(range(1, 11))
