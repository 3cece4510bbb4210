import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "h01_bm25_search h04_citation_search p01_normalise_space p02_sanitise p04_boilerplate_cut x14_sentences q02_point_verdict "
    "q08_final_finding c05_annex_areas c10_duty_features x05_letter_units x13_nested_json j05_source_precedence v01_key_form "
    "a13_confusion e04_unsupported_citations r02_request_rate"
).split()


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    status, _ = check.compare(entry.queries()[name](spark, FOLDER), check.connect(FOLDER), entry.oracle_sql()[name])
    assert status == "ok"
