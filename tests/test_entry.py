"""The driver contract: every query runs, and a cross-section matches its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import DATA
from tools.compare import TABLES, rows_of

SAMPLE = (
    "P2_two_clock_visibility", "J3_multi_hop_path", "J15_cohort_pairs", "A3_base_activity", "A26_joint_numeric", "A39_attribute_priors",
    "A43_weighted_peers", "A52_recurrence", "A55_peer_recurrence", "T9_frame_budget", "V5_pair_errors", "E14_document_assembly", "S13_fingerprint",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["entity", "cutoff"]


def test_registry_is_complete():
    names = set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= names
    groups = {"S": 16, "P": 11, "J": 17, "A": 68, "W": 5, "T": 17, "U": 4, "E": 15, "V": 24, "K": 9, "X": 3}
    for prefix, count in groups.items():
        found = {int(n.split("_")[0][1:]) for n in names if n[0] == prefix and n.split("_")[0][1:].isdigit()}
        assert found == set(range(1, count + 1)), (prefix, set(range(1, count + 1)) - found)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    frame = entry_points.queries()[name](spark, DATA)
    relation = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, relation.fetchall())


@pytest.mark.parametrize("name", ["E13_embedding_projection", "E3_parent_text", "A41_source_annotation"])
def test_model_backed_queries_run(spark, name):
    assert entry_points.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name, most", [("A43_weighted_peers", 10), ("A46_paired_contexts", 16), ("A47_deep_peers", 10)])
def test_peer_links_stand_once(spark, name, most):
    """Links and labels are stored before they are read several times; only totals per cutoff are broadcast."""
    execution = entry_points.queries()[name](spark, DATA)._jdf.queryExecution()
    assert execution.analyzed().collectLeaves().size() <= most
    assert execution.executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("name, most", [
    ("A11_context_deviation_own_cutoffs", 10), ("A33_response_priors_own_cutoffs", 20), ("A34_exposure_quality", 14), ("A35_exposure_residuals", 18),
])
def test_population_statistics_read_events_once(spark, name, most):
    """Events, strata and changes in time are stored before they are read several times."""
    assert entry_points.queries()[name](spark, DATA)._jdf.queryExecution().analyzed().collectLeaves().size() <= most
