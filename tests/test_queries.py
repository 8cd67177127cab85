from pathlib import Path

import pytest
from check_queries import connect, difference

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 60


def test_entry(spark):
    assert "packet_count" in contract.entry(spark).columns


@pytest.mark.parametrize(
    "name",
    ["flow_table", "stored_flows", "windowed_flows", "store_roundtrip", "protocol_distribution",
     "scaled_features", "knn_exact", "anomalies_all", "triplets", "davies_bouldin"],
)
def test_equal_to_sql(spark, name):
    ours = contract.queries()[name](spark, SMALL).toPandas()
    assert len(ours)
    assert difference(ours, connect(SMALL).execute(contract.oracle_sql()[name]).df()) is None


def test_scratch_folder_of_a_cluster_and_of_a_local_session(spark, monkeypatch):
    from flowspark import session as ses

    own = spark.conf.get("spark.checkpoint.dir")
    assert ses.scratch_dir(spark).startswith(own)

    class Unset:
        def __init__(self, master):
            self.conf, self.sparkContext = {}, type("C", (), {"master": master})

    first, second = ses.scratch_dir(Unset("local[2]")), ses.scratch_dir(Unset("local[2]"))
    assert first != second and Path(first).parent == Path(second).parent
    with pytest.raises(RuntimeError):
        ses.scratch_dir(Unset("spark://host"))
