"""Parameters out of range, and scratch folders on a cluster, are refused."""

import pytest
from conftest import bid_rows

from gavelstream.operators.joins import Shares, hot_keys
from gavelstream.plans import batch, continuous
from gavelstream.session import scratch_dir


@pytest.mark.parametrize("options", [{"divisors": []}, {"divisors": [3, 0]}])
def test_divisors(table, options):
    with pytest.raises(ValueError, match="divisors"):
        batch.selected_bids(table(bid_rows((1, 2, 3, 0))), **options)


@pytest.mark.parametrize("number", [0, -1])
def test_counts_are_positive(table, number):
    bids = table(bid_rows((1, 2, 3, 0)))
    with pytest.raises(ValueError):
        Shares(number)
    with pytest.raises(ValueError):
        hot_keys(bids, "bidder", number)
    for plans in (batch, continuous):
        with pytest.raises(ValueError):
            plans.session_firings(bids, max_events=number)


class Cluster:
    """A session as seen on a cluster without a shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder)})


def test_no_machine_local_scratch_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            scratch_dir(Cluster(master), "x")
    assert scratch_dir(Cluster("yarn", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    assert "gavelstream-" in scratch_dir(Cluster("local[2]"), "x")
