import os

import pytest

from sluice.sources import shared


class _Session:
    """A session without spark.checkpoint.dir."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_folder_of_the_session_comes_first(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    own = shared.shared_dir(_Session())
    assert own == shared.shared_dir(_Session()) and os.path.isdir(own)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())


def test_kept_tables_are_read_back(spark):
    df = shared.kept(spark.range(5), "five")
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4]
    assert any("/five-" in f for f in df.inputFiles())
    assert shared.kept(spark.range(0)).count() == 0
