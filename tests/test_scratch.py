import os

import pytest

from driftmark.plans import scratch


def test_tables_are_shared_and_cleared(spark):
    out = scratch.materialise(spark.range(3), "numbers")
    path = scratch._made[-1]
    assert out.count() == 3 and path.startswith(scratch.shared_dir(spark))
    kept = scratch._made[:-1]
    scratch._made[:] = [path]
    scratch.clear(spark)
    scratch._made[:] = kept
    assert not os.path.exists(path.removeprefix("file:"))


def test_tables_between_marks_are_cleared(spark):
    begun = scratch.mark()
    scratch.materialise(spark.range(1), "old")
    later = scratch.mark()
    out = scratch.materialise(spark.range(2), "new")
    old, new = scratch._made[begun:]
    scratch.clear(spark, begun, later)
    assert scratch._made[begun:] == [new] and out.count() == 2 and not os.path.exists(old.removeprefix("file:"))
    scratch.clear(spark, begun)
    assert len(scratch._made) == begun and not os.path.exists(new.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default: default})()
        sparkContext = Context()

    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Session())
