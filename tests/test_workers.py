import subprocess
import sys

from driftmark.plans import scratch, workers


def test_the_archive_can_be_imported(spark):
    """The stored archive alone is enough for a Python process elsewhere."""
    path = workers._stored(spark).removeprefix("file:")
    code = f"import sys; sys.path.insert(0, {path!r}); import driftmark.operators.snapshot as s; assert {path!r} in s.__file__"
    assert subprocess.run([sys.executable, "-c", code], cwd="/", env={"PATH": "/usr/bin:/bin"}).returncode == 0


def test_a_local_master_needs_no_archive(spark):
    begun = scratch.mark()
    workers.share(spark)
    assert scratch.mark() == begun and workers._NAME not in spark.sparkContext._python_includes
