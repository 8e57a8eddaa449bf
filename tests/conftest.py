from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def one_run():
    """Queries of a test session share the view's tables instead of writing them again for each query: the rows are the same."""
    from tracehold.plans import detections, evaluation, evidence, intake, proofs, signing, surface, verdicts

    def once(f):
        made = {}
        return lambda spark, sf_dir: made[sf_dir] if sf_dir in made else made.setdefault(sf_dir, f(spark, sf_dir))

    for name, home, users in (
        ("calls_of", detections, (evaluation, intake, proofs, surface)), ("chained", evidence, (signing,)), ("evidence_of", signing, ()), ("Scored", verdicts, ()),
    ):
        shared = once(getattr(home, name))
        for module in (home, *users):
            setattr(module, name, shared)
