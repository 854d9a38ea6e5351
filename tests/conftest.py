import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from vitrine.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 2, "6g")
    # A handful of rows per test: compiling the plans would take far longer than running them.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column function on one string (or None)."""
    from pyspark.sql import functions as F

    def run(fn, *args):
        schema = ", ".join(f"c{i} string" for i in range(len(args)))
        return spark.createDataFrame([tuple(args)], schema).select(fn(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]
    return run
