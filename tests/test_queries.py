"""Every registered query against its SQL on the smallest data set."""
import os

import pytest

from tests.oracle import compare, connect
from vitrine.plans import workload

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

#: Queries that SQL cannot say: tests/test_segment.py
BRUTE_FORCE = {"segmented_words", "unknown_letters", "mended_pages"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """Queries run as they do in production; the other tests skip the compiler (see conftest)."""
    wanted = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, con, name):
    df = workload.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in workload.ORACLES:  # compared with brute force by a test of its own
        assert name in BRUTE_FORCE
        return
    problem, _ = compare(df, con, workload.ORACLES[name])
    assert problem is None
