import pytest
from llm_rows import CLASHING, SCHEMA, SF, odd_rows

from tidemark.llm.common import prepare


@pytest.fixture(scope="session")
def ready(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def table(ready):
    """The smallest documents table: (DataFrame, rows as dicts)."""
    df = ready.read.parquet(f"{SF}/documents.parquet")
    return df, [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def odd(ready):
    """The same as (DataFrame with clashing columns, rows as dicts)."""
    df = ready.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"'clash' as {c}" for c in CLASHING]), [dict(zip(SCHEMA.names, r, strict=True)) for r in odd_rows()]


@pytest.fixture(scope="session")
def empty(ready):
    return ready.createDataFrame([], SCHEMA)


@pytest.fixture(params=["table", "odd"])
def case(request):
    return request.getfixturevalue(request.param)
