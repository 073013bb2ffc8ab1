import pytest
from llm_texts import ODD, documents


@pytest.fixture(scope="session")
def odd(spark):
    from ledgerview.llm.common import prepare

    prepare(spark)
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)
