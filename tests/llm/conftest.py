import pytest


@pytest.fixture(scope="session")
def edges(spark):
    from tests.llm.cases import edge_frame

    return edge_frame(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    from tests.llm.cases import edge_frame

    return edge_frame(spark, [])
