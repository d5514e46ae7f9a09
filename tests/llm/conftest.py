import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import DOC_SCHEMA, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    from erario.llm.common import ship

    ship(spark)
    return spark.createDataFrame(odd_documents(), DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture
def store(spark):
    from erario.store import Store

    return Store(spark)
