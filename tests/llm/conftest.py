import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The hard documents as a stored table, so that every read sees the same rows."""
    from fixtures import documents, frame

    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, documents()).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    from fixtures import frame

    return frame(spark, [])
