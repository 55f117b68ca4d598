import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codeatlas.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "codeatlas-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Files of one repo from {path: content}; language by name."""
    from codeatlas.functions.languages import with_language

    def make(contents, repo="r"):
        rows = [(repo, path, len(text), text) for path, text in contents.items()]
        return with_language(spark.createDataFrame(rows, "repo string, path string, size long, content string"))

    return make


def rows(df, *cols):
    """Sorted tuples of a frame."""
    cols = cols or df.columns
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
