import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from treeloom.session import build_session

    s = build_session("local[4]", 4, app="treeloom-tests")
    yield s
    s.stop()


@pytest.fixture
def files_of(spark):
    """Build a ``files`` table from {"root": {"a/b.txt": bytes or str or None (dir)}}."""
    from treeloom.sources.tables import files_from_table

    def make(tree: dict):
        rows = []
        for root, entries in tree.items():
            for rel, body in entries.items():
                if body is None:
                    continue
                b = body.encode("utf-8") if isinstance(body, str) else bytes(body)
                rows.append((root, rel, bytearray(b)))
        df = spark.createDataFrame(rows, "root string, p string, content binary")
        return files_from_table(df, path="p", text=None, content="content")

    return make
