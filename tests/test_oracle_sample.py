"""A sample of the registered queries against their DuckDB oracles at sf0.001 (the full set: tools/check_oracle.py)."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations labels".split()
SAMPLE = ["project_stats", "path_closure", "list_files", "glob_exclude", "classify_files", "head_lines",
          "secret_findings", "draw_tree", "render_raw", "notebook_cells", "resolve_options", "scaffold_plan"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, cur.fetchall())
