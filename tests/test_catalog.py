"""Queries over files and commands against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from turnengine import catalog

DATA = Path("/root/testdata/sf0.001")
NAMES = ["token_files", "metadata_file", "sample_files", "saved_files", "workbook_files", "import_files", "gates", "fixed_file", "built_file", "score_file", "score_report", "final_files", "regrouped_conversations", "translate_sequential", "translated_file", "verify_fields", "verify_ids", "corpus_drift", "quality_structural", "imported_turns"]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    rows = catalog.queries()[name](spark, str(DATA))
    found = tables.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(tuple(text(r[c]) for c in names) for r in rows.collect()) == sorted(tuple(map(text, r)) for r in found.fetchall())
