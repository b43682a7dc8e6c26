from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relimpute.session import build_session
from relimpute.sources.catalog import Catalog


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_catalog(spark):
    """A catalog from {table: (key schema entry, rows, schema)}."""
    import json

    def build(**tables):
        schema = {n: {"pkey_col": pk, "fkey_col_to_pkey_table": fks} for n, (pk, fks, _, _) in tables.items()}
        catalog = Catalog.from_json(spark, json.dumps(schema))
        return catalog.with_tables(**{n: spark.createDataFrame(rows, types) for n, (_, _, rows, types) in tables.items()})

    return build


def tuples(df, *columns):
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
