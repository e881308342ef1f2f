from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomwerk.session import local_session
from bomwerk.sources.derived import DerivedTables
from bomwerk.sources.schemas import SCHEMAS
from bomwerk.sources.tables import LocalTables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def small(spark):
    return DerivedTables(spark, SMALL)


def frame(spark, ddl, rows):
    """Rows given as dicts of plain values; a column that is left out is NULL."""
    schema = T.StructType.fromDDL(ddl)
    text = T.StructType([T.StructField(field.name, T.StringType()) for field in schema])
    data = [tuple(None if row.get(f.name) is None else str(row[f.name]) for f in schema) for row in rows]
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    return spark.createDataFrame(data, text).select(*columns)


@pytest.fixture
def make(spark):
    def make(**tables):
        return LocalTables(spark, {name: frame(spark, SCHEMAS[name], rows) for name, rows in tables.items()})

    return make


def by(rows, *keys):
    """Collected rows as dicts under their key."""
    found = {}
    for row in rows.collect():
        key = tuple(row[k] for k in keys)
        assert key not in found, f"repeated {key}"
        found[key if len(keys) > 1 else key[0]] = row.asDict()
    return found
