"""Whole jobs with a third of all rows on one product, quotation and customer."""

from __future__ import annotations

import pytest
from conftest import by
from pyspark.sql import functions as F
from test_operators import shuffled  # noqa: F401 - fixture
from test_planning import bom, item, line, unit

from bomwerk.plans import planning, production
from bomwerk.sources.schemas import SCHEMAS

LINES = 30000


@pytest.fixture
def hot(make, spark):
    products = [f"P{n}" for n in range(20)]
    tables = make(
        item=[item("part"), item("own", has_batch_no=1), *[item(p) for p in products]],
        item_supplier=[dict(parent="part", supplier="S1", supplier_part_no="x"), dict(parent="own", supplier="S1", supplier_part_no="x")],
        uom_conversion_detail=[unit("part"), unit("own")],
        bom=[bom(p) for p in products],
        bom_explosion_item=[row for p in products for row in (line(p, "part", 1, 2), line(p, "own", 2, 1))],
        bin=[dict(item_code="part", warehouse="W", actual_qty=5, ordered_qty=0)],
    )

    def stored(name, rows):
        given = set(rows.columns)
        return rows.select(*[
            (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in spark.createDataFrame([], SCHEMAS[name]).schema
        ])

    number = F.col("id").cast("string")
    is_hot = F.col("id") % 3 == 0
    quotation = F.when(is_hot, "HOT").otherwise(F.concat(F.lit("Q"), number))
    lines = spark.range(0, LINES, 1, 8).select(
        F.concat(F.lit("L"), number).alias("name"), quotation.alias("parent"), F.col("id").alias("idx"), F.lit(1).alias("docstatus"),
        F.when(is_hot, "P0").otherwise(F.concat(F.lit("P"), F.col("id") % 20)).alias("item_code"),
        F.lit("kast").alias("item_name"), F.lit("Modules").alias("item_group"), F.lit(1).alias("qty"),
    )
    tables["quotation_item"] = stored("quotation_item", lines)
    tables["quotation"] = stored("quotation", lines.select("parent").distinct().select(
        F.col("parent").alias("name"), F.lit(1).alias("docstatus"), F.lit("In productie").alias("vj_status"),
        F.lit(0).alias("voorraadplanning_compleet"), F.col("parent").alias("klant_referentie"), F.lit("HPL1").alias("hpl_variant"),
    ))
    tables["stock_ledger_entry"] = stored("stock_ledger_entry", spark.range(0, LINES, 1, 8).select(
        F.lit("own").alias("item_code"), F.concat(quotation, F.lit("-own-HPL1")).alias("batch_no"), F.lit(1).alias("actual_qty"),
    ))
    return tables


def test_planning(shuffled, hot):  # noqa: F811
    rows = by(planning.planning_demand(hot), "item_code")
    assert rows["part"]["req_qty"] == 2 * LINES and rows["own"]["req_qty"] == LINES
    assert planning.planning_pegging_rows(hot).count() == 2 * LINES
    parts = planning.planning_pegging(hot, lines_per_part=500)
    assert parts.count() == 2 * LINES / 500
    assert parts.select(F.sum(F.size(F.split("bom_item", "<br>")))).first()[0] == 2 * LINES


def test_batch_check(shuffled, hot):  # noqa: F811
    checks = production.material_check_batch(hot)
    sums = {r["actual_qty"]: r["count"] for r in checks.groupBy("actual_qty").count().collect()}
    assert sums == {LINES // 3: LINES // 3, 1: LINES - LINES // 3}
    status = {r["status"]: r["count"] for r in production.module_status(hot).groupBy("status").count().collect()}
    assert status == {"Okay": LINES}
