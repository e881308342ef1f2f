"""The interval join and what the stock report makes of it."""

from __future__ import annotations

import random

from conftest import by
from pyspark.sql import functions as F
from test_operators import shuffled  # noqa: F401 - fixture
from test_planning import bom, item, line, unit

from bomwerk.operators.dimensions import warehouse_nodes
from bomwerk.operators.intervals import contained
from bomwerk.plans import report


def test_contained_equals_all_pairs(spark):
    rng = random.Random(1)
    points = [(n, rng.randrange(0, 300)) for n in range(150)] + [(900, 0), (901, 2**31 - 1), (902, None), (903, 2**30)]
    ranges = [(n, low := rng.randrange(0, 300), low + rng.randrange(-2, 120)) for n in range(60)]
    ranges += [(70, 0, 2**31 - 1), (71, 2**30, 2**30), (72, None, 5), (73, 5, None), (74, 2**31 - 1, 2**31 - 1), (75, 1, 0)]
    found = contained(spark.createDataFrame(points, "id int, p int"), spark.createDataFrame(ranges, "name int, a int, b int"), "p", "a", "b")
    want = [(i, n) for i, p in points for n, a, b in ranges if None not in (p, a, b) and a <= p <= b]
    assert sorted((r.id, r.name) for r in found.collect()) == sorted(want)


def test_contained_is_no_nested_loop(shuffled, spark):  # noqa: F811
    points, ranges = spark.range(50).select(F.col("id").alias("p")), spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    plan = contained(points, ranges, "p", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _tree():
    return [
        dict(name="Alle", lft=0, rgt=9), dict(name="Noord", lft=1, rgt=4), dict(name="N1", lft=2, rgt=3),
        dict(name="Zuid", lft=5, rgt=8), dict(name="Z1", lft=6, rgt=7),
    ]


def test_warehouse_nodes(make, spark):
    asked = spark.createDataFrame([("Alle",), ("Noord",), ("Z1",), ("Elders",)], "node string")
    found = warehouse_nodes(make(warehouse=_tree()), asked).collect()
    assert sorted((r.node, r.warehouse) for r in found) == sorted(
        [("Alle", w) for w in ("Alle", "Noord", "N1", "Zuid", "Z1")] + [("Noord", "Noord"), ("Noord", "N1"), ("Z1", "Z1"), ("Elders", "Elders")]
    )


def test_each_request_sees_its_own_warehouse(make, shuffled):  # noqa: F811
    bins = [("N1", 4), ("Noord", 7), ("Z1", 30), ("Elders", 100)]
    ledger = [("N1", 3), ("Z1", 2), ("Z1", 6), ("Elders", 50)]
    wanted = {"all": None, "blank": "", "root": "Alle", "north": "Noord", "leaf": "Z1", "out": "Elders", "none": "Nergens"}
    tables = make(
        warehouse=_tree(), item=[item("P"), item("part"), item("own", has_batch_no=1)], bom=[bom("P")], uom_conversion_detail=[unit("part")],
        bom_explosion_item=[line("P", "part", 1, 2), line("P", "own", 2, 1)],
        bin=[dict(item_code="part", warehouse=w, actual_qty=q, ordered_qty=0) for w, q in bins],
        stock_ledger_entry=[dict(item_code="own", batch_no="7-own-HPL1", warehouse=w, actual_qty=q) for w, q in ledger],
        quotation=[dict(name="Q", klant_referentie="7", hpl_variant="HPL1")],
        located_request=[dict(request_id=n, quotation="Q", bom="BOM-P", qty_to_produce=1, warehouse=w) for n, w in wanted.items()],
    )
    rows = by(report.bom_stock_report(tables, tables["located_request"]), "request_id", "item_code")
    stock = {n: (rows[n, "part"]["in_stock_qty"], rows[n, "own"]["in_stock_qty"]) for n in wanted}
    assert stock == {
        "all": (100, 61), "blank": (100, 61), "root": (30, 11), "north": (7, 3), "leaf": (30, 8), "out": (100, 50), "none": (None, 0),
    }
    everywhere = by(report.bom_stock_report(tables, tables["located_request"].drop("warehouse")), "request_id", "item_code")
    assert everywhere["north", "part"]["in_stock_qty"] == 100
    plan = report.bom_stock_report(tables, tables["located_request"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
