"""Bill-of-material stock report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.operators.dimensions import Tables, warehouse_nodes
from bomwerk.operators.shared import stored
from bomwerk.plans.production import check_parts, needs_with_stock


def _valid():
    return F.coalesce(F.col("qty_to_produce") > 0, F.lit(False))


def report_rejects(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Requests without a positive quantity."""
    requests = tables["report_request"] if requests is None else requests
    return requests.filter(~_valid()).select("request_id", "quotation", "bom", "qty_to_produce")


def bom_stock_report(
    tables: Tables, requests: DataFrame | None = None, warehouse: str | None = None
) -> DataFrame:
    """Per request and component: quantity per unit, required, in stock, sets that can be built.

    Unlike the production check, stocked subassemblies also appear among the exploded
    components. A request's ``warehouse`` limits its stock to that warehouse and those
    below it; without one all stock counts. ``warehouse`` sets it for all requests.
    """
    requests = tables["report_request"] if requests is None else requests
    if warehouse:
        requests = requests.withColumn("warehouse", F.lit(warehouse))
    quotations = tables["quotation"].select(
        F.col("name").alias("quotation"), F.col("klant_referentie").alias("ref"), F.col("hpl_variant").alias("variant")
    )
    orders, asked, nodes = requests.filter(_valid()).join(quotations, "quotation"), None, None
    located = "warehouse" in requests.columns
    node = [F.coalesce("warehouse", F.lit("")).alias("node")] if located else []
    # loose parts, batch items and the pairs asked for are all taken from these rows
    orders = stored(orders.select("request_id", "bom", "qty_to_produce", "ref", "variant", *node), "report")
    if located:
        asked = orders.select("node", "bom").distinct()
        nodes = warehouse_nodes(tables, asked.select("node").filter(F.col("node") != "").distinct())
    parts = check_parts(tables, plain_without_subassemblies=False, direct_quantity="stock_qty", asked=asked, nodes=nodes)
    need = (F.col("per_unit") * F.col("qty_to_produce")).cast("decimal(28,6)")
    return needs_with_stock(orders, parts, need, tables, nodes).select(
        "request_id",
        F.col("kind").alias("branch"),
        "item_code",
        F.col("component_name").alias("item_name"),
        F.col("per_unit").alias("qty_per_line"),
        F.col("need").alias("required_qty"),
        F.col("actual_qty").alias("in_stock_qty"),
        F.col("enough").alias("buildable"),
    )


def bom_stock_report_flag(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The report with its colour: green when at least part of a set can be built."""
    flag = F.when(F.col("buildable") > 0, "green").otherwise("red")
    return bom_stock_report(tables, requests).withColumn("flag", flag)
