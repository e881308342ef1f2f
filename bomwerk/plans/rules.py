"""Declared table rules: fetched columns, required, unique, accepted values, foreign keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import filled
from bomwerk.operators.dimensions import Tables
from bomwerk.operators.lookup import join_on_key, lookup
from bomwerk.plans.export import EXPORT_COLUMNS

# Fixed values of the ERP: the rules the tables declare.
REQUIRED = {
    "artikel_variant": ("variant_code", "variant_details"),
    "export_layout": ("supplier", "artikel_data"),
    "handeling_activiteit": ("handeling",),
    "handeling_artikelen": ("handeling_activiteit",),
    "instellingen": ("standaard_uurtarief",),
    "item": ("warehouse", "stock_type", "naming_series"),
    "klant_portaal": ("offerte",),
    "klant_updates": ("datum", "update_tekst"),
    "ledger_account": ("grootboek_code", "grootboek_naam"),
    "levertijd_categorie": ("levertijd_categorie", "levertijd_factor"),
    "materiaal_variant": ("variant_code", "variant_details"),
    "productie": ("datum",),
    "productie_module": ("qty",),
    "voorraad_check": ("posting_date", "item", "qty"),
    "voorraad_transactie": ("transactie_type", "unit", "qty", "artikel"),
}
# Tables whose rows need a row in a child table: its name and the key that its ``parent`` holds.
REQUIRED_ROWS = {"productie": ("productie_module", "name"), "handeling_activiteit": ("handeling_artikelen", "handeling")}
UNIQUE = {
    "artikel_variant": ("variant_code",),
    "export_layout": (("supplier", "idx"),),
    "handeling_activiteit": ("handeling",),
    "item": ("configurator_id",),
    "klant_portaal": ("offerte",),
    "lead": ("configurator_id",),
    "ledger_account": ("grootboek_code", "grootboek_naam"),
    "levertijd_categorie": ("levertijd_categorie",),
    "materiaal_variant": ("variant_code",),
}
ACCEPTED = {
    ("export_layout", "artikel_data"): EXPORT_COLUMNS,
    ("item", "stock_type"): ("Standaard Inkoop", "Custom Inkoop"),
    ("item", "naming_series"): ("B-", "MV1-", "O-", "SV-", "CS-", "SUB-", "OK-", "OH-", "A-", "OA-"),
    ("voorraad_transactie", "transactie_type"): ("In", "Uit"),
}
FOREIGN = {
    ("export_layout", "supplier"): ("supplier", "name"),
    ("handeling_artikelen", "handeling_activiteit"): ("routing", "name"),
    ("item", "material"): ("materiaal_variant", "variant_code"),
    ("item", "warehouse"): ("warehouse", "name"),
    ("item_supplier", "supplier"): ("supplier", "name"),
    ("klant_portaal", "offerte"): ("quotation", "name"),
    ("productie_module", "bom"): ("bom", "name"),
    ("quotation_item", "item_code"): ("item", "name"),
    ("voorraad_artikelen", "item_code"): ("item", "name"),
    ("voorraad_artikelen", "supplier"): ("supplier", "name"),
    ("voorraad_artikelen", "uom"): ("uom", "name"),
    ("voorraad_check", "item"): ("item", "name"),
    ("voorraad_transactie", "artikel"): ("item", "name"),
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_required(tables: Tables, rules: dict = REQUIRED, rows: dict = REQUIRED_ROWS) -> DataFrame:
    """Rows without a value per required column, and rows without a row in a required
    child table; one pass over each table."""
    def counts(table: str, columns: tuple[str, ...]) -> DataFrame:
        missing: list[Column] = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.sum(F.when(F.col(column).isNull() | (F.col(column).cast("string") == ""), 1).otherwise(0)).alias("violations"),
                F.count("*").alias("checked_rows"),
            )
            for column in columns
        ]
        return tables[table].agg(F.array(*missing).alias("checks")).select(F.inline("checks"))

    def childless(table: str, child: str, key: str) -> DataFrame:
        parents = tables[child].select(F.col("parent").alias(key), F.lit(1).alias("_has")).distinct()
        found = join_on_key(tables[table].select(key), parents, {key: key}, "left")
        return found.agg(F.sum(F.when(F.col("_has").isNull(), 1).otherwise(0)).alias("violations"), F.count("*").alias("checked_rows")).select(
            F.lit(table).alias("table_name"), F.lit(child).alias("column_name"), "violations", "checked_rows"
        )

    found = [counts(table, columns) for table, columns in rules.items()]
    found += [childless(table, child, key) for table, (child, key) in rows.items()]
    # a table without rows has no sum, and no violation
    return _union(found).fillna(0, ["violations"])


def _by_table(columns: Iterable[tuple[str, str | tuple[str, ...]]]) -> dict[str, list[tuple[str, ...]]]:
    """The checked columns, or tuples of columns, of each table."""
    found: dict[str, list[tuple[str, ...]]] = {}
    for table, column in columns:
        found.setdefault(table, []).append((column,) if isinstance(column, str) else tuple(column))
    return found


def _counted(tables: Tables, columns: Iterable[tuple[str, str | tuple[str, ...]]]) -> DataFrame:
    """Distinct filled values of columns, or of several together, with their number of rows.

    One pass over each table turns its columns into rows; one shuffle counts them all.
    Values of several columns are told apart part by part, NULL parts included.
    """
    def unpivoted(table: str, groups: list[tuple[str, ...]]) -> DataFrame:
        cells = [F.struct(F.lit(" ".join(group)).alias("column_name"), F.array(*[F.col(name).cast("string") for name in group]).alias("parts")) for group in groups]
        return tables[table].select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))

    cells = _union([unpivoted(table, groups) for table, groups in _by_table(columns).items()])
    value = F.array_join("parts", " ")
    counted = cells.filter(filled(value)).groupBy("table_name", "column_name", "parts").agg(F.count("*").alias("violations"))
    return counted.select("table_name", "column_name", value.alias("value"), "violations")


def check_unique(tables: Tables, rules: dict = UNIQUE) -> DataFrame:
    """Values that occur more than once."""
    return _counted(tables, [(table, column) for table, columns in rules.items() for column in columns]).filter(F.col("violations") > 1)


def check_accepted_values(tables: Tables, rules: dict = ACCEPTED) -> DataFrame:
    """Values outside the list of a column."""
    allowed = reduce(
        Column.__or__,
        [(F.col("table_name") == table) & (F.col("column_name") == column) & F.col("value").isin(list(values)) for (table, column), values in rules.items()],
    )
    return _counted(tables, list(rules)).filter(~allowed)


def check_foreign_keys(tables: Tables, rules: dict = FOREIGN) -> DataFrame:
    """Link values without a target.

    One pass over each table gives its link values and, where it is a target itself, its
    keys. One shuffle by (target, value) counts the links of each rule and sees whether
    there is a key; both combine before it, so a hot value is one row of a task.
    """
    linked: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for link, target in rules.items():
        linked.setdefault(target, []).append(link)
    slots = {link: n for links in linked.values() for n, link in enumerate(links)}

    def cells(table: str) -> DataFrame:
        def cell(target: tuple[str, str], column: str, slot: int) -> Column:
            return F.struct(F.lit(" ".join(target)).alias("target"), F.col(column).cast("string").alias("value"), F.lit(slot).alias("slot"))

        found = [cell(target, column, slots[source, column]) for (source, column), target in rules.items() if source == table]
        found += [cell((of, key), key, -1) for of, key in linked if of == table]
        return tables[table].select(F.inline(F.array(*found)))

    scanned = dict.fromkeys([source for source, _ in rules] + [of for of, _ in linked])
    rows = _union([cells(table) for table in scanned]).filter(filled(F.col("value")))
    counts = [F.count_if(F.col("slot") == n).alias(f"_{n}") for n in range(max(slots.values()) + 1)]
    met = rows.groupBy("target", "value").agg(F.bool_or(F.col("slot") == -1).alias("_key"), *counts).filter(~F.col("_key"))
    each = [
        F.struct(F.lit(" ".join(rules[link])).alias("_of"), F.lit(link[0]).alias("table_name"), F.lit(link[1]).alias("column_name"), F.col(f"_{n}").alias("violations"))
        for link, n in slots.items()
    ]
    found = met.select("target", "value", F.inline(F.array(*each))).filter((F.col("target") == F.col("_of")) & (F.col("violations") > 0))
    return found.select("table_name", "column_name", "value", "violations")


def portal_customer(tables: Tables) -> DataFrame:
    """Portal rows with the customer of their quotation."""
    rows = lookup(tables["klant_portaal"], tables["quotation"], {"offerte": "name"}, {"customer_name": "customer_name"})
    return rows.select("name", "offerte", "customer_name")


def stock_count_enriched(tables: Tables) -> DataFrame:
    """Stock counts with the name and warehouse of their item."""
    return lookup(
        tables["voorraad_check"], tables["item"], {"item": "name"}, {"item_name": "item_name", "warehouse": "warehouse"}
    )


def txn_enriched(tables: Tables) -> DataFrame:
    """Transactions with the unit, warehouse and name of their item."""
    return lookup(
        tables["voorraad_transactie"], tables["item"], {"artikel": "name"},
        {"stock_unit": "stock_uom", "locatie": "warehouse", "artikel_naam": "item_name"},
    )


def item_series_fetch(tables: Tables) -> DataFrame:
    """Items with the series code of their group."""
    rows = lookup(tables["item"].drop("naming_series"), tables["item_group"], {"item_group": "name"}, {"naming_series": "item_group_code"})
    return rows.select("name", "item_group", "naming_series")
