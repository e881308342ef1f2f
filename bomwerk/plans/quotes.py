"""Quote intake: configurator requests to lines, prices, leads and quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY, filled, money
from bomwerk.operators.dimensions import Tables
from bomwerk.operators.lookup import lookup, one_per_key
from bomwerk.operators.mutate import insert_new, update_by_key
from bomwerk.operators.shared import once
from bomwerk.sources.requests import parse_requests, usable

# Fixed values of the ERP: the item an unknown article becomes, the article that carries
# the vehicle tax, the item group it is charged on.
FALLBACK_ITEM = "CU00003"
FALLBACK_UOM = "Stuks"
FALLBACK_GROUP = "Custom"
TAX_ARTICLE = "201"
TAXED_GROUP = "Bus"
PRICE_LIST = "Verkoop"
CURRENCY = "EUR"
VAT_RATE = 21


def _requests(tables: Tables, requests: DataFrame | None) -> DataFrame:
    return tables["quote_request"] if requests is None else requests


def _bpm() -> Column:
    """Vehicle tax of a request: the price of the last tax article, else 0."""
    hits = F.filter("articles", lambda article: article["artikel_code"] == TAX_ARTICLE)
    price = F.when(F.size(hits) > 0, F.element_at(hits, -1)["artikel_prijs"])
    return F.coalesce(price, F.lit(0).cast("decimal(18,2)"))


def quote_rejects(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Requests that cannot be read, with the reason."""
    parsed = parse_requests(_requests(tables, requests))
    return parsed.filter(F.col("reason").isNotNull()).select("request_id", "payload", "reason")


def quote_lines(
    tables: Tables, requests: DataFrame | None = None, fallback_warehouse: str = "Standaard"
) -> DataFrame:
    """One line per article of a request."""
    rows = usable(_requests(tables, requests)).select(
        "request_id", "received_at", _bpm().alias("request_bpm"), F.posexplode("articles").alias("pos", "a")
    )
    rows = rows.withColumn("code", F.col("a.artikel_code"))
    items = one_per_key(
        tables["item"].filter(filled(F.col("configurator_id"))).select(
            "configurator_id", "name", "stock_uom", "warehouse", "item_group"
        ),
        ["configurator_id"], ["name"],
    )
    rows = lookup(
        rows, items, {"code": "configurator_id"},
        {"item": "name", "i_uom": "stock_uom", "i_warehouse": "warehouse", "i_group": "item_group"},
    )
    known = F.col("item").isNotNull()

    def of_item(column: str, fallback: str) -> Column:
        return F.when(known, F.col(column)).otherwise(fallback)

    amount = (F.col("a.aantal") * F.col("a.artikel_prijs")).cast("decimal(28,2)")
    bpm = F.when(F.col("i_group") == TAXED_GROUP, F.col("request_bpm")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return rows.select(
        "request_id",
        "received_at",
        "pos",
        F.col("a.sequence").alias("sequence"),
        of_item("item", FALLBACK_ITEM).alias("item_code"),
        F.col("a.artikel_naam").alias("item_name"),
        F.col("a.helptext").alias("description"),
        F.col("a.variant_code").alias("variant_code"),
        F.col("a.variant_naam").alias("variant_naam"),
        F.col("a.aantal").alias("qty"),
        of_item("i_uom", FALLBACK_UOM).alias("uom"),
        F.lit(1).alias("conversion_factor"),
        F.col("a.afbeelding_link").alias("image"),
        of_item("i_group", FALLBACK_GROUP).alias("item_group"),
        F.col("a.artikel_prijs").alias("rate"),
        amount.alias("amount"),
        of_item("i_warehouse", fallback_warehouse).alias("warehouse"),
        bpm.alias("bpm"),
    )


def quote_bpm(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Vehicle tax per request."""
    return usable(_requests(tables, requests)).select("request_id", "configurator_id", _bpm().alias("bpm"))


def price_upsert(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """Item prices after intake: the last line of an item sets its price.

    Unknown articles all set the price of the fallback item. Of several price rows the
    first is updated, whatever its price list.
    """
    last = quote_lines(tables, requests).groupBy("item_code").agg(
        F.max_by("rate", F.struct("received_at", "request_id", "pos")).alias("new_rate")
    )
    prices = tables["item_price"]
    first = prices.groupBy("item_code").agg(F.min("name").alias("name"))
    current = prices.join(first.withColumn("is_first", F.lit(True)), ["item_code", "name"], "left")
    hit = F.col("is_first") & F.col("new_rate").isNotNull()
    return current.join(last, "item_code", "full_outer").select(
        "item_code",
        "name",
        F.coalesce("price_list", F.lit(PRICE_LIST)).alias("price_list"),
        F.coalesce("currency", F.lit(CURRENCY)).alias("currency"),
        F.coalesce("selling", F.lit(1)).alias("selling"),
        F.when(F.col("name").isNull(), 0).alias("buying"),
        F.when(hit | F.col("name").isNull(), F.col("new_rate")).otherwise(F.col("price_list_rate")).alias("price_list_rate"),
        F.when(F.col("name").isNull(), "insert").when(hit, "update").otherwise("keep").alias("action"),
    )


def price_changes(tables: Tables, requests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The price rows to change (name, price_list_rate), and a selling price for each item that has no price."""
    changes = once(tables, "price changes", lambda: price_upsert(tables, requests).filter(F.col("action") != "keep"))
    updates = changes.filter(F.col("action") == "update").select("name", "price_list_rate")
    new = changes.filter(F.col("action") == "insert").select(
        F.concat(F.lit("IP-"), "item_code").alias("name"), "item_code", "price_list", "currency",
        F.col("price_list_rate").cast(MONEY).alias("price_list_rate"), F.col("selling").cast("int").alias("selling"),
    )
    return updates, new


def prices_after_intake(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The price table after intake: changed rates, and a selling price for items without one."""
    updates, new = price_changes(tables, requests)
    return insert_new(update_by_key(tables["item_price"], updates, ["name"]), new, ["name"])


def _known_leads(tables: Tables) -> DataFrame:
    leads = tables["lead"].filter(filled(F.col("configurator_id"))).select("configurator_id", F.col("name").alias("lead"))
    return one_per_key(leads, ["configurator_id"], ["lead"])


def _address() -> Column:
    return F.concat("adres_klant", F.lit("<br>"), "postcode", F.lit(" "), "plaats")


def _lead_name() -> Column:
    """The known lead, else the name a new lead gets."""
    return F.coalesce("lead", F.concat(F.lit("LD-"), "configurator_id"))


def lead_upsert(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """One row per configurator id in the requests; an unknown id becomes a lead with the
    fields of its first request."""
    rows = usable(_requests(tables, requests)).select(
        "configurator_id", "received_at", "request_id", F.col("klant").alias("lead_name"),
        F.col("contact_email").alias("email_id"), F.col("quote_date").alias("transaction_date"),
        _address().alias("customer_details"), F.col("contact_telefoon").alias("mobile_no"),
        F.col("configurator_link").alias("website"),
    )
    first = one_per_key(rows, ["configurator_id"], ["received_at", "request_id"])
    new = F.col("lead").isNull()
    fields = ("lead_name", "email_id", "transaction_date", "customer_details", "mobile_no", "website")
    return first.join(_known_leads(tables), "configurator_id", "left").select(
        "configurator_id",
        _lead_name().alias("lead"),
        *[F.when(new, F.col(name)).alias(name) for name in fields],
        F.when(new, "Quotation").alias("status"),
        F.when(new, "Configurator").alias("source"),
        F.when(new, "insert").otherwise("keep").alias("action"),
    )


def new_leads(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """A lead for every configurator id in the requests that has none."""
    return lead_upsert(tables, requests).filter(F.col("action") == "insert").select(
        F.col("lead").alias("name"), "lead_name", "configurator_id", "email_id", "mobile_no"
    )


def leads_after_intake(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The lead table after intake, with a lead for every configurator id that had none."""
    return insert_new(tables["lead"], new_leads(tables, requests), ["name"])


def quote_headers(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """One draft quotation per request."""
    rows = usable(_requests(tables, requests))
    rows = lookup(rows, _known_leads(tables), {"configurator_id": "configurator_id"}, {"lead": "lead"})
    return rows.select(
        "request_id",
        _lead_name().alias("lead"),
        F.lit("Lead").alias("quotation_to"),
        F.col("klant").alias("customer_name"),
        F.col("quote_date").alias("transaction_date"),
        F.concat(F.lit("Offerte aangemaakt via configurator ID : "), "configurator_id").alias("remark"),
        F.col("configurator_id").alias("klant_referentie"),
        F.lit("Draft").alias("status"),
        F.lit("Configurator").alias("lead_source"),
        _address().alias("address_display"),
        F.col("contact_email"),
        F.col("contact_telefoon").alias("contact_mobile"),
        "configurator_link",
        "screen_dump_link_1",
        "screen_dump_link_2",
        F.lit(CURRENCY).alias("currency"),
        F.lit(PRICE_LIST).alias("selling_price_list"),
        *[money(F.col(name)).alias(name) for name in ("basis_bedrag", "interieur_bedrag", "styling_bedrag", "accessoires_bedrag")],
        F.lit(VAT_RATE).alias("vat_rate"),
        F.lit(1).alias("vat_included"),
        F.lit("Betaling in 2 termijnen").alias("payment_terms_template"),
    )


def request_archive(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The raw payload of every readable request."""
    parsed = parse_requests(_requests(tables, requests))
    readable = F.coalesce(F.col("reason") != "malformed", F.lit(True))
    return parsed.filter(readable).select("request_id", "received_at", F.col("payload").alias("api_data"))


def lead_lookup(tables: Tables, requests: DataFrame | None = None) -> DataFrame:
    """The lead a request belongs to, NULL if there is none yet."""
    rows = usable(_requests(tables, requests)).select("request_id", "configurator_id")
    return lookup(rows, _known_leads(tables), {"configurator_id": "configurator_id"}, {"lead": "lead"})


def cost_centre_resolve(tables: Tables) -> DataFrame:
    """Cost centre of each lead by its number in the bookkeeping directory, or one to create."""
    leads = tables["lead"].filter(filled(F.col("configurator_id"))).select(
        F.col("name").alias("lead"), F.col("configurator_id").alias("reference"), F.col("lead_name").alias("description"),
        F.expr("try_cast(configurator_id AS INT)").alias("nummer"),
    )
    action = F.when(F.col("nummer").isNull(), "invalid").when(F.col("id").isNotNull(), "matched").otherwise("create")
    # references that are no number have none here; they must not meet in one task
    return lookup(leads, _cost_centres(tables), {"nummer": "nummer"}, {"id": "id"}).select(
        "lead", "reference", "description", F.col("id").alias("cost_centre"), action.alias("action")
    )


def relation_resolve(tables: Tables) -> DataFrame:
    """Customer relation of each lead by its code in the bookkeeping directory, or one to create."""
    leads = tables["lead"].filter(filled(F.col("configurator_id"))).select(
        F.col("name").alias("lead"), F.col("configurator_id").alias("reference"), "lead_name", "mobile_no", "email_id"
    )
    action = F.when(F.col("id").isNotNull(), "matched").otherwise("create")
    return lookup(leads, _relations(tables), {"reference": "relatiecode"}, {"id": "id"}).select(
        "lead", "reference", "lead_name", "mobile_no", "email_id", F.col("id").alias("relation"), action.alias("action")
    )


def _cost_centres(tables: Tables) -> DataFrame:
    return tables["cost_centre"].filter(F.col("nummer").isNotNull()).groupBy("nummer").agg(F.min("id").alias("id"))


def _relations(tables: Tables) -> DataFrame:
    return tables["relation"].groupBy("relatiecode").agg(F.min("id").alias("id"))


def leads_linked(tables: Tables) -> DataFrame:
    """Leads with the cost centre and relation found for them."""
    def build() -> DataFrame:
        # one lookup in each directory; a blank reference has no match
        reference = F.when(filled(F.col("configurator_id")), F.col("configurator_id"))
        rows = tables["lead"].withColumns({"_reference": reference, "_number": F.expr("try_cast(configurator_id AS INT)")})
        rows = lookup(rows, _cost_centres(tables), {"_number": "nummer"}, {"_centre": "id"})
        rows = lookup(rows, _relations(tables), {"_reference": "relatiecode"}, {"_relation": "id"})
        found = {"snelstart_kostenplaats": "_centre", "snelstart_relatie": "_relation"}
        return rows.select(*[F.coalesce(found[name], name).alias(name) if name in found else F.col(name) for name in tables["lead"].columns])

    return once(tables, "leads_linked", build)
