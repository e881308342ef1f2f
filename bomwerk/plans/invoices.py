"""Invoices, bookings and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.functions.columns import MONEY, dec, filled, money
from bomwerk.operators.dimensions import Tables
from bomwerk.operators.lookup import lookup, one_per_key
from bomwerk.operators.mutate import update_by_key
from bomwerk.operators.postings import CLEARING, REVENUE, memo_documents, postings
from bomwerk.operators.shared import once
from bomwerk.plans.quotes import leads_linked

# Fixed values of the ERP.
ADVANCE_SHARE = "0.3"
FINAL_TAX_SHARE = "0.7"
VAT_SHARE = "0.21"
TERM_DAYS = 7
INVOICE_GROUPS = {
    "Basis": "basis_bedrag",
    "Modules": "interieur_bedrag",
    "Accessoires": "accessoires_bedrag",
    "Styling": "styling_bedrag",
    "Custom": "custom_bedrag",
}


def _share(value: Column, share: str) -> Column:
    return value * dec(share, "decimal(6,4)")


def _no_money() -> Column:
    return F.lit(0).cast(MONEY)


def _leads_by_reference(tables: Tables) -> DataFrame:
    return one_per_key(
        leads_linked(tables).filter(filled(F.col("configurator_id"))).select(
            "configurator_id", "name", "lead_name", "snelstart_relatie", "snelstart_kostenplaats"
        ),
        ["configurator_id"], ["name"],
    )


def _with_lead(rows: DataFrame, tables: Tables) -> DataFrame:
    return lookup(
        rows, _leads_by_reference(tables), {"klant_referentie": "configurator_id"},
        {"lead": "name", "klant_naam": "lead_name", "relation": "snelstart_relatie", "cost_centre": "snelstart_kostenplaats"},
    )


def down_payment_invoices(tables: Tables, share: str = ADVANCE_SHARE, vat_share: str = VAT_SHARE) -> DataFrame:
    """30 % of every quotation; the VAT is 21 % of that gross amount, when the quotation has taxes."""
    quotations = tables["quotation"].select(
        F.col("name").alias("quotation"), "klant_referentie", "transaction_date", "grand_total",
        F.col("taxes_and_charges").alias("vat_kind"), "total_taxes_and_charges",
    )
    part = _share(F.col("grand_total"), share)
    vat = F.when(F.col("total_taxes_and_charges") > 0, money(_share(part, vat_share))).otherwise(_no_money())
    return (
        _with_lead(quotations, tables)
        .withColumn("total", money(part))
        .withColumn("vat", vat)
        .select(
            "quotation", F.col("transaction_date").alias("invoice_date"), F.lit(TERM_DAYS).alias("term"), "klant_naam",
            "relation", "cost_centre", "total", money(F.col("total") - F.col("vat")).alias("line"), "vat", "vat_kind",
            F.when(F.col("lead").isNull(), "no lead").alias("reason"),
        )
    )


def invoice_route(tables: Tables) -> DataFrame:
    """Invoices with a customer reference are final invoices, the others direct ones."""
    route = F.when(filled(F.col("klant_referentie")), "final").otherwise("direct")
    return tables["sales_invoice"].select(F.col("name").alias("invoice"), route.alias("route"))


def final_invoices(
    tables: Tables, share: str = ADVANCE_SHARE, tax_share: str = FINAL_TAX_SHARE
) -> DataFrame:
    """Invoice total less the down payment of the customer's booked quotation."""
    booked = (
        tables["quotation"]
        .filter((F.col("snelstart_koppeling") == 1) & filled(F.col("klant_referentie")))
        .select("klant_referentie", "transaction_date", "name", "grand_total")
    )
    booked = one_per_key(booked, ["klant_referentie"], ["transaction_date", "name"], last=True)
    invoices = tables["sales_invoice"].filter(filled(F.col("klant_referentie"))).select(
        F.col("name").alias("invoice"), "klant_referentie", "posting_date", "grand_total",
        F.col("taxes_and_charges").alias("vat_kind"), "total_taxes_and_charges",
    )
    rows = lookup(
        _with_lead(invoices, tables), booked, {"klant_referentie": "klant_referentie"},
        {"quotation": "name", "quoted": "grand_total"},
    )
    taxes = _share(F.col("total_taxes_and_charges"), tax_share)
    reason = F.when(F.col("quotation").isNull(), "no booked quotation").when(F.col("lead").isNull(), "no lead")
    return (
        rows.withColumn("advance", money(_share(F.col("quoted"), share)))
        .withColumn("total", money(F.col("grand_total") - F.col("advance")))
        .withColumn("vat", F.when(taxes > 0, money(taxes)).otherwise(_no_money()))
        .select(
            "invoice", F.col("posting_date").alias("invoice_date"), F.lit(TERM_DAYS).alias("term"), "quotation", "klant_naam",
            "relation", "cost_centre", "advance", "total", money(F.col("total") - F.col("vat")).alias("line"), "vat", "vat_kind",
            reason.alias("reason"),
        )
    )


def direct_invoices(tables: Tables) -> DataFrame:
    """Invoices without reference, booked on the lead's relation, else the customer's own,
    else a relation to create. A customer whose lead has no relation is rejected."""
    invoices = tables["sales_invoice"].filter(~filled(F.col("klant_referentie"))).select(
        F.col("name").alias("invoice"), "customer", "posting_date", "grand_total", "net_total",
        F.col("taxes_and_charges").alias("vat_kind"), "total_taxes_and_charges", "snelstart_grootboek",
    )
    accounts = one_per_key(
        tables["ledger_account"].select("grootboek_naam", "grootboek_code"), ["grootboek_naam"], ["grootboek_code"]
    )
    rows = lookup(
        invoices, tables["customer"], {"customer": "name"},
        {"customer_lead": "lead_name", "own_relation": "snelstart_referentie"},
    )
    rows = lookup(rows, leads_linked(tables), {"customer_lead": "name"}, {"lead_relation": "snelstart_relatie"})
    rows = lookup(rows, accounts, {"snelstart_grootboek": "grootboek_naam"}, {"account": "grootboek_code"})
    has_lead, lead_relation = filled(F.col("customer_lead")), filled(F.col("lead_relation"))
    own = filled(F.col("own_relation"))
    relation = F.when(has_lead, F.when(lead_relation, F.col("lead_relation"))).when(own, F.col("own_relation"))
    action = F.when(has_lead, F.when(lead_relation, "lead")).when(own, "customer").otherwise("create")
    return rows.select(
        "invoice", "customer", F.col("posting_date").alias("invoice_date"), F.lit(TERM_DAYS).alias("term"),
        relation.alias("relation"), "account", money(F.col("grand_total")).alias("total"),
        money(F.col("net_total")).alias("line"), money(F.col("total_taxes_and_charges")).alias("vat"),
        "vat_kind", action.alias("action"), F.when(action.isNull(), "lead without relation").alias("reason"),
    )


def customer_relations(tables: Tables) -> DataFrame:
    """Customers after direct invoicing: the lead's relation becomes the customer's."""
    found = (
        direct_invoices(tables)
        .filter(F.col("action") == "lead")
        .groupBy(F.col("customer").alias("name"))
        .agg(F.max("relation").alias("snelstart_referentie"))
    )
    return update_by_key(tables["customer"], found, ["name"])


def _invoices_with_quotation(tables: Tables) -> DataFrame:
    """Invoices with the submitted quotation of their lead, the latest if several."""
    submitted = (
        tables["quotation"]
        .filter((F.col("docstatus") == 1) & F.col("lead").isNotNull())
        .select("lead", "transaction_date", "name")
    )
    latest = one_per_key(submitted, ["lead"], ["transaction_date", "name"], last=True)
    invoices = tables["sales_invoice"].select(F.col("name").alias("invoice"), "lead_name")
    return lookup(invoices, latest, {"lead_name": "lead"}, {"quotation": "name"})


def invoice_group_totals(tables: Tables) -> DataFrame:
    """Amount per item group of the lines billed for the lead's quotation."""
    sums = tables["sales_invoice_item"].groupBy("parent", F.col("quotation").alias("of")).agg(
        *[
            F.sum(F.when(F.col("item_group") == group, F.col("amount"))).alias(name)
            for group, name in INVOICE_GROUPS.items()
        ]
    )
    invoices = _invoices_with_quotation(tables).filter(F.col("quotation").isNotNull())
    of_invoice = [F.col("invoice") == F.col("parent"), F.col("quotation") == F.col("of")]
    return invoices.join(sums, of_invoice, "left").select(
        "invoice", "quotation", *[F.coalesce(name, F.lit(0)).cast(MONEY).alias(name) for name in INVOICE_GROUPS.values()]
    )


def invoice_group_rejects(tables: Tables) -> DataFrame:
    """Invoices whose lead has no submitted quotation."""
    rows = _invoices_with_quotation(tables).filter(F.col("quotation").isNull())
    return rows.select("invoice", "lead_name", F.lit("no base quotation").alias("reason"))


def _documents(tables: Tables) -> DataFrame:
    """All invoices in one schema, with the reason why one cannot be calculated."""
    columns = (
        "document", "kind", "invoice_date", "term", "relation", "cost_centre", "account", "text", "total", "line", "vat", "vat_kind",
        "action", "reason",
    )
    revenue = F.lit(REVENUE)
    nothing = F.lit(None).cast("string")

    def document(rows: DataFrame, kind: str, name: str, text: str, account: Column, centre: Column, action: Column) -> DataFrame:
        rows = rows.withColumnRenamed(name, "document").withColumn("kind", F.lit(kind)).withColumn("text", F.col(text))
        return rows.withColumn("account", account).withColumn("cost_centre", centre).withColumn("action", action).select(*columns)

    centre = F.col("cost_centre")

    def build() -> DataFrame:
        down = document(down_payment_invoices(tables), "down payment", "quotation", "klant_naam", revenue, centre, nothing)
        final = document(final_invoices(tables), "final", "invoice", "klant_naam", revenue, centre, nothing)
        direct = document(direct_invoices(tables), "direct", "invoice", "customer", F.col("account"), nothing, F.col("action"))
        return down.unionByName(final).unionByName(direct)

    return once(tables, "invoice documents", build)


def _judged(tables: Tables) -> DataFrame:
    """Documents with ``reason`` also set where an id that the booking needs is missing.

    A direct invoice whose relation is still to be created lacks no id but that one.
    """
    direct = F.col("kind") == "direct"
    to_create = F.coalesce(F.col("action") == "create", F.lit(False))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~filled(F.col("relation")) & ~to_create, "no relation")
        .when(~direct & ~filled(F.col("cost_centre")), "no cost centre")
        .when(~filled(F.col("account")), "no ledger account")
        .when((direct | (F.col("vat") > 0)) & ~filled(F.col("vat_kind")), "no VAT kind")
    )
    return _documents(tables).withColumn("reason", reason).withColumn("to_create", to_create & F.col("reason").isNull())


def _bookable(tables: Tables) -> DataFrame:
    return _judged(tables).filter(F.col("reason").isNull() & ~F.col("to_create"))


def booking_rejects(tables: Tables) -> DataFrame:
    """Documents that cannot be booked."""
    return _judged(tables).filter(F.col("reason").isNotNull()).select("document", "kind", "reason")


def direct_relations_to_create(tables: Tables) -> DataFrame:
    """Relations that direct invoices wait for: created under the invoice's id and the
    customer's name, then kept on the customer, so that the next run books the invoice."""
    return _judged(tables).filter("to_create").select(
        F.col("document").alias("invoice"), F.col("text").alias("customer"), F.col("document").alias("relatiecode"), F.col("text").alias("naam")
    )


def invoice_balance_check(tables: Tables) -> DataFrame:
    """Line plus VAT against the total, with the sum as text."""
    difference = (F.col("line") + F.col("vat") - F.col("total")).cast(MONEY)
    text = F.concat(
        F.col("line").cast("string"), F.lit(" + "), F.col("vat").cast("string"), F.lit(" = "), F.col("total").cast("string")
    )
    return _documents(tables).filter(F.col("reason").isNull()).select(
        "document", "kind", difference.alias("difference"), F.when(difference != 0, 0).otherwise(1).alias("balanced"),
        text.alias("calculation"),
    )


def booking_documents(tables: Tables) -> DataFrame:
    """Bookings as JSON text for the bookkeeping service, with the VAT kind of each document.

    Down payments and final invoices have a VAT row only when there is VAT, direct
    invoices always. ``booking_rejects`` and ``direct_relations_to_create`` have the
    documents that are left out.
    """
    line = F.struct(
        F.col("text").alias("omschrijving"),
        F.struct(F.col("account").alias("id")).alias("grootboek"),
        F.when(F.col("kind") != "direct", F.struct(F.col("cost_centre").alias("id"))).alias("kostenplaats"),
        F.col("line").alias("bedrag"),
    )
    vat = F.array(F.struct(F.col("vat_kind").alias("btwSoort"), F.col("vat").alias("btwBedrag")))
    booking = F.struct(
        F.col("invoice_date").cast("string").alias("factuurdatum"),
        F.col("document").alias("factuurnummer"),
        F.col("term").alias("betalingstermijn"),
        F.struct(F.col("relation").alias("id")).alias("klant"),
        F.col("total").alias("factuurbedrag"),
        F.array(line).alias("boekingsregels"),
        F.when((F.col("vat") > 0) | (F.col("kind") == "direct"), vat).alias("btw"),
    )
    return _bookable(tables).select("document", "kind", F.to_json(booking).alias("booking"))


def quote_linked_flag(tables: Tables) -> DataFrame:
    """Quotations with the booked flag set where a down payment was booked."""
    booked = _bookable(tables).filter(F.col("kind") == "down payment").select(
        F.col("document").alias("name"), F.lit(1).alias("snelstart_koppeling")
    )
    flags = tables["quotation"].select("name", "snelstart_koppeling")
    return update_by_key(flags, booked, ["name"])


def _journals(tables: Tables) -> DataFrame:
    rows = lookup(tables["journal"], tables["customer"], {"customer": "name"}, {"lead": "lead_name"})
    return lookup(rows, tables["lead"], {"lead": "name"}, {"ref": "configurator_id"})


def journal_postings(tables: Tables) -> DataFrame:
    """Clearing against revenue, one debit and one credit per journal."""
    journals = _journals(tables).filter(F.col("ref").isNotNull()).withColumnRenamed("name", "document")
    text = F.concat("customer", F.lit(" Ref: "), "ref")
    return postings(journals, "document", CLEARING, REVENUE, F.col("grand_total"), text, keep=["posting_date"])


def journal_documents(tables: Tables) -> DataFrame:
    """The postings as one-sided JSON bookings."""
    return memo_documents(journal_postings(tables), "document", "posting_date")


def journal_rejects(tables: Tables) -> DataFrame:
    """Journals of customers without a reference."""
    rows = _journals(tables).filter(F.col("ref").isNull())
    return rows.select(F.col("name").alias("document"), "customer", F.lit("no reference").alias("reason"))
