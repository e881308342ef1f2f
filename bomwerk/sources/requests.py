"""Configurator requests: JSON text with a fixed schema, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomwerk.functions.columns import filled

_PRICE = T.DecimalType(18, 2)
_QTY = T.DecimalType(18, 6)

_ARTICLE = T.StructType(
    [
        T.StructField("sequence", T.IntegerType()),
        # ids are text: a request may hold them as numbers or as strings
        T.StructField("artikel_code", T.StringType()),
        T.StructField("artikel_naam", T.StringType()),
        T.StructField("helptext", T.StringType()),
        T.StructField("variant_code", T.StringType()),
        T.StructField("variant_naam", T.StringType()),
        T.StructField("aantal", _QTY),
        T.StructField("artikel_prijs", _PRICE),
        T.StructField("afbeelding_link", T.StringType()),
    ]
)
_ARTICLES = T.ArrayType(T.StructType([T.StructField("artikelen", _ARTICLE)]))
_TEXT_FIELDS = (
    "klant", "contact_email", "contact_telefoon", "adres_klant", "postcode", "plaats", "offerte_datum",
    "configurator_link", "screen_dump_link_1", "screen_dump_link_2",
)
_AMOUNT_FIELDS = ("basis_bedrag", "interieur_bedrag", "styling_bedrag", "accessoires_bedrag")

PAYLOAD = T.StructType(
    [
        T.StructField(
            "root",
            T.ArrayType(
                T.StructType(
                    [T.StructField("configurator_id", T.StringType())]
                    + [T.StructField(name, T.StringType()) for name in _TEXT_FIELDS]
                    + [T.StructField(name, _PRICE) for name in _AMOUNT_FIELDS]
                    + [T.StructField("artikelen", T.StructType([T.StructField("artikelen", _ARTICLES)]))]
                )
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_requests(requests: DataFrame) -> DataFrame:
    """Requests with their header fields, articles and ``reason``, NULL for a usable request."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # a generator of one row: the optimizer would otherwise copy the parsing into every
    # expression and filter that uses its result
    parsed = requests.select(
        "request_id", "received_at", "payload", F.explode(F.array(F.from_json("payload", PAYLOAD, options))).alias("_p")
    )
    # get() gives NULL for a missing element
    header = parsed.withColumn("_h", F.get("_p.root", F.lit(0)))
    header = header.withColumn("quote_date", F.expr("try_cast(split_part(_h.offerte_datum, 'T', 1) AS DATE)"))
    reason = (
        F.when(F.col("_p.root").isNull() | F.col("_p._corrupt").isNotNull(), "malformed")
        .when(F.col("_h").isNull(), "empty")
        .when(~filled(F.col("_h.configurator_id")) | F.col("quote_date").isNull(), "incomplete")
        .when(F.col("_h.artikelen.artikelen").isNull(), "no articles")
    )
    return header.select(
        "request_id",
        "received_at",
        "payload",
        F.col("_h.configurator_id").alias("configurator_id"),
        "quote_date",
        *[f"_h.{name}" for name in _TEXT_FIELDS],
        *[f"_h.{name}" for name in _AMOUNT_FIELDS],
        F.col("_h.artikelen.artikelen.artikelen").alias("articles"),
        reason.alias("reason"),
    )


def usable(requests: DataFrame) -> DataFrame:
    """The usable ones of ``requests``; what ``parse_requests`` gave is not parsed again."""
    parsed = requests if {"articles", "reason"} <= set(requests.columns) else parse_requests(requests)
    return parsed.filter(F.col("reason").isNull())
