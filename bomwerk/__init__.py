"""bomwerk: supply planning, production, quoting and billing analytics on Spark.

Every job is ``job(tables, **params) -> DataFrame``. ``tables`` is any mapping from
table name to DataFrame (see ``bomwerk.sources.tables``); nothing is collected to
the driver and nothing runs until the caller writes or reads the result.
"""
