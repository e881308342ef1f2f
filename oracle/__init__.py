"""Oracle queries: each job written a second time, as DuckDB SQL over the same tables."""

from __future__ import annotations

from bomwerk.sources.derived import with_views


def oracle(sql: str) -> str:
    """Complete a query text.

    Its first line names the output columns with their type: ``n`` number, ``i``
    integer, ``d`` date, ``t`` time, ``s`` text. The types are cast at the end, the ERP tables it
    mentions are put in front.
    """
    head, body = sql.strip().split("\n", 1)
    casts = {"n": "CAST({0} AS DOUBLE)", "i": "CAST({0} AS BIGINT)", "d": "CAST(CAST({0} AS DATE) AS VARCHAR)",
             "t": "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')", "s": "{0}"}
    columns, kind = [], "s"
    for word in head.split():
        if word.endswith(":"):
            kind = word[0]
        else:
            columns.append(f"{casts[kind].format('r.' + word)} AS {word}")
    body = body.strip()
    if body[:5].upper() == "WITH ":
        # the main SELECT follows the last CTE, marked by a line of its own
        ctes, main = body.split("\n--main\n", 1)
        return with_views(f"{ctes},\nr AS ({main})\nSELECT {', '.join(columns)} FROM r")
    return with_views(f"WITH r AS ({body})\nSELECT {', '.join(columns)} FROM r")
