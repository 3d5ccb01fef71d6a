"""Status codes: HTTP to protocol to crawl state, names and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlframe import schema as S


def _names(code: Column, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("unknown"))


def status_name(code: Column) -> Column:
    return _names(code, S.STATUS_NAMES)


def protocol_name(code: Column) -> Column:
    return _names(code, S.PROTOCOL_NAMES)


def has_db_status(status: Column) -> Column:
    return status <= S.DB_MAX


def has_fetch_status(status: Column) -> Column:
    return (status > S.DB_MAX) & (status <= S.FETCH_MAX)


def is_transient(code: Column) -> Column:
    return code.isin(*S.TRANSIENT)


def is_permanent(code: Column) -> Column:
    return code.isin(*S.PERMANENT)


def http_to_protocol(code: Column) -> Column:
    """Protocol result of an HTTP response code; a null code stands for an error that was thrown."""
    return (
        F.when(code == 200, 1)
        .when(code == 304, 21)
        .when(code.isin(302, 303, 307), 13)
        .when((code >= 300) & (code < 400), 12)
        .when(code.isin(400, 410), 11)
        .when(code == 401, 17)
        .when(code == 404, 14)
        .otherwise(16)
    )


def protocol_to_crawl(code: Column, compat: str = "intended") -> Column:
    """Fetch status of a protocol result. As wired, all but success is a retry; as intended, redirects, lost and unchanged pages have their own."""
    found = F.when(code == 1, S.FETCH_SUCCESS)
    if compat == "intended":
        found = found.when(code == 12, S.FETCH_REDIR_PERM).when(code == 13, S.FETCH_REDIR_TEMP).when(code.isin(11, 14), S.FETCH_GONE).when(code == 21, S.FETCH_NOTMODIFIED)
    return found.otherwise(S.FETCH_RETRY)
