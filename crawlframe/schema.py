"""Table schemas and code vocabularies of the crawl state."""

from __future__ import annotations

from pyspark.sql import types as T

DB_UNFETCHED, DB_FETCHED, DB_GONE, DB_REDIR_TEMP, DB_REDIR_PERM, DB_NOTMODIFIED = 1, 2, 3, 4, 5, 6
FETCH_SUCCESS, FETCH_RETRY, FETCH_REDIR_TEMP, FETCH_REDIR_PERM, FETCH_GONE, FETCH_NOTMODIFIED = 33, 34, 35, 36, 37, 38
SIGNATURE, INJECTED, LINKED, PARSE_METADATA = 65, 66, 67, 68
DB_MAX, FETCH_MAX = 31, 63

STATUS_NAMES = {
    1: "db_unfetched", 2: "db_fetched", 3: "db_gone", 4: "db_redir_temp", 5: "db_redir_perm", 6: "db_notmodified",
    33: "fetch_success", 34: "fetch_retry", 35: "fetch_redir_temp", 36: "fetch_redir_perm", 37: "fetch_gone", 38: "fetch_notmodified",
    65: "signature", 66: "injected", 67: "linked", 68: "parse_metadata",
}

#: Protocol result codes.
PROTOCOL_NAMES = {
    1: "success", 2: "failed", 10: "proto_not_found", 11: "gone", 12: "moved", 13: "temp_moved", 14: "notfound", 15: "retry",
    16: "exception", 17: "access_denied", 18: "robots_denied", 19: "redir_exceeded", 20: "notfetching", 21: "notmodified",
    22: "wouldblock", 23: "blocked",
}
TRANSIENT = (10, 13, 15, 16, 17, 19, 22)
PERMANENT = (2, 11, 12, 14, 18)

#: Metadata keys with a meaning of their own.
LOCK_KEY, PARSE_KEY, SEGMENT_KEY, FETCH_STATUS_KEY = "_ngt_", "parse_class", "segment.name", "_fst_"

HEADER_NAMES = (
    "Content-Disposition", "Content-Encoding", "Content-Language", "Content-Length", "Content-Location", "Content-MD5",
    "Content-Type", "Last-Modified", "Location",
)

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
CRAWL_DATUM = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("fetch_time", T.LongType()),
    T.StructField("modified_time", T.LongType()),
    T.StructField("fetch_interval", T.IntegerType()),
    T.StructField("retries", T.IntegerType()),
    T.StructField("score", T.FloatType()),
    T.StructField("signature", T.BinaryType()),
    T.StructField("extend", _TEXT_MAP),
    T.StructField("meta_data", _TEXT_MAP),
    T.StructField("seq", T.LongType()),
])
CONTENT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("extend", _TEXT_MAP),
    T.StructField("meta_data", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])
OUTLINK = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("anchor", T.StringType()),
    T.StructField("fetch_interval", T.IntegerType()),
    T.StructField("extend", _TEXT_MAP),
])
APP_INFO = T.StructType([T.StructField(n, T.StringType()) for n in ("categories", "app_name", "clear", "introduction")])
