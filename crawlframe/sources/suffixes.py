"""Table of domain suffixes: a loader for its XML form, and a join that finds the record of a url's host.

The table is data of any size, so it is a side of a join and no literal of the plan.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions.url import host

# Kinds of status and of top-level domains, and what holds where an entry says nothing.
STATUSES = ("INFRASTRUCTURE", "SPONSORED", "UNSPONSORED", "STARTUP", "PROPOSED", "DELETED", "PSEUDO_DOMAIN", "DEPRECATED", "IN_USE", "NOT_IN_USE", "REJECTED")
TYPES = {"itlds": "INFRASTRUCTURE", "gtlds": "GENERIC", "cctlds": "COUNTRY"}
DEFAULT_STATUS, DEFAULT_BOOST = "IN_USE", 1.0

SCHEMA = "domain string, status string, boost double, type string, country string"


def _entry(element: ET.Element, kind: str | None) -> tuple:
    domain, country = element.get("domain", "").lower(), element.findtext(".//country")
    status = (element.findtext(".//status") or DEFAULT_STATUS).strip()
    if not domain or status not in STATUSES or (kind == "COUNTRY" and country is None):
        raise ValueError(f"not an entry of a suffix table: {ET.tostring(element, 'unicode').strip()}")
    boost = element.findtext(".//boost")
    return domain, status, DEFAULT_BOOST if boost is None else float(boost), kind, country if kind == "COUNTRY" else None


def parse(xml: str) -> list[tuple]:
    """Rows (domain, status, boost, type, country) of a document; a suffix of several labels has no type.

    ValueError for an unknown status, an entry without a domain, or a country's domain without its country.
    """
    root, rows = ET.fromstring(xml), []
    for group, kind in TYPES.items():
        rows += [_entry(e, kind) for g in root.iter(group) for e in g.iter("tld")]
    return rows + [_entry(e, None) for g in root.iter("suffixes") for e in g.iter("suffix")]


def load(spark: SparkSession, path: str) -> DataFrame:
    """The table of an XML file on any file system; of entries with equal domains the first counts."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rows: dict = {}
    for row in parse(text):
        rows.setdefault(row[0], row)
    return spark.createDataFrame(list(rows.values()), SCHEMA)


def with_suffix(rows: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with a column ``suffix``: the record of the longest known suffix of the host, null where none is known or for an IP address.

    Hosts are few beside urls, so each one is looked up once: its candidates, a row for each of its labels, meet the table in a join.
    Neither side is broadcast unless Spark finds it small.
    """
    known = rows.withColumn("_host", F.rtrim(host(url), F.lit(".")))
    hosts = known.select("_host").filter(F.col("_host").isNotNull() & ~F.col("_host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$")).distinct()
    labels = F.split("_host", r"\.")
    places = hosts.select("_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_at", "domain"))
    record = F.struct("domain", "status", "boost", "type", "country")
    found = places.join(suffixes, "domain").groupBy("_host").agg(F.min_by(record, "_at").alias("suffix"))
    return known.join(found, "_host", "left").drop("_host")
