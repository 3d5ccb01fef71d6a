"""Credentials of web servers: a loader for their XML form, and the rule that finds those of a server's challenge.

``<credentials username password>`` elements hold ``<authscope host port realm scheme>`` elements, each attribute of
which may be missing and then fits everything, and at most one ``<default realm scheme>`` in all.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What a scope may name, the most telling first.
ATTRIBUTES = ("host", "port", "realm", "scheme")


@dataclass(frozen=True)
class Scope:
    user: str
    password: str
    host: str | None = None
    port: int | None = None
    realm: str | None = None
    scheme: str | None = None
    default: bool = False

    @property
    def weight(self) -> int:
        """The more telling attributes a scope names, the sooner it is taken."""
        return sum(2 ** (3 - k) for k, name in enumerate(ATTRIBUTES) if getattr(self, name) is not None)


def parse(xml: str) -> list[Scope]:
    """Scopes of a document, the most telling first and the default last; ValueError where it has another form."""
    root = ET.fromstring(xml)
    if root.tag != "auth-configuration":
        raise ValueError(f"not an <auth-configuration>: <{root.tag}>")
    found = []
    for owner in root:
        for scope in owner:
            if owner.tag != "credentials" or scope.tag not in ("authscope", "default"):
                raise ValueError(f"not known: <{owner.tag}> with <{scope.tag}>")
            named = {k: scope.get(k) or None for k in ("realm", "scheme")}
            if scope.tag == "authscope":
                port = scope.get("port", "")
                named |= {"host": (scope.get("host") or "").lower() or None, "port": int(port) if port.isdigit() else None}
            named["scheme"] = named["scheme"] and named["scheme"].lower()
            found.append(Scope(owner.get("username", ""), owner.get("password", ""), **named, default=scope.tag == "default"))
    if sum(s.default for s in found) > 1:
        raise ValueError("more than one default")
    return sorted(found, key=lambda s: (s.default, -s.weight))


def load(spark: SparkSession, path: str) -> list[Scope]:
    """Scopes of a file on any file system."""
    return parse(spark.read.text(path, wholetext=True).first()[0])


def challenge(header: str) -> tuple[str, str | None]:
    """(scheme in lower case, realm) of a WWW-Authenticate header."""
    realm = re.search(r'(?i)\brealm\s*=\s*(?:"([^"]*)"|([^\s,]+))', header)
    return header.split(maxsplit=1)[0].lower() if header.strip() else "", realm and (realm[1] if realm[1] is not None else realm[2])


def find(scopes: list[Scope], host: str, port: int | None, realm: str | None, scheme: str) -> Scope | None:
    """The most telling scope that fits. The default counts only for servers (host and port) that no scope names."""
    asked = {"host": host.lower(), "port": port, "realm": realm, "scheme": scheme.lower()}
    named = any(s.host == asked["host"] and s.port == port for s in scopes if not s.default)
    fits = lambda s: all(getattr(s, k) in (None, v) for k, v in asked.items()) and not (s.default and named)
    return next((s for s in sorted(scopes, key=lambda s: (s.default, -s.weight)) if fits(s)), None)


def user_column(scopes: list[Scope], host: Column, port: Column, realm: Column, scheme: Column) -> Column:
    """The user that :func:`find` gives for each row; null where there is none. ``scopes`` are settings, not data."""
    asked = {"host": F.lower(host), "port": port, "realm": realm, "scheme": F.lower(scheme)}
    no = F.lit(False)
    named = no
    for s in scopes:
        if not s.default and s.host is not None and s.port is not None:
            named |= F.coalesce((asked["host"] == s.host) & (asked["port"] == s.port), no)
    found = []
    for s in sorted(scopes, key=lambda s: (s.default, -s.weight)):
        fits = ~named if s.default else F.lit(True)
        for k in ATTRIBUTES:
            if getattr(s, k) is not None:
                fits &= F.coalesce(asked[k] == getattr(s, k), no)
        found.append(F.when(fits, s.user))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def basic(scope: Scope) -> str:
    """Value of the Authorization header."""
    return "Basic " + base64.b64encode(f"{scope.user}:{scope.password}".encode()).decode()
