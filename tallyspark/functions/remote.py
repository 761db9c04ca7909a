"""Canonical names of Git remotes, as column expressions.

https, ssh, git and http URLs and scp forms become `host[:port]/path` without credentials, query, fragment,
default port or `.git`. Local remotes give null. `remote_error` tells remotes that name nothing.
"""

from __future__ import annotations

import ipaddress
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DEFAULT_PORTS = {"git": "9418", "http": "80", "https": "443", "ssh": "22"}
LOWER_CASE_HOST = "github.com"

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::([0-9]*))?([^?#]*)"
SCP = r"^(?:[^@\s/:]+@)?(\[[^\]\s]+\]|[^:/\s\[]+):([^?#]*)"


def clean_host(host: str | None) -> str | None:
    """Host without trailing dot, IDNA-encoded, IPv6 compressed and in brackets; None if it is none."""
    if host is None:
        return None
    bare = host.strip().removeprefix("[").removesuffix("]").rstrip(".")
    if not bare or any(c.isspace() for c in bare):
        return None
    try:
        return f"[{ipaddress.IPv6Address(bare).compressed}]" if ":" in bare else bare.encode("idna").decode().lower()
    except (ValueError, UnicodeError):
        return None


def clean_hosts(hosts: pd.Series) -> pd.Series:
    return hosts.map({h: clean_host(h) for h in hosts.dropna().unique()}).astype(object).where(hosts.notna(), None)


def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def parts(remote: Column, *, exotic: bool) -> dict[str, Column]:
    """text, local, host, port and path of a remote. exotic: also non-ASCII and IPv6 hosts and non-ASCII paths,
    for which Python runs; without it they are errors."""
    text = F.regexp_replace(remote, r"(?U)^\s+|\s+$", "")
    scheme = F.lower(F.regexp_extract(text, URL, 1))
    is_url = scheme != ""
    is_scp = ~F.contains(text, F.lit("://")) & text.rlike(SCP)
    local = F.lower(text).startswith("file:") | text.rlike(r"^[A-Za-z]:") | text.rlike(r"^(/|\\|\./|\.\./|~/|\.\\)") | (~F.contains(text, F.lit("://")) & ~is_scp)
    host = F.when(is_url, F.regexp_extract(text, URL, 2)).otherwise(F.regexp_extract(text, SCP, 1))
    port = F.when(is_url, F.regexp_extract(text, URL, 3)).otherwise("")
    default = F.coalesce(*[F.when(scheme == s, F.lit(p)) for s, p in DEFAULT_PORTS.items()], F.lit(""))
    raw = F.translate(F.when(is_url, F.regexp_extract(text, URL, 4)).otherwise(F.regexp_extract(text, SCP, 2)), "\\", "/")
    plain = host.rlike(r"^[A-Za-z0-9._-]+$")
    simple = F.when(plain, F.nullif(F.lower(F.regexp_replace(host, r"\.+$", "")), F.lit("")))
    if exotic:
        simple = F.when(plain, simple).otherwise(F.pandas_udf(clean_hosts, "string")(F.when(~plain, host)))
        raw = F.when(raw.rlike(r"^[\x00-\x7f]*$"), raw).otherwise(F.pandas_udf(nfc, "string")(F.when(~raw.rlike(r"^[\x00-\x7f]*$"), raw)))
    path = F.trim(F.regexp_replace(raw, "/+", "/"), F.lit("/"))
    good = (text != "") & (is_scp | scheme.isin(*DEFAULT_PORTS)) & simple.isNotNull() & (F.length(port) < 6)
    path = F.when(~path.rlike(r"(^|/)\.{1,2}(/|$)"), F.nullif(F.regexp_replace(path, r"(?i)\.git$", ""), F.lit("")))
    path = F.when(~path.rlike("/$"), path)
    return {"local": local & (text != ""), "good": good, "host": simple, "port": F.when(port != default, port).otherwise(""), "path": path}


def normalize_remote(remote: Column, *, exotic: bool = False) -> Column:
    p = parts(remote, exotic=exotic)
    path = F.when(p["host"] == LOWER_CASE_HOST, F.lower(p["path"])).otherwise(p["path"])
    name = F.concat(p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""), F.lit("/"), path)
    return F.when(~p["local"] & p["good"], name)


def is_local(remote: Column) -> Column:
    """Whether a remote is a path or file URL of this machine."""
    return parts(remote, exotic=False)["local"]


def remote_error(remote: Column, *, exotic: bool = False) -> Column:
    """Whether a remote is neither local nor a network location with host and repository path."""
    return remote.isNotNull() & ~parts(remote, exotic=exotic)["local"] & normalize_remote(remote, exotic=exotic).isNull()


def resolve_remote(origin: Column, remotes: Column) -> Column:
    """struct(kind, canonical, candidates) of an origin and an array of all remotes, in this order: origin, one
    unique remote, several (ambiguous), only local ones, none."""
    all_names = F.array_sort(F.array_compact(F.array_distinct(F.transform(F.coalesce(remotes, F.array().cast("array<string>")), lambda r: normalize_remote(r)))))
    own = normalize_remote(origin)
    local = F.exists(F.coalesce(remotes, F.array().cast("array<string>")), lambda r: parts(r, exotic=False)["local"]) | F.coalesce(parts(origin, exotic=False)["local"], F.lit(False))
    kind = F.when(own.isNotNull(), "self_origin").when(F.size(all_names) == 1, "unique_remote").when(F.size(all_names) > 1, "ambiguous_remote").when(local, "local_only").otherwise("unclassified")
    canonical = F.when(own.isNotNull(), own).when(F.size(all_names) == 1, F.get(all_names, F.lit(0)))
    return F.struct(kind.alias("kind"), canonical.alias("canonical"), F.when(own.isNotNull(), F.array(own)).otherwise(all_names).alias("candidates"))
