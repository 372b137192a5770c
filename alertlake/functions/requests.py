"""Fields of HTTP request records found in log events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake.functions.text import trim_space

# A percent sign that does not start an escape makes the URL invalid.
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"


def strip_query(url: Column) -> Column:
    """Decoded path of a URL; the URL without query and fragment where it has no path or is no URL."""
    cut = F.regexp_extract(url, r"(?s)\A([^?#]*)", 1)
    # An authority only follows two slashes; `host:port` without a scheme is no valid URL.
    rest = F.regexp_replace(cut, SCHEME, "")
    path = F.when(rest.startswith("//"), F.regexp_extract(rest, r"(?s)\A//[^/]*(.*)\z", 1)).otherwise(rest)
    valid = ~path.rlike(BAD_ESCAPE) & ~cut.rlike(r"[\x00-\x1f\x7f]") & ~cut.startswith(":")
    opaque = cut.rlike(SCHEME) & ~rest.startswith("/")
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(valid & ~opaque & (path != ""), F.coalesce(decoded, cut)).otherwise(cut)


def client_ip(real_ip: Column, forwarded_for: Column, ip: Column, remote_addr: Column) -> Column:
    """Client address by trust: real IP, first hop of the forwarded list, IP, remote address without its port."""
    real, forwarded, plain, remote = (
        trim_space(F.coalesce(value, F.lit(""))) for value in (real_ip, forwarded_for, ip, remote_addr)
    )
    return (
        F.when(real != "", real)
        .when(forwarded != "", trim_space(F.substring_index(forwarded, ",", 1)))
        .when(plain != "", plain)
        .otherwise(F.regexp_replace(remote, r"\A(.+):[^:]*\z", "$1"))
    )
