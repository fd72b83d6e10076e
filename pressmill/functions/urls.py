"""URL repair and checks as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.binding import bind
from pressmill.functions.fixed import SCHEME_REPAIRS, URL_REPAIRS, WS

MAX_URL_LENGTH = 2083
_HTTP = "^https?://"


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def repair_scheme(c: Column) -> Column:
    """Undo doubled scheme letters; any other ``x://`` scheme becomes ``https://``."""
    c = _replace_all(c, SCHEME_REPAIRS)
    # A URL with another scheme: keep what follows the first "://".
    return F.regexp_replace(c, "(?s)^(?!https?://).*?://", "https://")


def sanitize_url(c: Column) -> Column:
    """Trim, mend the scheme, add one to bare domains; NULL when that fails."""
    c = F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
    c = _replace_all(c, URL_REPAIRS)
    # Text with a dot and no scheme looks like a domain.
    c = F.regexp_replace(c, "(?s)^(?!https?://)(?!//)(.*\\..*)$", "https://$1")
    return bind(c, lambda u: F.when(u.rlike(_HTTP), u))


def sanitize_urls(c: Column) -> Column:
    """The same over an array; unfixable entries go, an empty result is NULL."""
    kept = F.filter(F.transform(c, sanitize_url), lambda u: u.isNotNull())
    return bind(kept, lambda urls: F.when(F.size(urls) > 0, urls))


def is_http_url(c: Column) -> Column:
    host = "(?:[^\\s/?#@\\\\]*@)?(?:\\[[0-9a-fA-F:.]+\\]|[^\\s/?#:@\\\\\\[\\]]+)"
    pattern = f"(?i)^https?://{host}(?::\\d{{1,5}})?(?:[/?#].*)?$"
    return c.rlike(pattern) & (F.length(c) <= MAX_URL_LENGTH)


def normalize_url(c: Column) -> Column:
    """Canonical spelling: lower-case scheme and host, ``/`` as the empty path."""
    head = F.lower(F.regexp_extract(c, "(?i)^https?://[^/?#]*", 0))
    rest = F.regexp_replace(c, "(?i)^https?://[^/?#]*(?:/|(?=[?#])|$)", "/")
    return F.concat(head, rest)
