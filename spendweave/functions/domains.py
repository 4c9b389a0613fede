"""Web domain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendweave.functions.text import entity_key

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.jp", "or.jp", "ne.jp", "com.au", "net.au", "org.au", "co.nz", "com.br",
    "com.mx", "com.cn", "com.hk", "com.sg", "co.in", "co.za", "com.tr", "com.tw",
]

# Directory and social sites that are never a company's own domain.
DIRECTORY_HOSTS = [
    "linkedin.com", "crunchbase.com", "owler.com", "zoominfo.com", "glassdoor.com", "indeed.com", "bloomberg.com",
    "dnb.com", "pitchbook.com", "tracxn.com", "apollo.io", "facebook.com", "twitter.com", "x.com", "instagram.com",
    "youtube.com", "wikipedia.org", "g2.com", "trustpilot.com",
]


# Labels, then either a name under a two-label suffix or a name under a top-level domain.
REGISTRABLE = (
    r"^(?:[a-z0-9-]+\.)*?([a-z0-9-]+\.(?:" + "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES) + r")|[a-z0-9-]+\.[a-z]{2,})$"
)


def registrable_domain(value: Column) -> Column:
    """Registrable domain of a URL, host or email address, else null."""
    host = F.lower(F.trim(value))
    host = F.regexp_replace(host, "(?s)^.*@", "")
    host = F.regexp_replace(host, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(host, r"(?s)[/?#:].*$", "")
    host = F.regexp_replace(host, r"\.+$", "")
    host = F.regexp_replace(host, r"^www\d?\.", "")
    return F.nullif(F.regexp_extract(host, REGISTRABLE, 1), F.lit(""))


def guessed_domain(name: Column) -> Column:
    first = F.substring_index(entity_key(name), " ", 1)
    return F.when(first.rlike("^[a-z0-9]{3,}$"), F.concat(first, F.lit(".com")))


def single_word_domain(name: Column) -> Column:
    """Domain guessed offline from a one-word name of four or more characters."""
    key = entity_key(name)
    usable = ~key.rlike(r"\s") & (F.length(key) >= 4)
    return F.when(usable, F.concat(F.regexp_replace(key, "[^a-z0-9]", ""), F.lit(".com")))


def company_domain(value: Column) -> Column:
    """Registrable domain unless it belongs to a directory site."""
    listed = "|".join(host.replace(".", r"\.") for host in DIRECTORY_HOSTS)
    return F.nullif(F.regexp_replace(registrable_domain(value), rf"^(?:.*\.)?(?:{listed})$", ""), F.lit(""))


def lookup_url(name: Column, domain: Column, template: str | None) -> Column:
    """Lookup URL from a template with ``{domain}``, ``{slug}`` and ``{name}``; without one, the site itself."""
    host = F.regexp_replace(F.coalesce(domain, F.lit("")), r"(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(host, r"/+$", ""), r"(?i)^www\.", "")
    if template and template.strip():
        url = F.replace(F.lit(template.strip()), F.lit("{domain}"), host)
        url = F.replace(url, F.lit("{slug}"), F.substring_index(host, ".", 1))
        url = F.replace(url, F.lit("{name}"), F.trim(name))
        return F.nullif(F.trim(url), F.lit(""))
    return F.when(host != "", F.concat(F.lit("https://"), host))
