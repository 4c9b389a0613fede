"""Provider payloads, mapping coverage, lookup URLs and the enrichment run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.catalog import checksql as q
from spendweave.catalog.registry import query
from spendweave.catalog.views import Tables, with_views
from spendweave.functions import domains, payloads
from spendweave.functions.payloads import FIELDS
from spendweave.params import Params
from spendweave.plans.enrich import enrich_run as run

P = Params()

# What each payload of v_payloads maps to, by provider.
MAPPED = """mapped AS (SELECT p.id, p.provider,
  CASE p.provider WHEN 'generic' THEN CASE WHEN s.domain IS NULL THEN 'example.org' ELSE 'example.com' END WHEN 'tech' THEN CASE WHEN s.domain IS NOT NULL THEN 'example.com' END END AS domain,
  CASE p.provider WHEN 'generic' THEN s.industry WHEN 'directory' THEN concat(s.industry, ', Trade') END AS industry,
  CASE p.provider WHEN 'generic' THEN concat('33', CAST(p.id AS VARCHAR)) END AS naics, CAST(NULL AS VARCHAR) AS sic,
  CASE p.provider WHEN 'tech' THEN concat('Technologies: a, b, ', s.country) END AS description,
  CASE p.provider WHEN 'generic' THEN s.country WHEN 'directory' THEN 'US' END AS country,
  CASE p.provider WHEN 'tech' THEN concat('Holding ', s.industry) END AS parent_name, CAST(NULL AS VARCHAR) AS parent_domain
  FROM v_payloads p JOIN v_suppliers s ON s.id = p.id)"""


def _of(t: Tables, provider: str, normalize) -> DataFrame:
    return normalize(t.payloads.where(F.col("provider") == provider)).select("id", *FIELDS)


COLUMNS = "id, domain, industry, naics, sic, description, country, parent_name, parent_domain"


@query("payload_generic", with_views(f"SELECT {COLUMNS} FROM mapped WHERE provider = 'generic'", MAPPED))
def payload_generic(t: Tables) -> DataFrame:
    return _of(t, "generic", payloads.normalize_generic)


@query("payload_tech", with_views(f"SELECT {COLUMNS} FROM mapped WHERE provider = 'tech'", MAPPED))
def payload_tech(t: Tables) -> DataFrame:
    return _of(t, "tech", payloads.normalize_tech)


@query("payload_directory", with_views(f"SELECT {COLUMNS} FROM mapped WHERE provider = 'directory'", MAPPED))
def payload_directory(t: Tables) -> DataFrame:
    return _of(t, "directory", payloads.normalize_directory)


@query(
    "dq_coverage",
    with_views("SELECT provider, count(*) AS rows, " + ", ".join(f"count({f}) AS with_{f}" for f in FIELDS) + " FROM mapped GROUP BY 1", MAPPED),
)
def dq_coverage(t: Tables) -> DataFrame:
    return payloads.mapping_coverage(payloads.normalize_payloads(t.payloads))


@query(
    "lookup_url",
    with_views("""SELECT id, concat('https://www.linkedin.com/company/', coalesce(string_split(domain, '.')[1], ''), '?q=', trim(name)) AS profile, CASE WHEN domain IS NOT NULL THEN concat('https://', domain) END AS site FROM v_suppliers"""),
)
def lookup_url(t: Tables) -> DataFrame:
    url = F.concat(F.lit("HTTPS://www."), F.col("domain"), F.lit("/"))
    return t.suppliers.select(
        "id", domains.lookup_url(F.col("name"), url, "https://www.linkedin.com/company/{slug}?q={name}").alias("profile"), domains.lookup_url(F.col("name"), url, None).alias("site")
    )


def stub_lookup():
    """Lookup stand-in: every third supplier fails, the others answer from their own row."""

    def lookup(pdf):
        out = pdf[["id"]].copy()
        out["payload"] = ['{"data": {"sector": "Sector %d", "naics": "NAICS %d", "parent": {"name": "Parent %d Inc"}}}' % (i % 7, 330000 + i % 90, i % 4) if i % 3 else None for i in pdf["id"]]
        out["error"] = [None if i % 3 else "HTTP 500" for i in pdf["id"]]
        out["credits"] = [1 if i % 3 else 0 for i in pdf["id"]]
        return out

    return lookup


@query(
    "enrich_run",
    with_views(f"""SELECT status, count(*) AS suppliers, count(CASE WHEN status = 'enriched' AND length(industry) < length('Sector 1') THEN 1 END) AS needs_reclassification FROM (
SELECT s.industry, CASE WHEN l.cache_key IS NOT NULL THEN 'cached' WHEN s.id % 3 = 0 THEN 'failed' ELSE 'enriched' END AS status FROM v_suppliers s
LEFT JOIN (SELECT * FROM v_cache WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2001-11-15 00:00:00') l ON l.cache_key = concat('generic:', {q.key('s.name')})
WHERE s.enriched_at IS NULL OR s.enriched_at < TIMESTAMP '2001-11-15 00:00:00') x GROUP BY 1"""),
)
def enrich_run(t: Tables) -> DataFrame:
    return run(t.registry, t.cache, P, lookup=stub_lookup(), force=False, targets=t.suppliers.where("enriched_at IS NULL OR enriched_at < TIMESTAMP_NTZ '2001-11-15 00:00:00'"))["summary"]
