"""Provider payloads (JSON text) mapped to supplier fields. A payload is parsed once into a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.functions.domains import company_domain, registrable_domain
from spendweave.functions.text import truncate

FIELDS = ["domain", "industry", "naics", "sic", "description", "country", "parent_name", "parent_domain"]

# Spellings of each field in company payloads, first match wins. "a.b" is a nested member.
GENERIC = {
    "domain": ["domain", "primary_domain", "website", "url", "company_domain", "homepage"],
    "industry": ["industry", "industry_name", "sector", "primary_industry", "category", "industry.name", "industry.label", "industry.description"],
    "naics": ["naics", "naics_code", "naicsCode", "primary_naics", "naics_2022", "industry.naics", "industry.code"],
    "sic": ["sic", "sic_code", "sicCode", "primary_sic"],
    "description": ["description", "long_description", "short_description", "summary", "about", "tagline"],
    "country": ["country", "country_name", "hq_country", "country_code", "location.country", "location.country_name"],
    "parent_name": ["parent_name", "parent_company_name", "ultimate_parent_name"],
    "parent_domain": ["parent_domain", "parent_website"],
}
DIRECTORY = {
    "domain": ["domain", "company_domain", "website", "company_website", "url", "company_url", "linkedin_url", "about.website"],
    "industry": ["industry", "industries", "company_industry", "sector", "primary_industry", "category", "about.industry"],
    "naics": ["naics", "naics_code", "naicsCode", "primary_naics", "naics_2022", "industry.naics", "industry.code"],
    "sic": ["sic", "sic_code", "sicCode", "primary_sic"],
    "description": ["description", "about", "company_description", "short_description", "long_description", "summary", "overview", "tagline", "about.description"],
    "country": ["country", "country_name", "country_code", "hq_country", "headquarters_country", "location.country", "about.country"],
    "parent_name": ["parent_name", "parent_company_name", "ultimate_parent_name", "hq_company"],
    "parent_domain": ["parent_domain", "parent_website"],
}
PARENT_OBJECTS = ["parent", "parent_company", "ultimate_parent"]
PARENT_NAME = ["name", "company_name", "legal_name"]
PARENT_DOMAIN = ["domain", "website", "url"]


class _Opened:
    """Rows with the members needed read out of the payload's company object, stage by stage.

    Each member is read once into its own column (``_v`` value, ``_k`` kind, ``_t`` text, ``_l`` list text),
    so the picks below are short SQL over columns.
    """

    def __init__(self, rows: DataFrame, column: str, wrappers: list[str], paths: list[str], lists: bool):
        kept = [c for c in rows.columns if c not in FIELDS]
        names = [f"`{c}`" for c in kept]
        self.at = {path: n for n, path in enumerate(dict.fromkeys(paths))}
        self.kept, self.lists = kept, lists
        ids = self.at.values()
        parsed = rows.selectExpr(*names, f"try_parse_json(`{column}`) AS _parsed")
        parsed = parsed.selectExpr("*", *[f"try_variant_get(_parsed, '$.{w}', 'variant') AS _w{w}" for w in wrappers])
        company = "CASE " + " ".join(f"WHEN schema_of_variant(_w{w}) LIKE 'OBJECT%' THEN _w{w}" for w in wrappers) + " ELSE _parsed END AS _company"
        members = parsed.selectExpr(*names, company).selectExpr(*names, *[f"try_variant_get(_company, '$.{p}', 'variant') AS _v{n}" for p, n in self.at.items()])
        kinds = members.selectExpr("*", *[f"coalesce(schema_of_variant(_v{n}), 'VOID') AS _k{n}" for n in ids])
        plain = "RLIKE '^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)'"
        texts = [f"CASE WHEN _k{n} {plain} THEN trim(try_variant_get(_v{n}, '$', 'string')) END AS _t{n}" for n in ids]
        joined = [f"{_joined(n)} AS _l{n}" for p, n in self.at.items() if lists and "." not in p]
        self.rows = kinds.selectExpr("*", *texts, *joined)

    def text(self, path: str) -> str:
        return f"nullif(_t{self.at[path]}, '')"

    def pick(self, paths: list[str]) -> str:
        tries = []
        for path in paths:
            tries.append(self.text(path))
            if self.lists and "." not in path:
                tries.append(f"nullif(_l{self.at[path]}, '')")
        return f"coalesce({', '.join(tries)})"

    def nested_parent(self, names: list[str]) -> str:
        """Member of the first of the parent values that is an object."""
        cases = [f"WHEN _k{self.at[h]} LIKE 'OBJECT%' THEN {self.pick([f'{h}.{n}' for n in names])}" for h in PARENT_OBJECTS]
        return f"CASE {' '.join(cases)} END"

    def string_parent(self, holders: list[str]) -> str:
        """First parent value that is present, when it is a text."""
        cases = [f"WHEN _k{self.at[h]} <> 'VOID' THEN CASE WHEN _k{self.at[h]} = 'STRING' THEN {self.text(h)} END" for h in holders]
        return f"CASE {' '.join(cases)} END"


def _joined(n: int) -> str:
    """Texts of a list value joined by commas; list objects give their name, label or value."""
    own = "CASE WHEN schema_of_variant(i) = 'STRING' THEN nullif(trim(try_variant_get(i, '$', 'string')), '') END"
    members = ", ".join(f"nullif(trim(try_variant_get(i, '$.{m}', 'string')), '')" for m in ("name", "label", "value"))
    items = f"transform(try_variant_get(_v{n}, '$', 'array<variant>'), i -> coalesce({own}, {members}))"
    return f"CASE WHEN _k{n} LIKE 'ARRAY%' THEN array_join(array_compact({items}), ', ') END"


def _country(c: Column) -> Column:
    """One country: the first of a list of two-letter codes; null for other comma texts such as places."""
    parts = F.filter(F.transform(F.split(c, ","), F.trim), lambda p: p != "")
    listed = F.size(parts) > 1
    all_iso = F.forall(parts, lambda p: p.rlike("^[A-Za-z]{2}$"))
    return F.when(~listed, F.trim(c)).when(all_iso, F.get(parts, 0))


def _digits(c: Column, most: int) -> Column:
    return F.nullif(F.substring(F.regexp_replace(c, r"\D", ""), 1, most), F.lit(""))


def _paths(table: dict[str, list[str]], more: list[str]) -> list[str]:
    nested = [f"{h}.{n}" for h in PARENT_OBJECTS for n in PARENT_NAME + PARENT_DOMAIN]
    return [p for paths in table.values() for p in paths] + PARENT_OBJECTS + nested + more


def _finish(o: _Opened, table: dict[str, list[str]], country=lambda c: c, domain=registrable_domain, parents: list[str] = (), description: str = "CAST(NULL AS STRING)") -> DataFrame:
    raw = {name: o.pick(paths) for name, paths in table.items()}
    raw["parent_name"] = f"coalesce({', '.join([raw['parent_name'], *(parents or [o.nested_parent(PARENT_NAME)])])})"
    raw["parent_domain"] = f"coalesce({raw['parent_domain']}, {o.nested_parent(PARENT_DOMAIN)})"
    names = [f"`{c}`" for c in o.kept]
    picked = o.rows.selectExpr(*names, *[f"{sql} AS _{f}" for f, sql in raw.items()], f"{description} AS _more")
    shaped = {
        "domain": domain(F.col("_domain")),
        "industry": truncate(F.col("_industry"), 200),
        "naics": _digits(F.col("_naics"), 8),
        "sic": _digits(F.col("_sic"), 6),
        "description": F.coalesce(truncate(F.col("_description"), 1200), truncate(F.col("_more"), 600)),
        "country": truncate(country(F.col("_country")), 100),
        "parent_name": F.nullif(F.trim("_parent_name"), F.lit("")),
        "parent_domain": registrable_domain(F.col("_parent_domain")),
    }
    return picked.select(*o.kept, *[shaped[f].alias(f) for f in FIELDS])


def normalize_generic(rows: DataFrame, column: str = "payload") -> DataFrame:
    return _finish(_Opened(rows, column, ["company", "data", "result"], _paths(GENERIC, []), lists=False), GENERIC)


def normalize_tech(rows: DataFrame, column: str = "payload") -> DataFrame:
    """As generic, with a text parent accepted and a description made of the technologies list."""
    o = _Opened(rows, column, ["company", "data"], _paths(GENERIC, ["parentCompany", "technologies"]), lists=False)
    tools = f"concat('Technologies: ', array_join(slice(try_variant_get(_v{o.at['technologies']}, '$', 'array<string>'), 1, 12), ', '))"
    return _finish(o, GENERIC, parents=[o.nested_parent(PARENT_NAME), o.string_parent(["parent", "parentCompany", "ultimate_parent"])], description=tools)


def normalize_directory(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Flat dataset records: list values, directory hosts refused as domains, one country of many."""
    o = _Opened(rows, column, ["company", "data"], _paths(DIRECTORY, []), lists=True)
    return _finish(o, DIRECTORY, country=_country, domain=company_domain, parents=[o.string_parent(PARENT_OBJECTS), o.nested_parent(PARENT_NAME)])


PROVIDERS = {"tech": normalize_tech, "directory": normalize_directory}


def normalize_provider(rows: DataFrame, provider: str, column: str = "payload") -> DataFrame:
    """Mapping of one provider; unknown ones are read as generic."""
    return PROVIDERS.get(provider, normalize_generic)(rows, column)


def normalize_payloads(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Dispatch on the ``provider`` column."""
    provider = F.coalesce("provider", F.lit("generic"))
    out = normalize_generic(rows.where(~provider.isin(*PROVIDERS)), column)
    for name, normalize in PROVIDERS.items():
        out = out.unionByName(normalize(rows.where(provider == name), column))
    return out


def mapping_coverage(normalized: DataFrame) -> DataFrame:
    """Per provider, how many rows have each field after mapping."""
    return normalized.groupBy("provider").agg(F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f"with_{f}") for f in FIELDS])
