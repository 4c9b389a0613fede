"""Name and text column expressions. All are native expressions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendweave.functions.values import once

# Legal suffixes that are dropped from the end of a name.
THREE_WORD_SUFFIXES = ["limited liability company", "limited liability partnership", "public limited company"]
TWO_WORD_SUFFIXES = ["limited partnership", "proprietary limited", "pty ltd", "pty limited"]
ONE_WORD_SUFFIXES = [
    "incorporated", "corporation", "corporate", "company", "aktiengesellschaft", "gmbh", "sarl", "sas", "srl", "spa",
    "inc", "corp", "co", "ltd", "limited", "llc", "llp", "lp", "plc", "pvt", "pte", "pty", "ag", "nv", "bv", "sa",
    "se", "oy", "ab", "aps", "kk", "kg", "holdings", "holding", "group", "international", "intl", "worldwide",
]

# Acronyms that keep their capitals.
ACRONYMS = [
    "IBM", "HP", "AMD", "SAP", "NEC", "ABB", "BMW", "UPS", "DHL", "GE", "LG", "SK", "3M", "AT&T", "BP", "GSK", "SAS",
    "ASML", "TSMC", "NTT", "KPMG", "PwC", "EY", "DXC",
]

# Words that say nothing about what is bought.
STOP_WORDS = [
    "the", "and", "for", "with", "inc", "llc", "ltd", "corp", "corporation", "company", "group", "holdings",
    "services", "service", "of", "a", "an", "co", "international", "global", "national", "general",
]

# White space as the source files use it: ASCII plus no-break and typographic spaces.
SPACE = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
PUNCTUATION = r"""[/\\|.,;:!?"'()\[\]{}–—−’‘`´“”]"""
_MANY_WORDS = "|".join(THREE_WORD_SUFFIXES + TWO_WORD_SUFFIXES)
_ANY = "|".join(THREE_WORD_SUFFIXES + TWO_WORD_SUFFIXES + ONE_WORD_SUFFIXES)
TRAILING_SUFFIXES = rf"(?: (?:{_ANY}))+$"
ONLY_SUFFIXES = rf"^(?:{_MANY_WORDS})(?: (?:{_ANY}))*$"


def squeeze(c: Column) -> Column:
    """Collapse white space and trim. Single spaces, which are most, don't match."""
    return F.trim(F.regexp_replace(c, f"{SPACE}{{2,}}|{SPACE[:-1]}&&[^ ]]", " "))


def blank_to_null(c: Column) -> Column:
    return once(squeeze(c), lambda text: F.when(text != "", text))


def has_text(c: Column) -> Column:
    """Whether anything but white space is there; ends at the first such character."""
    return F.coalesce(c.rlike(SPACE.replace("[", "[^", 1)), F.lit(False))


def _spelled_out(raw: Column) -> Column:
    text = F.coalesce(raw, F.lit(""))
    text = F.regexp_replace(text, "[&+]", " and ")
    return squeeze(F.regexp_replace(text, PUNCTUATION, " "))


def entity_key(raw: Column) -> Column:
    """Key under which spellings of one company meet; a name made of one suffix phrase keeps it."""
    key = lambda lowered: F.when(lowered.rlike(ONLY_SUFFIXES), lowered).otherwise(F.regexp_replace(lowered, TRAILING_SUFFIXES, ""))
    return once(F.lower(_spelled_out(raw)), key)


def entity_display(raw: Column) -> Column:
    words = _spelled_out(raw)
    folded = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[’‘`´]", "'"), "[“”]", '"')
    return F.when(words == "", squeeze(folded)).otherwise(words)


def had_legal_suffix(raw: Column) -> Column:
    return once(F.lower(_spelled_out(raw)), lambda lowered: lowered.rlike(ONLY_SUFFIXES) | lowered.rlike(TRAILING_SUFFIXES))


def title_case(name: Column) -> Column:
    """Calm an all-capitals name of more than four characters; short words and acronyms stay as they are."""

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, "[^A-Za-z0-9&]", "")
        keep = (F.length(bare) <= 3) | bare.isin(ACRONYMS)
        return F.when(keep, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    def calm(text: Column) -> Column:
        shouting = (F.length(text) > 4) & (text == F.upper(text))
        return F.when(shouting, F.array_join(F.transform(F.split(text, " "), word), " ")).otherwise(text)

    return once(squeeze(F.coalesce(name, F.lit(""))), calm)


def sanitize_parent(value: Column) -> Column:
    """A parent name, or null when it is a code, too long, or has no letter."""
    text = F.trim(value)
    bad = text.rlike(r"^\d+[\d.\-\s]*$") | (F.length(text) > 200) | ~text.rlike("[A-Za-z]")
    return F.when(~bad, text)


def parent_reject_reason(value: Column) -> Column:
    text = F.trim(value)
    return (
        F.when(text.isNull() | (text == ""), "blank")
        .when(text.rlike(r"^\d+[\d.\-\s]*$"), "digits")
        .when(F.length(text) > 200, "too_long")
        .when(~text.rlike("[A-Za-z]"), "no_letter")
        .otherwise("accepted")
    )


def keywords(text: Column, limit: int) -> Column:
    """First ``limit`` distinct words of four or more characters that are not stop words or numbers."""
    # whole runs of letters, digits and hyphens that are long enough and not digits only, in one pass
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?<![a-z0-9-])(?=[0-9]*[a-z-])[a-z0-9-]{4,}"), F.lit(0))
    return F.slice(F.array_except(runs, F.array(*[F.lit(w) for w in STOP_WORDS])), 1, limit)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters, as eight hex digits."""
    start = F.lit(2166136261).cast("long")
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    mixed = F.aggregate(
        chars, start, lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    )
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def enrichment_fingerprint(domain: Column, industry: Column, naics: Column, sic: Column, parent: Column, description: Column) -> Column:
    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    parts = [low(domain), low(industry), F.coalesce(naics, F.lit("")), F.coalesce(sic, F.lit("")), low(parent), fnv1a(low(description))]
    return fnv1a(F.concat_ws("|", *parts))


def richness(domain: Column, industry: Column, naics: Column, sic: Column, description: Column, is_parent: Column) -> Column:
    """How much a supplier row tells a scorer."""

    def has(c: Column, points: int) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", points).otherwise(0)

    described = F.least(F.lit(3), F.ceil(F.length(F.coalesce(description, F.lit(""))) / 120).cast("int"))
    terms = [has(domain, 3), has(industry, 3), has(naics, 2), has(sic, 1), described, F.when(is_parent, 1).otherwise(0)]
    return reduce(lambda a, b: a + b, terms)


def truncate(text: Column, limit: int) -> Column:
    """Squeezed text, cut with an ellipsis when longer than ``limit``; blank becomes null."""
    value = blank_to_null(text)
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 1), F.lit("…"))).otherwise(value)


def parent_in_name(name: Column) -> Column:
    """Parent named inside a supplier name, as in "Acme Robotics, a Schneider Electric company"."""
    pattern = r",\s*(?:an?|the)\s+([A-Z][\w&.'-]*(?:\s+[A-Z][\w&.'-]*){0,4})\s+(?:company|group|subsidiary|brand)"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
