"""Text expressions: tokens, trigram similarity, and the normal forms of names and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, acronyms with their spelling, base and compound type names, limits.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
ACRONYMS = ["API", "SQL", "AI", "ML", "LLM", "HTTP", "REST", "gRPC", "OAuth", "SSO", "JWT", "5-HT"]
BASE_TYPES = ["Asset", "Dish", "Dream", "Event", "Insight", "Location", "Device", "Activity", "Condition", "Mentalstate", "Utensil", "Preparation", "Specification"]
COMPOUND_TYPES = ["EventDrivenArchitecture", "ActivityLevel", "ConditionMonitoring", "LocationService", "AssetManagement", "InsightGeneration", "PreparationTechnique"]
ARTIFACT = r"(?i)(functiondefault|calldefault|ApicreateOr|UpdateNode|UpdateEdge|createOrUpdate|defaultApi|endcall|functionName|Updating\w*Id\d)"
SEGMENT = r"[A-Z][a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"
MAX_TYPE, MIN_TYPE, MAX_SEGMENTS = 60, 2, 5


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without stop words, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def matches_all(doc: Column, query: Column) -> Column:
    """All tokens of the query occur; an empty query matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, doc)) == 0)


def text_rank(doc: Column, query: Column) -> Column:
    """Share of the document's tokens that the query names, damped: tf / (tf + 1); 0 without a hit."""
    tf = F.size(F.filter(doc, lambda t: F.array_contains(query, t))).cast("double")
    return tf / (tf + 1)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def word_similar(a: Column, b: Column) -> Column:
    """Equal apart from case, or all words of the shorter, two at least, in the longer."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.trim(s)), r"\s+"), lambda w: w != "")) for s in (a, b))
    short = F.least(F.size(x), F.size(y))
    return (F.lower(a) == F.lower(b)) | ((short >= 2) & (F.size(F.array_intersect(x, y)) == short))


def title_case(text: Column) -> Column:
    """A capital after everything that is no letter, small letters after letters."""
    parts = F.split(F.lower(text), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def canonical_name(name: Column) -> Column:
    """Trimmed, without a bracketed alias at the end, single spaced; all-lower names get capitals and acronyms their spelling."""
    base = F.trim(name)
    base = F.when(base.rlike(r"^.+?\s*\([^)]+\)$"), F.regexp_extract(base, r"^(.+?)\s*\([^)]+\)$", 1)).otherwise(base)
    title = title_case(base)
    for a in ACRONYMS:
        title = F.regexp_replace(title, rf"(?i)\b{a}\b", a)
    return F.trim(F.regexp_replace(F.when(base == F.lower(base), title).otherwise(base), r"\s+", " "))


def bracket_alias(name: Column) -> Column:
    """The alias in brackets at the end of a name, or null."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(name), r"^.+?\s*\(([^)]+)\)$", 1)), F.lit(""))


def segments(name: Column) -> Column:
    return F.regexp_count(name, F.lit(SEGMENT))


def is_instance_level(name: Column) -> Column:
    """A base type followed by more, unless it is a known compound."""
    first = F.regexp_extract(name, SEGMENT, 0)
    return ~name.isin(COMPOUND_TYPES) & (segments(name) >= 2) & first.isin(BASE_TYPES)


def _clean(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9_ \-]", ""))


def type_reject_reason(name: Column, node: bool) -> Column:
    """Why a type name is refused, or null."""
    c = _clean(name)
    out = F.when(name.isNull() | (c == ""), "empty").when(F.length(c) < MIN_TYPE, "too short").when(c.rlike(ARTIFACT), "artifact")
    if node:
        out = out.when(is_instance_level(c), "instance level")
    return out.when(F.length(c) > MAX_TYPE, "too long").when(segments(c) > MAX_SEGMENTS, "too many segments")


def edge_type_name(name: Column) -> Column:
    """SCREAMING_SNAKE form, null where refused."""
    c = F.replace(_clean(name), F.lit("-"), F.lit("_"))
    c = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    c = F.upper(F.replace(c, F.lit(" "), F.lit("_")))
    c = F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_|_$", "")
    return F.when(type_reject_reason(name, False).isNull() & c.rlike("^[A-Z][A-Z0-9_]*$"), c)


def node_type_name(name: Column) -> Column:
    """PascalCase form, null where refused."""
    c = _clean(name)
    parts = F.filter(F.split(c, r"[_ \-]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), "")
    mixed = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    lower = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1000)))
    out = F.when(c.rlike(r"[_ \-]"), joined).when(c == F.lower(c), lower).otherwise(mixed)
    return F.when(type_reject_reason(name, True).isNull() & out.rlike("^[A-Z][A-Za-z0-9]*$"), out)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def schema_name(agent: Column, purpose: Column) -> Column:
    return F.concat(F.lit("ncx_"), slug(agent), F.lit("__"), slug(purpose))


def is_schema_name(name: Column) -> Column:
    return name.rlike("^ncx_[a-z0-9]+__[a-z0-9_]+$")


def lock_key(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 as a number below 2**63 - 1."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint")


def role_name(subject: Column) -> Column:
    return F.concat(F.lit("role_"), F.substring(slug(subject), 1, 46))


def purpose(name: Column) -> Column:
    """What follows the first double underscore; null without one."""
    return F.when(F.instr(name, "__") > 0, F.regexp_extract(name, "__(.*)$", 1))


def contains_ci(text: Column, part: Column) -> Column:
    """Substring test without case; % and _ are plain characters."""
    return F.contains(F.lower(text), F.lower(part))
