"""SC23: which fields that a reader of a resume gave are kept: grounded lists, job types of a closed set, half years, and a year that stands in the text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postgrove.functions.skills import skill_list
from postgrove.functions.text import list_clean, squeezed, trimmed
from postgrove.functions.urls import let

# How many entries a list may have, how long one may be, and the bounds of years.
MOST_SKILLS, MOST_ROLES, MOST_PLACES, LONGEST = 25, 5, 5, 60
MOST_YEARS, FIRST_YEAR, LAST_YEAR = 50, 1950, 2100


def grounded_list(values: Column, text: Column, most: int) -> Column:
    """Entries that are short and stand in the text, each once in any case, the first ``most``."""
    given = F.transform(F.coalesce(values, F.array().cast("array<string>")), trimmed)

    def fit(hay: Column) -> Column:
        short = F.filter(given, lambda v: (v != "") & (F.length(v) <= LONGEST))
        return F.filter(short, lambda v: (squeezed(v) != "") & hay.contains(squeezed(v)))

    return list_clean(let(squeezed(text), fit), most)


def years_of_experience(value: Column) -> Column:
    """0 to 50, to the nearest half year; anything else is null. ``value`` may be a text."""
    n = value.try_cast("double")
    return F.when(n.between(0, MOST_YEARS), F.floor(n * 2 + 0.5) / 2)


def graduation_year(value: Column, text: Column) -> Column:
    v = trimmed(value)
    return F.when(v.rlike(r"^\d{4}$") & v.try_cast("int").between(FIRST_YEAR, LAST_YEAR) & text.contains(v), v)


def accepted(profile: dict[str, Column], text: Column, job_type) -> Column:
    """SC23 over the raw fields (skills, roles, places, job_types, years, graduation): the profile that is kept. ``job_type`` maps a spelling to its kind (RK5)."""
    kinds = F.array_distinct(F.array_compact(F.transform(F.coalesce(profile["job_types"], F.array().cast("array<string>")), job_type)))
    return F.struct(
        skill_list(grounded_list(profile["skills"], text, MOST_SKILLS)).alias("skills"),
        grounded_list(profile["roles"], text, MOST_ROLES).alias("roles"),
        grounded_list(profile["places"], text, MOST_PLACES).alias("places"),
        kinds.alias("job_types"),
        years_of_experience(profile["years"]).alias("years"),
        graduation_year(profile["graduation"], text).alias("graduation"),
    )
