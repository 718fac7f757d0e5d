"""SRC6: the rows of all Company/Role tables of Markdown files, one file per row (``spark.read.text(path, wholetext=True)``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions.text import clean_cell, missing_cell, trimmed

# Headings by which columns are found, letters only.
COMPANY = ["company", "companyname", "employer", "organization", "organisation"]
ROLE = ["role", "title", "position", "positiontitle", "jobtitle"]
LOCATION = ["location", "locations", "city", "region", "country", "joblocation", "worklocation"]
POSTED = ["posted", "posteddate", "dateposted", "dateadded", "added", "addeddate", "dateofposting", "published", "publisheddate", "date"]
LINK = ["link", "apply", "applylink", "application", "applicationlink", "applicationurl", "applyurl", "url"]


def cells_of(line: Column) -> Column:
    """The cells of a table line; null for a line that is none."""
    text = trimmed(line)
    inner = F.regexp_replace(F.regexp_replace(text, r"^\|", ""), r"\|$", "")
    cells = F.transform(F.split(inner, r"\|", -1), trimmed)
    return F.when(text.contains("|") & (F.size(cells) >= 3), cells)


def cell_under(cells: Column, heads: Column, names: list[str]) -> Column:
    """The cell under the first of ``names`` that is a heading; empty if there is none."""
    at = lambda name: F.size(heads) - F.array_position(F.reverse(heads), name).cast("int")
    return F.coalesce(*[F.when(F.array_contains(heads, name), F.coalesce(F.get(cells, at(name)), F.lit(""))) for name in names], F.lit(""))


def link_of(cell: Column) -> Column:
    """The link that a cell carries as Markdown, as HTML or bare."""
    found = [F.nullif(F.regexp_extract(cell, p, 1), F.lit("")) for p in (r"\]\((https?://[^)\s]+)\)", r"""(?i)href=["'](https?://[^"']+)["']""", r"""(https?://[^\s<>"')]+)""")]
    return F.when(~missing_cell(trimmed(cell)), F.regexp_replace(F.coalesce(*found), r"[),.;!?]+$", ""))


def table_rows(files: DataFrame, date_of: Callable[[Column], Column]) -> DataFrame:
    """(file, pos, company, role, location, posted_on, apply_url, skipped) of ``files`` (file, value). A heading holds until a line that is no table line; rows
    without a company or a role are ``skipped`` but counted; a date that cannot be read is null."""
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("cells", cells_of(F.col("line")))
    names = F.transform("cells", lambda c: F.regexp_replace(F.lower(c), "[^a-z]", ""))
    has = lambda wanted: F.arrays_overlap(names, F.array(*[F.lit(x) for x in wanted]))
    lines = lines.withColumn("heads", F.when(has(COMPANY) & has(ROLE), names))
    order = Window.partitionBy("file").orderBy("pos")
    opens = F.when(F.col("cells").isNull() | F.col("heads").isNotNull(), 1).otherwise(0)
    parts = lines.withColumn("part", F.sum(opens).over(order))
    table = parts.withColumn("under", F.first("heads", ignorenulls=True).over(Window.partitionBy("file", "part")))
    rule = F.forall("cells", lambda c: F.regexp_replace(c, r"\s", "").rlike("^:?-{2,}:?$"))
    rows = table.where(F.col("cells").isNotNull() & F.col("heads").isNull() & F.col("under").isNotNull() & ~rule)
    of = lambda wanted: cell_under(F.col("cells"), F.col("under"), wanted)
    company, role = clean_cell(of(COMPANY)), clean_cell(of(ROLE))
    return rows.select(
        "file", "pos", company.alias("company"), role.alias("role"), F.nullif(clean_cell(of(LOCATION)), F.lit("")).alias("location"), date_of(of(POSTED)).alias("posted_on"), link_of(of(LINK)).alias("apply_url"),
        ((company == "") | (role == "")).alias("skipped"),
    )
