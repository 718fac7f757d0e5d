"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for candidates of four kinds. The hash of each candidate's value is aggregated
over the corpus by distinct owners and distinct repositories: a value that many owners or many
repositories hold is a widely copied example; one that few of both hold is a live credential if its kind
says so. Assigned values and access keys are told by what stands before them, so any letters or digits
will do; bare runs (hex, opaque) must hold both.

Defined results: a null or empty text has no candidates; rows that repeat each get their own result;
a null owner or repository counts as one more owner or repository; extra columns pass through
``annotate`` untouched (clashing names are avoided by the ``_pg_`` prefix) and may have any name; a text of any length is searched whole; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postgrove.llm.common import quoted, read_table, stored

# The kinds with their patterns, in the order used to break ties of start.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEPT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])"
#: What a value must look like to be live, by kind.
LIVE = ("[A-Za-z0-9]", "[A-Za-z0-9]", "^(?=.*[0-9]).*[A-Za-z]", "^(?=.*[0-9]).*[A-Za-z]")
#: Parameters of ``annotate``: a value that more owners, or more repositories, hold is widely copied.
MAX_OWNERS, MAX_REPOS = 2, 20

SPAN = "array<struct<start:int,kind:int,end:int,hash:binary>>"
BLOCK = 256


def running_total(sizes: Column) -> Column:
    """For array<int>: the sum of all elements before each element. Blocks of BLOCK elements are summed
    on their own and then shifted, so that an array of n elements takes about n * BLOCK steps."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def sums(xs: Column) -> Column:
        """Sums before each element; the last entry is the whole."""
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    shifts = sums(F.transform(blocks, total))
    shifted = F.zip_with(blocks, F.slice(shifts, F.lit(1), F.size(blocks)), lambda xs, by: F.transform(F.slice(sums(xs), F.lit(1), F.size(xs)), lambda s: s + by))
    return F.when(F.size(sizes) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches with code-point positions: the text split at the matches gives
    what stands between them, and the sizes of both in turn add up to each start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.transform(found, F.length), lambda gap, size: gap + size)
    starts = F.zip_with(running_total(steps), F.slice(between, F.lit(1), F.size(found)), lambda before, gap: before + gap)
    spans = F.transform(
        F.arrays_zip(starts.alias("at"), found.alias("whole"), values.alias("value")),
        lambda m: F.struct(m["at"].alias("start"), F.lit(kind).alias("kind"), (m["at"] + F.length(m["whole"])).alias("end"), m["value"].alias("value")),
    )
    return F.filter(spans, lambda m: F.length(m["value"]) >= least) if least else spans


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, hash, live>> of one text, by start and then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    some = lambda when, spans: F.when(text.rlike(when), spans).otherwise(none)
    spans = F.concat(
        some(ASSIGN_KEPT, matches(text, ASSIGN, 0, value_group=1, least=6)),
        some(ACCESS, matches(text, ACCESS, 1)),
        some(HEX, matches(text, HEX, 2)),
        some(OPAQUE, matches(text, OPAQUE, 3)),
    )
    return F.transform(
        F.array_sort(spans),
        lambda m: F.struct(m["start"], m["kind"], m["end"], F.unhex(F.sha2(m["value"], 256)).alias("hash"), reduce(lambda rest, k: F.when(m["kind"] == k, m["value"].rlike(LIVE[k])).otherwise(rest), range(len(KINDS)), F.lit(False)).alias("live")),
    )


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def widely_copied(n_owners: Column, n_repos: Column, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> Column:
    return (n_owners > max_owners) | (n_repos > max_repos)


def annotate(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``docs`` without its text, plus ``_pg_spans``: every candidate with the number of distinct owners
    (n_owners) and repositories (n_repos) that hold its value, and ``secret``: true if it is live.

    A value is widely copied if more than ``max_owners`` owners or more than ``max_repos`` repositories hold it. The candidates are written once to
    the shared folder; the aggregation then moves one row per candidate, pre-aggregated before each
    shuffle, and the verdicts return by a join on the value's hash, which Spark splits where one value is hot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    scanned = stored(
        docs.select(*[quoted(c) for c in docs.columns if c != text], F.monotonically_increasing_id().alias("_pg_row"), candidates(body).alias("_pg_found")),
        "secret-candidates",
    )
    each = scanned.where(F.size("_pg_found") > 0).select(
        "_pg_row",
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_pg_owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_pg_repo"),
        F.explode("_pg_found").alias("_pg_m"),
    ).withColumn("_pg_hash", F.col("_pg_m.hash"))
    owners = each.groupBy("_pg_hash", "_pg_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("_pg_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = each.groupBy("_pg_hash", "_pg_repo").agg(F.count(F.lit(1)).alias("n")).groupBy("_pg_hash").agg(F.count(F.lit(1)).alias("n_repos"))
    judged = each.join(owners.join(repos, "_pg_hash"), "_pg_hash").select(
        "_pg_row",
        F.struct(
            *[F.col(f"_pg_m.{c}").alias(c) for c in ("start", "kind", "end", "hash")],
            "n_owners",
            "n_repos",
            (F.col("_pg_m.live") & ~widely_copied(F.col("n_owners"), F.col("n_repos"), max_owners, max_repos)).alias("secret"),
        ).alias("_pg_m"),
    )
    spans = judged.groupBy("_pg_row").agg(F.array_sort(F.collect_list("_pg_m")).alias("_pg_spans"))
    return scanned.drop("_pg_found").join(spans, "_pg_row", "left").drop("_pg_row").withColumn(
        "_pg_spans", F.coalesce("_pg_spans", F.array().cast(spans.schema["_pg_spans"].dataType))
    )


def redact(docs: DataFrame, marker: str = "[SECRET]", text: str = "text", **how) -> DataFrame:
    """``docs`` with each live secret replaced by ``marker``; examples and everything else stay.

    Documents are matched by id and text hash, so rows that repeat all get the same treatment.
    """
    key = F.xxhash64(F.col("doc_id"), F.col(text), F.lit("text"))
    keyed = docs.withColumn("_pg_key", key)
    live = (
        annotate(keyed, text=text, **how)
        .select("_pg_key", F.filter("_pg_spans", lambda m: m["secret"]).alias("_pg_live"))
        .where(F.size("_pg_live") > 0)
        .groupBy("_pg_key")
        .agg(F.first("_pg_live").alias("_pg_live"))
    )
    # Spans may overlap (a hexadecimal value inside an assignment): merged first, then cut out.
    merged = F.aggregate(
        F.transform("_pg_live", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, m: F.when(
            (F.size(acc) > 0) & (m["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], m["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(m))),
    )
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    starts = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.length(text)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    return (
        keyed.join(live, "_pg_key", "left")
        .withColumn(text, F.when(F.col("_pg_live").isNull(), F.col(text)).otherwise(F.array_join(pieces, marker)))
        .drop("_pg_key", "_pg_live")
    )


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Candidates of whole ``documents``; owners are sources, repositories are documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = annotate(docs)
    base = F.filter("_pg_spans", lambda m: m["kind"] < 3)
    kept = F.filter("_pg_spans", lambda m: (m["kind"] < 3) | m["secret"])
    count = lambda k: F.size(F.filter("_pg_spans", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(kept).alias("spans"),
        F.size(F.filter("_pg_spans", lambda m: m["secret"])).cast("long").alias("n_live"),
        F.size(F.filter("_pg_spans", lambda m: (m["kind"] < 3) & widely_copied(m["n_owners"], m["n_repos"]))).cast("long").alias("n_example"),
    )


# The same in DuckDB: RE2 has no look-around, so a maximal run of the wide class is found first.
_SPANS = """
    SELECT doc_id, source, {kind} AS kind, s AS start, s + length(m) AS stop, v AS val FROM (
        SELECT doc_id, source, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s FROM (
            SELECT doc_id, source, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
                SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS ms, regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS vs,
                    string_split_regex(coalesce(text, ''), '{pattern}') AS gaps FROM documents)))
    WHERE {keep}"""
_SQL_ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_UNION = " UNION ALL ".join(
    _SPANS.format(kind=kind, pattern=pattern, group=group, keep=keep)
    for kind, pattern, group, keep in (
        (0, _SQL_ASSIGN, 1, "length(v) >= 6"),
        (1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
        (2, "[0-9a-f]+", 0, "length(m) >= 24"),
        (3, "[A-Za-z0-9+/_-]+", 0, "length(m) >= 32 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
    )
)
SQL = f"""
WITH spans AS ({_UNION}),
owned AS (SELECT val, count(DISTINCT coalesce(source, '')) > 2 OR count(DISTINCT doc_id) > 20 AS copied FROM spans GROUP BY val),
judged AS (
    SELECT s.*, o.copied, regexp_matches(s.val, '[A-Za-z0-9]') AND (kind < 2 OR (regexp_matches(s.val, '[0-9]') AND regexp_matches(s.val, '[A-Za-z]'))) AND NOT o.copied AS secret,
        ['assign', 'access', 'hex', 'opaque'][s.kind + 1] || ':' || s.start::BIGINT || ':' || s.stop::BIGINT AS said
    FROM spans s JOIN owned o USING (val)),
byd AS (
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3 OR secret), '') AS spans,
        count(*) FILTER (secret) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_example
    FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN byd USING (doc_id)
"""
