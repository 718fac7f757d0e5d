"""Link functions over pages and literal links."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrove.functions import urls as U
from postgrove.operators import pages as A
from postgrove.plans.registry import query
from postgrove.session import read_table

_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '\.+$', ''), '^www\.', '')"


@query("host_of_url", f"SELECT page_id, {_HOST} AS host FROM pages")
def host_of_url(spark, sf_dir):
    """UR2."""
    return read_table(spark, sf_dir, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))


@query("host_counts", f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    """AGG9's host facet, SRT8."""
    return read_table(spark, sf_dir, "pages").groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("url_normalize_subset", rf"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
        [x FOR x IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') IF x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^(utm_[a-z_]*|fbclid|gclid|msclkid|igshid|mc_[a-z]+|ref|ref_src|source|src|campaign)$', 'i')] AS kept FROM pages),
    q AS (SELECT page_id, host, CASE WHEN path = '' THEN '/' ELSE path END AS path, CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS query FROM p)
    SELECT page_id, 'https://' || host || CASE WHEN path <> '/' AND query = '' THEN regexp_replace(path, '/$', '') ELSE path END || query AS link FROM q""")
def url_normalize(spark, sf_dir):
    """UR1 on the pages' links, which are ASCII and wrapped in nothing."""
    return read_table(spark, sf_dir, "pages").select("page_id", U.normalize(F.col("url")).alias("link"))


@query("url_normalize_literals", """SELECT * FROM (VALUES (1, 'https://example.com/jobs'), (2, 'https://a.example/x?id=5'), (3, 'https://real.example/apply'), (4, NULL), (5, NULL), (6, 'https://example.com/'),
    (7, 'https://example.com:8443/a?b=1'), (8, 'https://h.example/p')) t(id, link)""")
def url_normalize_literals(spark, sf_dir):
    """UR1 on literal links: case and www., tracking, a wrapper, other schemes, nothing, a bare host, user and port, invisible characters."""
    rows = [
        (1, "HTTP://WWW.Example.COM/jobs/"), (2, "https://a.example/x?utm_source=t&id=5&ref=z#top"), (3, "https://w.example/go?u=1&url=https%3A%2F%2Freal.example%2Fapply"),
        (4, "mailto:a@b.example"), (5, "  "), (6, "example.com"), (7, "https://me:pw@example.com:8443/a?b=1"), (8, "https://h.example/​p"),
    ]
    return spark.createDataFrame(rows, "id int, raw string").select("id", U.normalize(F.col("raw")).alias("link"))


_CASES = [
    (1, None, None, "unresolvable"), (2, "https://intranet/apply", None, "unresolvable"), (3, "https://freshershunt.in/apply/1", None, "aggregator"), (4, "https://blog.freshershunt.in/x", None, "aggregator"),
    (5, "https://bit.ly/abc", None, "wrapper"), (6, "https://acme.wd1.myworkdayjobs.com/x", None, "direct"), (7, "https://forms.gle/abc", None, "direct"), (8, "https://docs.google.com/forms/d/1", None, "direct"),
    (9, "https://docs.google.com/document/1", None, "suspicious"), (10, "https://www.linkedin.com/jobs/1", None, "suspicious"), (11, "https://isro.gov.in/x", None, "direct"), (12, "https://acme.com/x", "Acme Pvt Ltd", "direct"),
    (13, "https://acme.com/x", "Bolt", "suspicious"), (14, "https://careers.bolt.com/", None, "direct"), (15, "https://bolt.com/apply?id=1", None, "direct"), (16, "https://fresherjobs.example.com/apply", None, "suspicious"),
    (17, "https://site.com/tcs-off-campus-drive/", None, "suspicious"), (18, "https://xn--bcher-kva.com/apply", None, "suspicious"), (19, "https://tata-elxsi.com/x", "Tata Elxsi", "direct"), (20, "https://off-campus.example.com/jobs", None, "suspicious"),
]
_Q = lambda v: "NULL" if v is None else f"'{v}'"


@query("url_verdict_literals", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, _, _, v in _CASES) + ") t(id, verdict)")
def url_verdict_literals(spark, sf_dir):
    """UR3-UR8, JN9: a literal link for each rule."""
    df = spark.createDataFrame([c[:3] for c in _CASES], "id int, raw string, company string")
    return df.select("id", U.verdict(F.col("raw"), F.col("company")).alias("verdict"))


@query("url_verdict", rf"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, regexp_matches(host, '(^|\.)xn--|{'|'.join(U.SUSPICIOUS_PARTS)}') OR regexp_matches(regexp_replace(host, '[^a-z0-9]', '', 'g'), '{'|'.join(x.replace('-', '') for x in U.SUSPICIOUS_PARTS)}')
        OR regexp_matches(path, '{U.ARTICLE_SLUG[4:]}', 'i') AS odd FROM p)
    SELECT page_id, CASE WHEN NOT contains(host, '.') THEN 'unresolvable' WHEN regexp_matches(host, '(^|\.)({'|'.join(U.AGGREGATORS)})$') THEN 'aggregator' WHEN regexp_matches(host, '(^|\.)({'|'.join(U.WRAPPERS)})$') THEN 'wrapper'
        WHEN regexp_matches(host, '(^|\.)({'|'.join(U.APPLICANT_SYSTEMS + U.FORM_HOSTS)})$') THEN 'direct' WHEN regexp_matches(host, '(^|\.)({'|'.join(U.JOB_BOARDS + U.FORM_PATH_HOSTS)})$') THEN 'suspicious'
        WHEN regexp_matches(host, '{U.OFFICIAL_SUFFIX[4:]}') THEN 'direct' WHEN NOT odd AND (list_has_any(string_split(host, '.'), {U.CAREER_LABELS!r}) OR regexp_matches(path, '{U.APPLY_PATH[4:]}', 'i')) THEN 'direct' ELSE 'suspicious' END AS verdict FROM s""")
def url_verdict(spark, sf_dir):
    """UR3 over the pages' links, without a company."""
    return read_table(spark, sf_dir, "pages").select("page_id", U.verdict(F.col("url"), F.lit(None).cast("string")).alias("verdict"))


@query("public_links", "SELECT * FROM (VALUES (1, 'https://bit.ly/a'), (2, NULL), (3, 'https://forms.gle/a'), (4, NULL)) t(id, link)")
def public_links(spark, sf_dir):
    """UR10: a verified wrapper, an unverified one, an unverified form, no link."""
    df = spark.createDataFrame([(1, "https://bit.ly/a", True), (2, "https://bit.ly/a", None), (3, "https://forms.gle/a", False), (4, None, True)], "id int, apply_url string, verified boolean")
    return df.select("id", U.public_link(F.col("apply_url"), F.col("verified"), F.lit(None).cast("string")).alias("link"))


@query("link_candidates", """SELECT * FROM (VALUES (1, 1, 'https://a.example/jobs', 8, 'high', TRUE), (1, 2, 'https://b.example/x', 6, 'high', FALSE), (2, 1, 'https://c.example/', 6, 'high', FALSE), (2, 2, 'https://d.example/', 5, 'high', FALSE),
    (3, 1, 'https://e.example/', 3, 'low', FALSE)) t(post, place, url, score, confidence, taken)""")
def link_candidates(spark, sf_dir):
    """SET5, SRT9, UR14, UR15 on literal candidates."""
    rows = [(1, "https://b.example/x", 6, 0), (1, "https://a.example/jobs", 8, 1), (1, "http://www.a.example/jobs/", 3, 2), (2, "https://d.example/", 5, 0), (2, "https://c.example/", 6, 1), (3, "https://e.example/", 3, 0)]
    return U.best_candidates(spark.createDataFrame(rows, "post int, url string, score int, pos int"))


@query("redirect_walk", """SELECT * FROM (VALUES ('a', 'd', 3, 'resolved'), ('x', 'y', 1, 'loop'), ('d', 'd', 0, 'resolved'), ('n0', 'n5', 5, 'too many hops')) t(url, final, hops, outcome)""")
def redirect_walk(spark, sf_dir):
    """UR11, UR12 on literal redirects."""
    hops = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), *((f"n{k}", f"n{k + 1}") for k in range(8))]
    return U.follow(spark.createDataFrame([("a",), ("x",), ("d",), ("n0",)], "url string"), spark.createDataFrame(hops, "source string, target string"))


@query("linkify", "SELECT * FROM (VALUES (1, 'https://a.example/x,https://www.b.example,mailto:me@c.example'), (2, '')) t(id, links)")
def linkify(spark, sf_dir):
    """UR24 on literal texts."""
    df = spark.createDataFrame([(1, "see https://a.example/x or www.b.example, mail me@c.example"), (2, "nothing")], "id int, text string")
    return df.select("id", F.array_join(F.transform(U.shown_links(F.col("text")), lambda u: F.regexp_replace(u, "[.,]+$", "")), ",").alias("links"))


@query("page_anchors", r"""WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) AS inside, html FROM pages),
    h AS (SELECT page_id, unnest(regexp_extract_all(CASE WHEN length(inside) > 200 THEN inside ELSE html END, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)) AS href FROM b)
    SELECT page_id, count(*) AS n, count(DISTINCT trim(href)) AS n_distinct FROM h GROUP BY 1""")
def page_anchors(spark, sf_dir):
    """UR13's extraction over whole pages."""
    found = A.anchors(read_table(spark, sf_dir, "pages"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("href").alias("n_distinct"))
