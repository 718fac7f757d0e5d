"""Link decisions over pages as articles, documents as posts, postings, and literal rows where the rules need given sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from postgrove.functions import posts as P, urls as U
from postgrove.operators import evidence as E, pages as A
from postgrove.plans import twins as W
from postgrove.plans.registry import query
from postgrove.sources.tables import ARTICLES_SQL, POSTINGS_SQL, POSTS_SQL, articles, cases, postings, posts

_RE = lambda p: p.removeprefix("(?i)").replace("'", "''")


def _replaced(c: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    """``c`` after several replacements by regular expressions; the last entry of a step may be its own flags."""
    for pattern, into, *own in steps:
        c = f"regexp_replace({c}, '{pattern}', {into}, '{own[0] if own else flags}')"
    return c


# ---- UR13: candidates of articles, and their twin

_NO_CONTENT = [("(?s)<!--.*?-->", "' '")] + [(rf"(?is)<{t}\b.*?</{t}\s*>", "' '") for t in ("script", "style", "noscript", "template", "svg")]


def _decoded(c: str) -> str:
    for entity, char in (("&amp;", "'&'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&nbsp;", "' '")):
        c = f"replace({c}, '{entity}', {char})"
    return c


def _attribute(name: str) -> str:
    return " || ".join(rf"""regexp_extract(tag, '\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', {k}, 'i')""" for k in (1, 2, 3))


_ARTICLE = f"regexp_extract(html, '{A.ARTICLE}', 1)"
_LABEL = _replaced(_decoded("regexp_replace(inside, '(?s)<[^>]*>', ' ', 'g')"), [("&[a-zA-Z][a-zA-Z0-9]*;", "' '"), (r"\s+", "' '")])
CANDIDATES_SQL = rf"""{ARTICLES_SQL},
    bodies AS (SELECT page_id, url, company, {_replaced(f"CASE WHEN length({_ARTICLE}) > 200 THEN {_ARTICLE} ELSE html END", _NO_CONTENT)} AS body FROM articles),
    tags AS (SELECT page_id, url, company, unnest(range(len(ts))) AS pos, unnest(ts) AS tag, unnest(xs) AS inside FROM (
        SELECT *, regexp_extract_all(body, '{A.ANCHOR}', 1) AS ts, regexp_extract_all(body, '{A.ANCHOR}', 2) AS xs FROM bodies)),
    hrefs AS (SELECT page_id, url, company, pos, {_decoded(f"trim({_attribute('href')})")} AS href, {_attribute('rel')} AS rel, trim({_LABEL}) AS label FROM tags),
    fulls AS (SELECT *, CASE WHEN href = '' OR regexp_matches(href, '^(mailto|tel|javascript|data):|^#', 'i') THEN NULL WHEN regexp_matches(href, '^https?://', 'i') THEN href WHEN starts_with(href, '//') THEN 'https:' || href
        WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]+') || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+(?:/.*)?)/[^/]*$', '\1') || '/' || href END AS whole FROM hrefs),
    {W.judged('l', 'fulls', 'whole', 'company')},
    signs AS (SELECT *, {W.host('url')} AS own, {W.under(W.host('whole'), A.AD_HOSTS)} AS ad,
        CASE WHEN l_kind = 'direct' AND {W.under('l_host', U.APPLICANT_SYSTEMS)} THEN 5 ELSE 0 END + CASE WHEN {W.matches_company('l_host', 'company')} THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(l_path, '{_RE(A.PAGE_APPLY_PATH)}', 'i') THEN 3 ELSE 0 END + CASE WHEN l_kind = 'direct' AND {W.under('l_host', U.FORM_HOSTS + U.FORM_PATH_HOSTS)} THEN 2 ELSE 0 END AS dest FROM l WHERE l_link IS NOT NULL),
    scored AS (SELECT page_id, pos, l_link AS link, nullif(substr(label, 1, 120), '') AS label,
        dest + CASE WHEN regexp_matches(label, '{_RE(A.STRONG)}', 'i') THEN 2 WHEN regexp_matches(label, '{_RE(A.WEAK)}', 'i') THEN 1 ELSE 0 END AS score
        FROM signs WHERE NOT ad AND own IS NOT NULL AND contains(l_host, '.') AND l_host <> own AND NOT ends_with(l_host, '.' || own) AND NOT {W.under('l_host', A.AD_HOSTS + A.THEME_HOSTS + A.SOCIAL_HOSTS)}
        AND NOT regexp_matches(l_path, '{_RE(A.SHARE_PATH)}', 'i') AND NOT regexp_matches(rel, '\bsponsored\b', 'i') AND NOT regexp_matches(label, '{_RE(A.UNRELATED)}', 'i') AND l_kind <> 'aggregator'
        AND dest > 0 AND NOT (regexp_matches(l_path, '{_RE(A.FRONT_DOOR)}', 'i') AND dest <= 3)),
    found AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY score DESC, pos) = 1)"""


def _candidates(spark, sf_dir):
    return A.candidates(articles(spark, sf_dir), F.col("company"))


@query("page_candidates", f"WITH {CANDIDATES_SQL} SELECT page_id, pos, link, label, score, CASE WHEN score >= 9 THEN 'highest' WHEN score >= 5 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM found")
def page_candidates(spark, sf_dir):
    """UR13, UR14, SRC8 over all pages as articles."""
    return _candidates(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))


# ---- UR15-UR17: what becomes of a posted or a stored link

_WINNERS = """ranked AS (SELECT page_id, link, score, row_number() OVER w AS place, lead(score) OVER w AS behind FROM found WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, link)),
    won AS (SELECT page_id AS won_id, count(*) AS n_found, max(CASE WHEN place = 1 AND score >= 5 AND score - coalesce(behind, 0) > 1 THEN link END) AS winner,
        max(CASE WHEN place = 1 AND score >= 5 AND score - coalesce(behind, 0) > 1 THEN score END) AS winner_score FROM ranked GROUP BY page_id)"""
_FIRST = f"""{CANDIDATES_SQL}, {_WINNERS},
    {W.judged('u', 'articles', 'url', 'company')}, {W.judged('r', 'u', 'resolved', 'company')},
    met AS (SELECT *, CASE WHEN u_kind <> 'wrapper' THEN u_kind WHEN r_link IS NULL OR r_kind = 'wrapper' THEN 'suspicious' ELSE r_kind END AS kind,
        CASE WHEN u_kind <> 'wrapper' OR r_link IS NULL THEN u_link ELSE r_link END AS link FROM r LEFT JOIN won ON page_id = won_id),
    {W.judged('w', 'met', 'winner', 'company')}"""


def _offers(spark, sf_dir):
    return _candidates(spark, sf_dir).select(F.col("page_id").alias("post"), F.col("link").alias("url"), "score", "pos")


@query("ingest_decisions", f"""WITH {_FIRST} SELECT page_id AS id, CASE WHEN kind = 'direct' THEN link WHEN kind = 'aggregator' AND page_id % 13 <> 0 AND w_kind = 'direct' THEN w_link END AS apply_url, CASE WHEN kind = 'aggregator' THEN link END AS source_url,
    CASE WHEN kind <> 'aggregator' THEN kind WHEN page_id % 13 = 0 THEN 'page unreadable' WHEN n_found IS NULL THEN 'no candidate' WHEN winner IS NULL THEN 'none conclusive' WHEN w_kind = 'direct' THEN 'resolved from the page' ELSE 'best candidate is not direct' END AS reason FROM w""")
def ingest_decisions(spark, sf_dir):
    """UR12, UR15, UR16 over all pages as posts with their articles; every thirteenth page cannot be read."""
    rows = articles(spark, sf_dir).select(F.col("page_id").alias("id"), "url", "resolved", "company", (F.col("page_id") % 13 != 0).alias("readable"))
    return E.ingest_decision(rows, _offers(spark, sf_dir))


_REPAIRED = f"""{_FIRST},
    told AS (SELECT page_id AS id, url, status, u_kind, kind, link, w_link, winner_score, coalesce(kind = 'aggregator' AND winner IS NOT NULL AND w_kind = 'direct', false) AS won_it,
        coalesce(status = 'pending' OR (status = 'verified' AND (u_kind = 'direct' OR (kind = 'direct' AND link = url))), false) AS stays FROM w),
    repaired AS (SELECT id, CASE WHEN stays THEN 'unchanged' WHEN kind = 'direct' OR won_it THEN 'repaired' ELSE 'flagged' END AS outcome,
        CASE WHEN stays THEN url WHEN kind = 'direct' THEN link WHEN kind = 'unresolvable' AND link IS NULL THEN NULL WHEN won_it THEN w_link WHEN kind = 'aggregator' THEN NULL ELSE url END AS apply_url,
        CASE WHEN stays THEN status WHEN kind = 'direct' OR won_it THEN 'verified' WHEN url IS NULL THEN 'pending' ELSE 'needs_review' END AS url_status,
        CASE WHEN NOT stays AND kind = 'aggregator' THEN link ELSE 'kept' END AS source_url, CASE WHEN stays THEN u_kind WHEN won_it THEN 'direct' ELSE kind END AS verdict, CASE WHEN won_it AND NOT stays THEN winner_score END AS score FROM told)"""


def _repaired(spark, sf_dir):
    rows = articles(spark, sf_dir).select(F.col("page_id").alias("id"), F.col("url").alias("apply_url"), F.col("status").alias("url_status"), F.lit("kept").alias("source_url"), "company", "resolved")
    return E.repair_decision(rows, _offers(spark, sf_dir))


@query("repair_decisions", f"WITH {_REPAIRED} SELECT * FROM repaired")
def repair_decisions(spark, sf_dir):
    """UR17 over all pages as stored postings with their articles."""
    return _repaired(spark, sf_dir)


@query("repair_counts", f"WITH {_REPAIRED} SELECT outcome, count(*) AS n FROM repaired GROUP BY outcome")
def repair_counts(spark, sf_dir):
    """UR17, AGG14."""
    return _repaired(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("repair_of_postings", f"""WITH {POSTINGS_SQL} SELECT CASE WHEN url_status = 'pending' OR (url_status = 'verified' AND apply_url IS NOT NULL) THEN 'unchanged' WHEN apply_url IS NULL THEN 'flagged' ELSE 'repaired' END AS outcome, count(*) AS n
    FROM postings GROUP BY 1""")
def repair_of_postings(spark, sf_dir):
    """UR17 over the postings stand-in, whose links are direct and in normal form and whose statuses are of all kinds."""
    none = F.lit(None).cast("string")
    rows = postings(spark, sf_dir).select("id", "apply_url", "url_status", "source_url", none.alias("company"), none.alias("resolved"))
    offers = spark.createDataFrame([], "post long, url string, score int, pos int")
    return E.repair_decision(rows, offers).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- UR18: links in a body

_BODY = rf"""{POSTS_SQL}, b AS (SELECT id, text, regexp_extract_all(text, '{_RE(E.BODY_LINK)}', 0, 'i') AS us, string_split_regex(text, '(?i){_RE(E.BODY_LINK)}') AS gaps FROM posts),
    each_ AS (SELECT id, text, i, us[i] AS whole, regexp_replace(us[i], '{E.BODY_TAIL}', '') AS raw, length(array_to_string(gaps[1:i], '')) + length(array_to_string(us[1:i - 1], '')) AS start FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM b)),
    said AS (SELECT *, regexp_matches(substr(text, greatest(start - 120, 0) + 1, least(start, 120)), '{_RE(E.CALLS)}', 'i') OR regexp_matches(substr(text, start + length(raw) + 1, 120), '{_RE(E.CALLS)}', 'i') AS calls FROM each_)"""


@query("body_links", f"WITH {_BODY} SELECT id, raw, start, calls FROM said")
def body_links(spark, sf_dir):
    """UR18 over all documents as posts."""
    return posts(spark, sf_dir).select("id", F.explode(E.body_links(F.col("text"))).alias("x")).select("id", "x.raw", F.col("x.at").cast("long").alias("start"), "x.calls")


@query("body_rewrite", rf"""WITH {_BODY},
    news AS (SELECT id, i, CASE WHEN calls AND raw = 'https://freshershunt.in/p/1' THEN 'https://new.example/1' ELSE raw END || substr(whole, length(raw) + 1) AS said FROM said),
    lines AS (SELECT id, list(said ORDER BY i) AS saids FROM news GROUP BY id)
    SELECT id, md5(CASE WHEN saids IS NULL THEN text ELSE array_to_string([gaps[k] || coalesce(saids[k], '') FOR k IN range(1, len(gaps) + 1)], '') END) AS digest, contains(text, '/p/1.') AS had_it FROM b LEFT JOIN lines USING (id)""")
def body_rewrite(spark, sf_dir):
    """UR18 over all documents as posts: one aggregator's link gets its direct one where words call to apply; a longer link that starts like it stays."""
    better = F.create_map(F.lit("https://freshershunt.in/p/1"), F.lit("https://new.example/1"))
    return posts(spark, sf_dir).select("id", F.md5(E.rewritten(F.col("text"), better)).alias("digest"), F.contains("text", F.lit("/p/1.")).alias("had_it"))


# ---- UR19: other sources of links

@query("search_tiers", f"""WITH {ARTICLES_SQL}, {W.judged('u', 'articles', 'url', 'company')},
    t AS (SELECT page_id // 20 AS job, page_id AS place, u_link AS link, role AS label, CASE WHEN {W.under('u_host', U.APPLICANT_SYSTEMS)} THEN 80 WHEN {W.matches_company('u_host', 'company')} THEN 100 WHEN regexp_matches(u_link, '/careers?|/jobs?|/apply', 'i') THEN 40 ELSE 20 END AS tier
        FROM u WHERE u_kind = 'direct')
    SELECT job, row_number() OVER (PARTITION BY job ORDER BY tier DESC, place) AS rank, link, tier // 10 AS score, CASE WHEN tier >= 80 THEN 'high' ELSE 'medium' END AS confidence, label FROM t""")
def search_tiers(spark, sf_dir):
    """UR19's search ranking: all pages as search results, twenty to a job."""
    rows = articles(spark, sf_dir).select(F.floor(F.col("page_id") / 20).alias("job"), F.col("page_id").alias("place"), "url", F.col("role").alias("title"), "company")
    return E.search_results(rows)


@query("mapped_links", rf"""WITH {ARTICLES_SQL}, {W.judged('u', 'articles', 'url', 'company')},
    t AS (SELECT page_id // 20 AS job, u_link AS link, CASE WHEN {W.under('u_host', U.APPLICANT_SYSTEMS)} THEN 3 ELSE 0 END + CASE WHEN {W.matches_company('u_host', 'company')} THEN 3 ELSE 0 END + CASE WHEN regexp_matches(u_path, '{_RE(E.MAPPED_PATH)}', 'i') THEN 2 ELSE 0 END AS lead_,
        len([x FOR x IN string_split_regex(lower(coalesce(role, '')), '[^a-z0-9+#]+') IF len(x) >= 4 AND NOT list_contains({W.listed(E.ROLE_FILLER)}, x) AND contains(lower(u_path || ' ' || 'Data Engineer at ' || page_id), x)]) AS named FROM u WHERE u_kind = 'direct'),
    s AS (SELECT job, link, max(lead_ + least(named, 2)) AS score, max(named) AS named FROM t WHERE lead_ > 0 GROUP BY job, link)
    SELECT job, row_number() OVER (PARTITION BY job ORDER BY score DESC, link) AS rank, link, score, CASE WHEN score >= 5 AND named > 0 THEN 'high' ELSE 'medium' END AS confidence FROM s""")
def mapped_links(spark, sf_dir):
    """UR19's site-map ranking: all pages as links of site maps."""
    title = F.concat(F.lit("Data Engineer at "), F.col("page_id").cast("string"))
    return E.mapped_links(articles(spark, sf_dir).select(F.floor(F.col("page_id") / 20).alias("job"), "url", title.alias("title"), "company", "role"))


@query("rendered_links", f"""WITH {CANDIDATES_SQL}, offers AS (SELECT page_id AS job, link, score FROM found),
    extra AS (SELECT page_id AS job, l_link AS link, max(CASE WHEN {W.under('l_host', U.APPLICANT_SYSTEMS)} AND {W.matches_company('l_host', 'company')} THEN 4 ELSE 3 END) AS score FROM l
        WHERE l_kind = 'direct' AND l_host <> {W.host('url')} AND ({W.under('l_host', U.APPLICANT_SYSTEMS)} OR {W.matches_company('l_host', 'company')}) GROUP BY 1, 2),
    both_ AS (SELECT *, CASE WHEN score >= 9 THEN 'highest' WHEN score >= 5 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM offers
        UNION ALL SELECT *, 'medium' FROM extra WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.job = extra.job AND o.link = extra.link))
    SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, link) AS rank FROM both_""")
def rendered_links(spark, sf_dir):
    """UR19's fallbacks: candidates of every page and the bare links that the page shows."""
    bare = A.anchors(articles(spark, sf_dir)).select(F.col("page_id").alias("job"), F.col("url").alias("page_url"), F.col("href").alias("url"), "company")
    return E.rendered_links(_candidates(spark, sf_dir).withColumnRenamed("page_id", "job"), bare)


# ---- UR20: the evidence of a page

_PLAIN = _replaced("lower(html)", [("(?s)<script[^>]*>.*?</script>", "' '"), ("(?s)<style[^>]*>.*?</style>", "' '"), ("<[^>]+>", "' '"), (f"[{P.SPACE}]+", "' '")])


@query("page_evidence", rf"""WITH {ARTICLES_SQL}, {W.judged('u', 'articles', 'url', 'company')},
    e1 AS (SELECT *, lower(html) AS h, {W.host('url')} AS hst, trim({_PLAIN}) AS t FROM u),
    e2 AS (SELECT *, regexp_extract(h, '<title[^>]*>([^<]+)</title>', 1) AS title, regexp_extract(regexp_extract(h, '<meta[^>]*=["'']og:site_name["''][^>]*>'), 'content\s*=\s*["'']([^"'']*)["'']', 1) AS site,
        [w FOR w IN string_split_regex(lower(company), '[^a-z0-9]+') IF len(w) > 2 AND NOT list_contains({W.listed(U.GENERIC_COMPANY)}, w)] AS names,
        [w FOR w IN string_split_regex(lower(role), '\s+') IF len(w) > 2 AND w NOT IN ('the', 'and', 'for')] AS words, [w FOR w IN string_split_regex(lower(location), '\s+|,') IF len(w) > 2] AS places,
        {W.under('hst', U.APPLICANT_SYSTEMS)} AS sys, coalesce(u_kind = 'direct' AND ({W.under('hst', U.APPLICANT_SYSTEMS)} OR {W.matches_company('hst', 'company')} OR regexp_matches(hst, '{U.OFFICIAL_SUFFIX[4:]}', 'i')), false) AS official FROM e1),
    e3 AS (SELECT *,
        CASE WHEN company IS NULL THEN 0 ELSE least(100, CASE WHEN contains(t, lower(company)) THEN 40 ELSE 0 END + CASE WHEN len([w FOR w IN names IF contains(title, w)]) > 0 THEN 30 ELSE 0 END
            + CASE WHEN len([w FOR w IN names IF contains(lower(url), w)]) > 0 THEN 20 ELSE 0 END + CASE WHEN len([w FOR w IN names IF contains(site, w)]) > 0 THEN 25 ELSE 0 END) END AS cs,
        CASE WHEN role IS NULL THEN 0 ELSE least(100, CASE WHEN contains(t, lower(role)) THEN 50 ELSE 0 END + 15 * len([w FOR w IN words IF regexp_matches(w, '{E.TELLING}') AND contains(t, w)])
            + CASE WHEN len([w FOR w IN words IF contains(title, w)]) > 0 THEN 25 ELSE 0 END) END AS rs,
        location IS NULL OR contains(t, lower(location)) OR len([w FOR w IN places IF contains(t, w)]) > 0 OR regexp_matches(t, '{E.ANYWHERE}') AS loc,
        {' OR '.join(f"regexp_matches(h, '{_RE(p)}')" for p in E.ACTION)} OR (regexp_matches(h, '{E.FORM}') AND regexp_matches(h, '{_RE(E.FORM_FIELD)}')) OR (sys AND regexp_matches(h, '{E.SYSTEM_WORDS}')) OR regexp_matches(url, '{_RE(E.POSTING_ID)}', 'i') AS act,
        NOT ({' OR '.join(f"regexp_matches(t, '{p}')" for p in E.CLOSED)}) AS open_ FROM e2),
    e4 AS (SELECT *, CASE WHEN official THEN 30 + CASE WHEN act THEN 30 ELSE 0 END + CASE WHEN cs >= 40 THEN 20 ELSE 0 END + CASE WHEN rs >= 40 THEN 10 ELSE 0 END + CASE WHEN loc THEN 5 ELSE 0 END + CASE WHEN open_ THEN 5 ELSE 0 END ELSE 0 END AS total FROM e3)
    SELECT page_id AS id, url, official, CASE WHEN official THEN CASE WHEN sys THEN 'applicant system' ELSE 'company page' END END AS source_type, CASE WHEN official THEN cs ELSE 0 END AS company_score, CASE WHEN official THEN rs ELSE 0 END AS role_score,
        official AND loc AS has_location, official AND act AS has_action, NOT official OR open_ AS active, total AS confidence, official AND act AND open_ AND (sys OR cs >= 40) AND total >= 70 AS verified FROM e4""")
def page_evidence(spark, sf_dir):
    """UR20 over all pages as career pages."""
    return E.page_evidence(articles(spark, sf_dir).withColumnRenamed("page_id", "id"))


@query("discovery_cascade", "SELECT * FROM (VALUES (1, 'b', 'scrape', 3), (2, NULL, NULL, 6), (3, 'z', 'site', 2)) t(job, url, stage, n_allowed)")
def discovery_cascade(spark, sf_dir):
    """UR21: the first verified of the earlier stage; a fifth link of a stage and calls over the budget are not tried; a link tried before is not tried again."""
    rows = [(1, "direct", 0, "a", False, False), (1, "scrape", 0, "b", True, True), (1, "search", 0, "c", True, True)]
    rows += [(2, "scrape", k, f"s{k}", True, k == 4) for k in range(5)] + [(2, "search", 0, "t0", True, False), (2, "search", 1, "t1", True, True), (2, "direct", 0, "d", False, False)]
    rows += [(3, "direct", 0, "y", False, False), (3, "site", 0, "y", True, True), (3, "site", 1, "z", True, True)]
    return E.discovered(spark.createDataFrame(rows, "job int, stage string, place int, url string, external boolean, verified boolean"))


# ---- UR23, SC1, SC2: what a post says of its link, and the post without promotion

_PROMOTES = lambda u: rf"(list_contains({W.listed(P.CHAT_HOSTS + P.SOCIAL_HOSTS)}, coalesce({W.host(u)}, '')) OR {W.under(W.host(u), P.BIO_HOSTS)} OR ({W.under(W.host(u), ['linkedin.com'])} AND regexp_matches({W.part(u, 4)}, '{_RE(P.COMPANY_PAGES)}', 'i')))"
#: SC2 in rows: the lines of a post with text in them, their links, and what these score.
LINK_SQL = rf"""rows_ AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) AS k, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM posts) WHERE regexp_replace(line, '[{P.SPACE}]', '', 'g') <> ''),
    near_ AS (SELECT *, CASE WHEN regexp_matches(line, '{_RE(P.APPLY_WORDS)}', 'i') THEN 3 ELSE 0 END + CASE WHEN lag(regexp_matches(line, '{_RE(P.APPLY_WORDS)}', 'i')) OVER (PARTITION BY id ORDER BY k) THEN 1 ELSE 0 END AS near_score FROM rows_),
    urls_ AS (SELECT id, k, near_score, unnest(us) AS whole, unnest(range(len(us))) AS j FROM (SELECT *, regexp_extract_all(line, '{_RE(P.URL)}', 0, 'i') AS us FROM near_)),
    cut_ AS (SELECT *, regexp_replace(whole, '{_RE(P.TAIL)}', '') AS link FROM urls_),
    best_ AS (SELECT id, link FROM (SELECT *, near_score + CASE WHEN regexp_matches(link, '{_RE(P.APPLY_TARGETS)}', 'i') THEN 2 ELSE 0 END AS score FROM cut_ WHERE {W.host('link')} IS NOT NULL AND NOT {_PROMOTES('link')})
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, k, j) = 1)"""
_STORED = ["https://t.me/x", "https://careers/apply", "https://acme.example/jobs/1", None, "apply", "https://www.linkedin.com/in/someone", ""]


@query("restored_links", f"""WITH {POSTS_SQL}, {LINK_SQL} SELECT p.id, CASE p.id % 7 WHEN 2 THEN 'https://acme.example/jobs/1' WHEN 3 THEN NULL WHEN 6 THEN '' ELSE b.link END AS link,
    CASE p.id % 7 WHEN 0 THEN 'promotion' WHEN 1 THEN 'malformed host' WHEN 4 THEN 'not a link' WHEN 5 THEN 'promotion' END AS damage FROM posts p LEFT JOIN best_ b ON b.id = p.id""")
def restored_links(spark, sf_dir):
    """UR23 over all documents as posts with stored links of seven kinds."""
    rows = posts(spark, sf_dir).withColumn("stored", cases("id", _STORED))
    return rows.select("id", E.restored_link(F.col("stored"), F.col("text")).alias("link"), E.damage(F.col("stored")).alias("damage"))


@query("post_links", f"WITH {POSTS_SQL}, {LINK_SQL} SELECT p.id, b.link FROM posts p LEFT JOIN best_ b ON b.id = p.id")
def post_links(spark, sf_dir):
    """SC2 over all documents as posts."""
    return posts(spark, sf_dir).select("id", P.apply_link(F.col("text")).alias("link"))


_TIDIED = _replaced(
    "built",
    [(_RE(p), "' '", "gi") for p in P.PROMO_PARTS]
    + [(rf"(^|[{P.SPACE}])@[A-Za-z0-9_]{{3,32}}\b", r"'\1'"), (P.DECORATION, "''"), (r"[ \t]{2,}", "' '"), (rf"[{P.SPACE}]*[|•·][{P.SPACE}]*$", "''"), (rf"^[{P.SPACE}:\-–—|]+", "''"), (rf"[{P.SPACE}]+$", "''")],
)
CLEAN_SQL = rf"""all_ AS (SELECT id, n, regexp_replace(raw, '^[{P.SPACE}]+|[{P.SPACE}]+$', '', 'g') AS line FROM (SELECT id, unnest(range(len(ls))) AS n, unnest(ls) AS raw FROM (SELECT id, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM posts))),
    split_ AS (SELECT *, regexp_extract_all(line, '{_RE(P.URL)}', 0, 'i') AS us, string_split_regex(line, '(?i){_RE(P.URL)}') AS gaps FROM all_),
    link_ AS (SELECT id, n, i, us[i] AS whole, regexp_replace(us[i], '{_RE(P.TAIL)}', '') AS link FROM (SELECT id, n, us, unnest(range(1, len(us) + 1)) AS i FROM split_)),
    promo_ AS (SELECT *, {_PROMOTES('link')} AS promo, {W.host('link')} IS NOT NULL AS good FROM link_),
    by_line AS (SELECT id, n, list(CASE WHEN promo THEN ' ' ELSE whole END ORDER BY i) AS kept, bool_or(good AND NOT promo) AS useful, list(link ORDER BY i) FILTER (promo) AS gone FROM promo_ GROUP BY id, n),
    line_ AS (SELECT s.*, b.gone, coalesce(regexp_matches(line, '{_RE(P.DIVIDER)}'), false) AS divider, line <> '' AND NOT coalesce(b.useful, false) AND ({' OR '.join(f"regexp_matches(line, '{_RE(p)}', 'i')" for p in P.PROMO_LINES)}) AS dropped,
        CASE WHEN b.kept IS NULL THEN line ELSE array_to_string([gaps[k] || coalesce(b.kept[k], '') FOR k IN range(1, len(gaps) + 1)], '') END AS built FROM split_ s LEFT JOIN by_line b USING (id, n)),
    tidy_ AS (SELECT *, CASE WHEN line = '' OR divider OR dropped THEN '' ELSE {_TIDIED} END AS tidied FROM line_),
    said_ AS (SELECT *, CASE WHEN regexp_matches(tidied, '[\p{{L}}\p{{N}}]') THEN tidied ELSE '' END AS final FROM tidy_),
    cleaned_ AS (SELECT id, regexp_replace(regexp_replace(coalesce(string_agg(final, chr(10) ORDER BY n) FILTER (line = '' OR final <> ''), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{P.SPACE}]+|[{P.SPACE}]+$', '', 'g') AS cleaned,
        count(*) FILTER (line <> '' AND final = '') AS removed_lines, list_sort(list_distinct(flatten(coalesce(list(gone) FILTER (gone IS NOT NULL AND NOT divider), [])))) AS removed FROM said_ GROUP BY id)"""


@query("normalized_posts", f"WITH {POSTS_SQL}, {LINK_SQL}, {CLEAN_SQL} SELECT c.id, md5(cleaned) AS digest, length(cleaned) AS n_chars, removed_lines, array_to_string(removed, ' ') AS removed, b.link AS apply_url FROM cleaned_ c LEFT JOIN best_ b ON b.id = c.id")
def normalized_posts(spark, sf_dir):
    """SC1, SC2, SET8, UR22 over all documents as posts."""
    said = posts(spark, sf_dir).select("id", P.normalize_post(F.col("text")).alias("p"))
    return said.select("id", F.md5("p.cleaned_text").alias("digest"), F.length("p.cleaned_text").alias("n_chars"), "p.removed_lines", F.array_join(F.array_sort("p.removed_urls"), " ").alias("removed"), "p.apply_url")


@query("sanitized_labels", "SELECT * FROM (VALUES (1, 'Acme', 'Engineer', 'internship', 'https://a.example/1', 'ok'), (2, NULL, 'Engineer', NULL, NULL, 'no company'), (3, 'Acme', NULL, NULL, NULL, 'no role'), (4, 'Acme', 'Engineer', NULL, NULL, 'not a job')) t(id, company, role, employment_type, apply_url, outcome)")
def sanitized_labels(spark, sf_dir):
    """SC8-SC11: only what stands in the text stays."""
    text = "Acme wants an Engineer. https://a.example/1"
    rows = [(1, text, True, "Acme", "Engineer", "Internship ", "https://a.example/1"), (2, text, True, "Ghost", "Engineer", "odd", "https://made.up/1"), (3, text, True, "Acme", "@promo", None, "ftp://a"), (4, text, None, "Acme", "Engineer", None, None)]
    df = spark.createDataFrame(rows, "id int, text string, is_job boolean, company string, role string, employment_type string, apply_url string").withColumn("location", F.lit(None).cast("string"))
    return E.sanitized(df).drop("location")
