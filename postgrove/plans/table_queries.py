"""Operators whose rules are spelt out on literal rows elsewhere, here over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from postgrove.functions import skills as S, text as T, urls as U
from postgrove.operators import evidence as E, ranking as K, reports as R, state as ST
from postgrove.plans import evidence_queries as EQ, twins as W
from postgrove.plans.registry import query
from postgrove.session import read_table
from postgrove.sources.markdown import table_rows
from postgrove.sources.tables import ARTICLES_SQL, POSTINGS_SQL, POSTS_SQL, QUEUE_SQL, articles, cases, postings, posts, queue, sql_case

NOW = datetime(2024, 1, 20, 12)
_RE = lambda p: p.removeprefix("(?i)").replace("'", "''")
_SPACE = r"[ \t\n\x0B\f\r]"
_TRIM = lambda c: rf"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"

# ---- links


@query("article_verdicts", f"WITH {ARTICLES_SQL}, {W.judged('u', 'articles', 'url', 'company')} SELECT page_id, u_link AS link, u_kind AS verdict FROM u")
def article_verdicts(spark, sf_dir):
    """UR1, UR3-UR8, JN9 over all pages as articles, with companies."""
    judged = U.judge(articles(spark, sf_dir), F.col("url"), F.col("company"), "u")
    return judged.select("page_id", F.col("u_link").alias("link"), F.col("u_kind").alias("verdict"))


@query("public_article_links", f"""WITH {ARTICLES_SQL}, {W.judged('u', 'articles', 'url', 'company')} SELECT page_id, CASE WHEN page_id % 3 = 0 OR u_kind = 'direct' THEN url END AS link FROM u""")
def public_article_links(spark, sf_dir):
    """UR10 over all pages as articles; every third is verified, the others are not or unknown."""
    verified = F.when(F.col("page_id") % 3 == 0, True).when(F.col("page_id") % 3 == 1, False)
    return articles(spark, sf_dir).select("page_id", U.public_link(F.col("url"), verified, F.col("company")).alias("link"))


@query("ranked_candidates", f"""WITH {EQ.CANDIDATES_SQL}, placed AS (SELECT page_id AS post, link, score, row_number() OVER w AS place, lead(score) OVER w AS behind FROM found WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, link))
    SELECT post, place, link AS url, score, CASE WHEN score >= 9 THEN 'highest' WHEN score >= 5 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS confidence, place = 1 AND score >= 5 AND score - coalesce(behind, 0) > 1 AS taken FROM placed""")
def ranked_candidates(spark, sf_dir):
    """SET5, SRT9, UR14, UR15 over the candidates of all pages."""
    return U.best_candidates(EQ._offers(spark, sf_dir))


@query("redirect_walks", """WITH RECURSIVE hops AS (SELECT 'u' || o_orderkey AS source, 'u' || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 3 WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey * 2 END AS target FROM orders WHERE o_orderkey % 7 <> 0),
    walk(url, final, seen, n) AS (SELECT 'u' || o_orderkey, 'u' || o_orderkey, ['u' || o_orderkey], 0 FROM orders
        UNION ALL SELECT url, target, list_append(seen, target), n + 1 FROM walk JOIN hops ON source = final WHERE n < 5 AND NOT list_contains(seen, target)),
    ends AS (SELECT url, arg_max(final, n) AS final, max(n) AS hops, arg_max(seen, n) AS seen FROM walk GROUP BY url)
    SELECT url, final, hops, CASE WHEN target IS NULL THEN 'resolved' WHEN hops < 5 THEN 'loop' ELSE 'too many hops' END AS outcome FROM ends LEFT JOIN hops ON source = final""")
def redirect_walks(spark, sf_dir):
    """UR11, UR12 over all orders as links, of which most lead on, some to themselves and some nowhere."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda c: F.concat(F.lit("u"), c.cast("string"))
    onward = F.when(F.col("k") % 5 != 0, F.floor(F.col("k") / 3).cast("long")).when(F.col("k") % 2 == 0, F.col("k")).otherwise(F.col("k") * 2)
    hops = o.where("k % 7 != 0").select(name(F.col("k")).alias("source"), name(onward).alias("target"))
    return U.follow(o.select(name(F.col("k")).alias("url")), hops)


@query("shown_post_links", f"""WITH {POSTS_SQL}, f AS (SELECT id, regexp_extract_all(text, '(?:https?://|www\\.)[^\\s<>"'')\\]]+|[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}', 0, 'i') AS xs FROM posts)
    SELECT id, len(xs) AS n, array_to_string([CASE WHEN regexp_matches(x, '^https?://', 'i') THEN x WHEN regexp_matches(x, '^www\\.', 'i') THEN 'https://' || x ELSE 'mailto:' || x END FOR x IN xs], ' ') AS links FROM f WHERE xs IS NOT NULL""")
def shown_post_links(spark, sf_dir):
    """UR24 over all documents as posts."""
    found = posts(spark, sf_dir).where("text IS NOT NULL").withColumn("x", U.shown_links(F.col("text")))
    return found.select("id", F.size("x").alias("n"), F.array_join("x", " ").alias("links"))


@query("extracted_links", f"""WITH {POSTS_SQL}, f AS (SELECT id, regexp_extract_all(text, '{_RE(T.URL)}', 0, 'i') AS xs FROM posts WHERE text IS NOT NULL) SELECT id, len(xs) AS n, array_to_string(xs, ' ') AS links FROM f""")
def extracted_links(spark, sf_dir):
    """SC3 over all documents as posts."""
    found = posts(spark, sf_dir).where("text IS NOT NULL").withColumn("x", T.urls(F.col("text")))
    return found.select("id", F.size("x").alias("n"), F.array_join("x", " ").alias("links"))


_STAGES = ["direct", "scrape", "search", "site", "scrape"]


@query("discovered_links", f"""WITH e AS (SELECT page_id // 17 AS job, page_id % 5 AS s, page_id AS place, 'v' || (page_id % 11) AS url, page_id % 4 <> 0 AS ext, page_id % 6 = 5 AS ok FROM pages),
    o AS (SELECT *, CASE s WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 2 END AS stage FROM e),
    once AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY job, url ORDER BY stage, place) = 1),
    tried AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY job, stage ORDER BY place, url) <= 4),
    spent AS (SELECT *, sum(ext::INT) OVER (PARTITION BY job ORDER BY stage, place, url ROWS UNBOUNDED PRECEDING) AS n FROM tried)
    SELECT job, arg_min(url, (stage, place, url)) FILTER (ok) AS url, ['direct', 'scrape', 'search', 'site'][(arg_min(stage, (stage, place, url)) FILTER (ok))::INT] AS stage, count(*) AS n_allowed FROM spent WHERE NOT ext OR n <= 5 GROUP BY job""")
def discovered_links(spark, sf_dir):
    """UR21 over all pages as judged links, seventeen to a job."""
    p = F.col("page_id")
    rows = read_table(spark, sf_dir, "pages").select(
        F.floor(p / 17).alias("job"), cases("page_id", _STAGES).alias("stage"), p.alias("place"), F.concat(F.lit("v"), (p % 11).cast("string")).alias("url"), (p % 4 != 0).alias("external"), (p % 6 == 5).alias("verified")
    )
    return E.discovered(rows)


# ---- fields and texts

_COMPANIES = ["Acme", "Bolt-Labs", None, "@promo", "n/a", "the", "Acme Labs ", "join us"]
_TYPES = ["Internship ", "odd", None, "FULL-TIME"]
_LINKS = ["https://forms.gle/abc", "https://careers.acme.example/jobs/1.", "ftp://a", None, "https://made.up/1"]
_SQ = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
_ACCEPTED = lambda c, most: f"""CASE WHEN lower({_TRIM(c)}) NOT IN ('', 'n/a', 'na', 'none', 'null', 'not specified', 'not mentioned', 'unknown', '-') AND length({_TRIM(c)}) <= {most}
    AND NOT ({' OR '.join(f"regexp_matches({_TRIM(c)}, '{p}')" for p in T.PROMOTIONAL_VALUES)}) AND NOT regexp_matches({_TRIM(c)}, 'https?://|www\\.\\w|\\bt\\.me/|\\blnkd\\.in/', 'i') AND {_SQ(_TRIM(c))} <> '' AND contains({_SQ('text')}, {_SQ(_TRIM(c))}) THEN {_TRIM(c)} END"""  # noqa: E731


@query("labelled_posts", f"""WITH {POSTS_SQL}, l AS (SELECT id, text, {sql_case('id', _COMPANIES)} AS c, split_part(text, ' ', 3) AS r, {sql_case('id', _TYPES)} AS k, {sql_case('id', _LINKS)} AS u FROM posts),
    a AS (SELECT id, {_ACCEPTED('c', 120)} AS company, {_ACCEPTED('r', 160)} AS role, CASE WHEN lower({_TRIM('k')}) IN ('internship', 'full-time', 'part-time', 'contract', 'apprenticeship', 'training') THEN lower({_TRIM('k')}) END AS employment_type,
        CASE WHEN regexp_matches(u, '^https?://', 'i') AND contains(text, u) THEN u END AS apply_url FROM l)
    SELECT *, CASE WHEN id % 9 IN (0, 1) THEN 'not a job' WHEN company IS NULL THEN 'no company' WHEN role IS NULL THEN 'no role' ELSE 'ok' END AS outcome FROM a""")
def labelled_posts(spark, sf_dir):
    """SC5-SC11 over all documents as posts, with labels that a text may bear out or not."""
    rows = posts(spark, sf_dir).withColumns({
        "is_job": F.when(F.col("id") % 9 == 0, False).when(F.col("id") % 9 > 1, True), "company": cases("id", _COMPANIES), "role": F.split_part("text", F.lit(" "), F.lit(3)), "location": F.lit(None).cast("string"),
        "employment_type": cases("id", _TYPES), "apply_url": cases("id", _LINKS),
    })
    return E.sanitized(rows).drop("location")


def _skill_test(spelling: str) -> str:
    """RE2 has no look-around: what may not stand around a skill is matched as a border instead."""
    import re

    parts = [re.escape(p) for p in re.split("[^a-z0-9+#]+", spelling.lower()) if p]
    return "(?:^|[^a-z0-9+#])" + "[^a-z0-9+#]*".join(parts).replace("\\#", "#") + "(?:$|[^a-z0-9+#])"


_SKILLS = "[x FOR x IN [" + ", ".join("CASE WHEN regexp_matches(low, '" + "|".join(map(_skill_test, e)) + f"') THEN '{e[0]}' END" for e in S.SKILLS) + "] IF x IS NOT NULL]"
_NAMED = ["Java and JavaScript with node js", "strong C++ skills, ci-cd", "Go developer, good going", "", "RESTful services", "SQL, MySQL, Git and GitHub", "Spring-Boot / k8s", "machine_learning; C# (c sharp)"]


@query("post_skills", f"""WITH f AS (SELECT doc_id AS id, {_SKILLS} AS xs FROM (SELECT doc_id, lower(coalesce(text, '') || chr(10) || {sql_case('doc_id', _NAMED)}) AS low FROM documents))
    SELECT id, array_to_string([x FOR x IN xs IF len([y FOR y IN xs IF len(y) > len(x) AND contains(lower(y), lower(x))]) = 0], ',') AS skills FROM f""")
def post_skills(spark, sf_dir):
    """SC14, SC15 over all documents with a line that names skills."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), cases("doc_id", _NAMED))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(S.extract_skills(text), ",").alias("skills"))


@query("order_dates", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def order_dates(spark, sf_dir):
    """SC19 over all orders, their dates written in five ways; dates that do not exist and other cells are none."""
    o = read_table(spark, sf_dir, "orders")
    d = lambda f: F.date_format("o_orderdate", f)
    ways = [d("yyyy-MM-dd"), d("d MMM yyyy"), d("MMM d, yyyy"), d("yyyy/M/d"), F.concat(d("yyyy-MM-dd"), F.lit("T10:00:00Z")), F.lit("2026-02-30"), F.lit("5 Sep – 9 Sep")]
    cell = F.element_at(F.array(*ways), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), T.posted_date(cell).cast("string").alias("day"))


_CELLS = ["![logo](x.png) {}", "[{}](https://a.example)", "<b>{}</b>​  x", "  ", "N/A", "{} – {}"]


@query("part_cells", "WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || ' x' WHEN 3 THEN '' WHEN 4 THEN 'N/A' ELSE p_name || ' ' || p_name END AS cell FROM part) SELECT id, cell, id % 6 > 2 AS missing FROM c")
def part_cells(spark, sf_dir):
    """SC19 over all parts as table cells with images, links, tags and ornaments."""
    filled = [F.replace(F.lit(c), F.lit("{}"), F.col("p_name")) for c in _CELLS]
    raw = F.element_at(F.array(*filled), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.clean_cell(raw).alias("cell"), T.missing_cell(F.trim(raw)).alias("missing"))


@query("markdown_files", r"""WITH f AS (SELECT p_partkey AS file, p_name AS n, p_brand AS b, p_size AS z FROM part)
    SELECT file, 3 AS pos, n AS company, b AS role, 'Pune' AS location, '2026-09-05' AS posted_on, 'https://a.example/' || file AS apply_url, false AS skipped FROM f
    UNION ALL SELECT file, 4, n || ' Ltd', '', NULL, '2026-09-' || lpad((z % 28 + 1)::VARCHAR, 2, '0'), NULL, true FROM f
    UNION ALL SELECT file, 8, b, n, NULL, NULL, NULL, false FROM f""")
def markdown_files(spark, sf_dir):
    """SRC6, SC19 over a Markdown file for each part: two tables with other headings, a row without a role, a table-like line without a heading."""
    top = "# Jobs\n| Company | Role | Location | Posted | Link |\n| --- | --- | --- | --- | --- |\n| <b>{n}</b> | [{b}](https://x.example) | Pune | 5 Sep 2026 | [Apply](https://a.example/{k}) |\n| {n} Ltd | | | 2026/9/{d} | |\n"
    end = "text\n| Title | Employer | Date |\n|---|---|---|\n| {n} | {b} | n/a |\ntext\n| not | a | table |"
    text = F.lit(top + end)
    for mark, value in (("{n}", F.col("p_name")), ("{b}", F.col("p_brand")), ("{k}", F.col("p_partkey").cast("string")), ("{d}", (F.col("p_size") % 28 + 1).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    files = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), text.alias("value"))
    found = table_rows(files, T.posted_date)
    return found.select("file", F.col("pos").cast("int").alias("pos"), "company", "role", "location", F.col("posted_on").cast("string").alias("posted_on"), "apply_url", "skipped")


@query("tidy_posts", rf"""WITH {POSTS_SQL}, t AS (SELECT id, replace(replace(text, ' ', CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) WHEN 2 THEN chr(13) ELSE ' ' || chr(8203) END), '.', '.' || chr(10) || ' ' || chr(10) || chr(10)) AS text FROM posts)
    SELECT id, md5({_TRIM(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\p{Cf}', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM t""")
def tidy_posts(spark, sf_dir):
    """SC24 over all documents as posts, with spaces of several kinds and blank lines put in."""
    space = cases("id", ["  ", "\t", "\r", " ​"])
    text = F.replace(F.replace("text", F.lit(" "), space), F.lit("."), F.lit(".\n \n\n"))
    return posts(spark, sf_dir).select("id", F.md5(T.tidy(text)).alias("digest"))


@query("cleaned_lists", rf"""WITH c AS (SELECT c_custkey AS id, [c_name, ' ' || lower(c_name), c_mktsegment, '', upper(c_name), c_mktsegment || ' ', 'x' || (c_custkey % 3), 'X0', '  ', 'y'] AS raw FROM customer),
    w AS (SELECT id, [x FOR x IN [{_TRIM('y')} FOR y IN raw] IF x <> ''] AS xs FROM c)
    SELECT id, array_to_string([xs[k] FOR k IN range(1, len(xs) + 1) IF list_position([lower(y) FOR y IN xs], lower(xs[k])) = k][1:4], '|') AS kept FROM w""")
def cleaned_lists(spark, sf_dir):
    """SET7 over a list of each customer: each entry once in any case, the first four."""
    n, m, i = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    raw = F.array(n, F.concat(F.lit(" "), F.lower(n)), m, F.lit(""), F.upper(n), F.concat(m, F.lit(" ")), F.concat(F.lit("x"), (i % 3).cast("string")), F.lit("X0"), F.lit("  "), F.lit("y"))
    return read_table(spark, sf_dir, "customer").select(i.alias("id"), F.array_join(T.list_clean(raw, 4), "|").alias("kept"))


_TERMS = ["", "2-4 years of work", "Freshers welcome, 2 years", "3+ yrs", "25 years", "5 to 7 Years", "no experience", "summer interns or full time"]
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g'))"
_KIND = (
    "CASE " + " ".join(f"WHEN {_NORM} IN ({', '.join(repr(n) for n in [kind.replace('-', ' '), *names])}) THEN '{kind}'" for kind, names in K.JOB_TYPES.items())
    + " ".join(f" WHEN {' OR '.join(f'''contains(' ' || {_NORM} || ' ', ' {n} ')''' for n in names)} THEN '{kind}'" for kind, names in K.JOB_TYPES.items()) + " END"
)


@query("asked_of_posts", rf"""WITH t AS (SELECT doc_id AS id, coalesce(text, '') || ' ' || {sql_case('doc_id', _TERMS)} AS text FROM documents), y AS (SELECT *, try_cast(nullif(regexp_extract({_NORM}, '{K.YEARS}', 1), '') AS INT) AS n FROM t)
    SELECT id, CASE WHEN regexp_matches({_NORM}, '{K.FRESHER}') THEN 0 WHEN n <= 20 THEN n END AS years, {_KIND} AS kind FROM y""")
def asked_of_posts(spark, sf_dir):
    """RK5, RK6 over all documents with words on experience and kind at their ends."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), cases("doc_id", _TERMS))
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), K.required_years(text).alias("years"), K.job_type(text).alias("kind"))


# ---- states

_Q = f"WITH {QUEUE_SQL}"


@query("retry_delays", f"""{_Q} SELECT id, CASE WHEN id % 5 = 1 AND id % 9 > 0 THEN least(id % 9 * 100000, 600000) ELSE least(600000, 5000 * pow(2, greatest(attempts - 1, 0)))::BIGINT END AS delay FROM queue""")
def retry_delays(spark, sf_dir):
    """ST3 over all events as queue entries; some ask for a wait of their own."""
    asked = F.when(F.col("id") % 5 == 1, F.col("id") % 9 * 100_000)
    return queue(spark, sf_dir).select("id", ST.backoff_ms(F.col("attempts"), asked).alias("delay"))


@query("enqueued_jobs", f"""{_Q}, e AS (SELECT user_id AS job_id, arg_max(status, (received_at, id)) AS status, arg_max(attempts, (received_at, id)) AS attempts, arg_max(value, (received_at, id)) > 50 AS verified FROM queue GROUP BY 1),
    a AS (SELECT DISTINCT user_id + 7 AS job_id FROM queue), m AS (SELECT a.job_id, e.job_id IS NOT NULL AS known, status, attempts, coalesce(e.job_id IS NOT NULL AND (status = 'processing' OR (status = 'completed' AND verified)), false) AS keep FROM a LEFT JOIN e USING (job_id))
    SELECT job_id, CASE WHEN keep THEN status ELSE 'pending' END AS status, CASE WHEN keep THEN attempts ELSE 0 END AS attempts, CASE WHEN keep THEN 'kept' WHEN known THEN 'reset' ELSE 'created' END AS outcome FROM m""")
def enqueued_jobs(spark, sf_dir):
    """ST6 over the newest state of every user's entries, asked for under numbers that are partly unknown."""
    q = queue(spark, sf_dir)
    existing = ST.latest(q, "user_id", "received_at", "id").select(F.col("user_id").alias("job_id"), "status", "attempts", (F.col("value") > 50).alias("verified"))
    return ST.enqueued(existing, q.select((F.col("user_id") + 7).alias("job_id")), NOW).select("job_id", "status", F.col("attempts").cast("long").alias("attempts"), "outcome")


@query("live_list", f"""WITH {POSTINGS_SQL}, shown AS (SELECT id AS place, id, role FROM postings WHERE id % 2 = 0),
    u AS (SELECT id, 'changed ' || id AS role FROM postings WHERE id % 10 = 4), n AS (SELECT -id AS place, id, 'new' AS role FROM postings WHERE id % 3 = 0 AND id % 2 = 1 AND location IS NOT NULL)
    SELECT place, s.id, coalesce(u.role, s.role) AS role FROM shown s LEFT JOIN u ON u.id = s.id UNION ALL SELECT * FROM n""")
def live_list(spark, sf_dir):
    """ST10, ST17-ST19 over all postings: even ones are shown, some of them are updated twice, some odd ones arrive."""
    p = postings(spark, sf_dir)
    shown = p.where("id % 2 = 0").select(F.col("id").alias("place"), "id", "role")
    event = lambda where, kind, role, seq: p.where(where).select(seq.cast("long").alias("seq"), F.lit(kind).alias("event"), "id", role.alias("role"), "location")
    i = F.col("id")
    changed = event("id % 10 = 4", "updated", F.lit("old"), i).unionByName(event("id % 10 = 4", "updated", F.concat(F.lit("changed "), i.cast("string")), i + 1_000_000_000))
    arrived = changed.unionByName(event("id % 3 = 0", "created", F.lit("new"), i)).unionByName(event("id % 9 = 5", "updated", F.lit("never shown"), i).where("id % 2 = 1"))
    return ST.live_fold(shown, arrived, F.col("location").isNotNull())


@query("guarded_links", f"""WITH {POSTINGS_SQL} SELECT id, CASE WHEN id % 3 = 0 AND (id % 2 = 0 OR apply_url IS NULL) THEN 'https://new.example/' || id ELSE apply_url END AS apply_url, coalesce(id % 3 = 0 AND (id % 2 = 0 OR apply_url IS NULL), false) AS modified FROM postings""")
def guarded_links(spark, sf_dir):
    """SNK3 over all postings: every third is to change, half of them in the belief that they hold another link."""
    p = postings(spark, sf_dir).select("id", "apply_url")
    believed = F.when(F.col("apply_url").isNull(), None).when(F.col("id") % 2 == 0, F.col("apply_url")).otherwise("https://other.example/")
    updates = p.where("id % 3 = 0").select("id", believed.alias("old"), F.concat(F.lit("https://new.example/"), F.col("id").cast("string")).alias("new"))
    return ST.guarded_update(p, updates, "apply_url")


@query("logos_of_postings", f"""WITH {POSTINGS_SQL}, l AS (SELECT lower(company) AS c, min('logo' || (id % 100)) AS logo FROM postings WHERE id % 5 = 0 GROUP BY 1) SELECT id, logo AS stored_logo FROM postings LEFT JOIN l ON lower(company) = c""")
def logos_of_postings(spark, sf_dir):
    """JN5 over all postings; every fifth has a logo, spelt in capitals."""
    p = postings(spark, sf_dir).select("id", "company")
    known = p.select(F.upper("company").alias("company"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("logo"), (F.col("id") % 100).cast("string"))).otherwise(" ").alias("logo"))
    return ST.with_stored_logo(p, known).select("id", "stored_logo")


@query("edited_profiles", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN c_name ELSE 'read ' || c_name END AS city, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'role' END AS role FROM customer""")
def edited_profiles(spark, sf_dir):
    """ST14 over all customers as profiles: every third's city was edited by hand, every fourth reading has none, every fifth has no reading."""
    c = read_table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    old = c.select(i.alias("id"), F.when(i % 3 == 0, F.array(F.lit("city"))).otherwise(F.array().cast("array<string>")).alias("manual_fields"), F.col("c_name").alias("city"), F.col("c_mktsegment").alias("role"))
    new = c.where(i % 5 != 0).select(i.alias("id"), F.when(i % 4 != 0, F.concat(F.lit("read "), "c_name")).alias("city"), F.lit("role").alias("role"))
    return ST.merged_profile(old, new, ["city", "role"]).select("id", "city", "role")


@query("registered_channels", f"""{_Q}, r AS (SELECT 'Channel' || k AS channel_key, k % 2 = 0 AS is_active, k * 100 AS last_message_id FROM range(30, 50) t(k)), s AS (SELECT channel AS channel_key, max(message_id) AS mark FROM queue GROUP BY 1)
    SELECT channel_key, coalesce(is_active, true) AS is_active, greatest(last_message_id, mark) AS last_message_id FROM r FULL JOIN s USING (channel_key)""")
def registered_channels(spark, sf_dir):
    """ST15, AGG15 over all events as messages of forty channels, of which some are registered."""
    registry = spark.range(30, 50).select(F.concat(F.lit("Channel"), F.col("id").cast("string")).alias("channel_key"), (F.col("id") % 2 == 0).alias("is_active"), (F.col("id") * 100).alias("last_message_id"))
    return ST.registered(registry, queue(spark, sf_dir).select(F.col("channel").alias("channel_key"), "message_id"))


@query("channel_spellings", f"""{_Q}, n AS (SELECT CASE id % 3 WHEN 0 THEN channel WHEN 1 THEN '@' || lower(channel) ELSE upper(channel) END AS name, id AS position FROM queue)
    SELECT arg_min(name, position) AS name, min(position) AS position FROM (SELECT regexp_replace(name, '^@', '') AS name, position FROM n) GROUP BY lower(name)""")
def channel_spellings(spark, sf_dir):
    """SET1, SRC10 over the channels of all events, spelt in three ways."""
    spelt = F.when(F.col("id") % 3 == 0, F.concat(F.lit(" "), "channel")).when(F.col("id") % 3 == 1, F.concat(F.lit("@"), F.lower("channel"))).otherwise(F.upper("channel"))
    return ST.first_spellings(queue(spark, sf_dir).select(spelt.alias("name"), F.col("id").alias("position")))


@query("completeness_of_customers", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 5 = 1 THEN 25 ELSE 0 END + 25 AS points FROM customer")
def completeness_of_customers(spark, sf_dir):
    """AGG18 over all customers as profiles with lists that are full, empty or missing."""
    i, one, none = F.col("c_custkey"), F.array("c_name"), F.array().cast("array<string>")
    lists = {"a": F.when(i % 2 == 0, one), "b": F.when(i % 3 == 0, one).otherwise(none), "c": F.when(i % 5 == 1, one).when(i % 5 == 2, none), "d": one}
    p = read_table(spark, sf_dir, "customer").select(i.alias("id"), *[v.alias(k) for k, v in lists.items()])
    return p.select("id", R.completeness(list("abcd")).alias("points"))
