"""The postings engine's tables over the data folder's tables of nearest shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postgrove.session import read_table


def cases(key: str, values: list[str | None]):
    """The value at the position that the key has modulo their number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


ROLES = [None, "Software Intern", "Backend Engineer (Java)", "Data Analyst", "International Sales Executive", "React Developer", "QA Engineer"]
PLACES = [None, "Bengaluru", "Remote / Anywhere", "New Delhi", "Pune"]
KINDS = [None, "Full Time", "Part-time", "Contract", "Internship", "Remote"]
BATCHES = [None, "2024, 2025", "2025", "2026 pass out"]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers as postings with their companies."""
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("company"),
        cases("o_orderkey", ROLES).alias("role"),
        cases("o_orderkey", BATCHES).alias("batch"),
        cases("o_orderkey", PLACES).alias("location"),
        cases("o_orderkey", KINDS).alias("employment_type"),
        F.col("c_mktsegment").alias("source"),
        F.col("o_orderdate").alias("posted_at"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "expired").alias("status"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.col("o_orderdate") + F.expr("INTERVAL 21 DAYS")).alias("expires_at"),
        F.when(F.pmod("o_orderkey", F.lit(4)) > 0, F.pmod("o_orderkey", F.lit(4)) == 1).alias("verified"),
        F.when(F.pmod("o_orderkey", F.lit(8)) > 0, F.pmod("o_orderkey", F.lit(8)) < 5).alias("feed_active"),
        F.when(F.pmod("o_orderkey", F.lit(9)) > 1, F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string"))).alias("apply_url"),
        F.when(F.pmod("o_orderkey", F.lit(11)) == 2, F.lit("  ")).alias("source_url"),
        cases("o_orderkey", [None, "needs_review", "verified", "broken", "pending"]).alias("url_status"),
    )


def _sql_cases(key: str, values: list[str | None]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


#: The same for DuckDB, as a common table expression.
POSTINGS_SQL = f"""postings AS (
    SELECT o_orderkey AS id, c_name AS company, {_sql_cases('o_orderkey', ROLES)} AS role, {_sql_cases('o_orderkey', BATCHES)} AS batch, {_sql_cases('o_orderkey', PLACES)} AS location,
        {_sql_cases('o_orderkey', KINDS)} AS employment_type, c_mktsegment AS source, o_orderdate AS posted_at, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' END AS status,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 21 DAY END AS expires_at, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS verified,
        CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 8 < 5 END AS feed_active, CASE WHEN o_orderkey % 9 > 1 THEN 'https://jobs.example.com/' || o_orderkey END AS apply_url,
        CASE WHEN o_orderkey % 11 = 2 THEN '  ' END AS source_url, {_sql_cases('o_orderkey', [None, 'needs_review', 'verified', 'broken', 'pending'])} AS url_status
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of the ingest queue."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Channel"), (F.col("user_id") % 40).cast("string")).alias("channel"),
        F.floor(F.col("event_id") / 2).cast("long").alias("message_id"),
        F.col("ts").alias("received_at"),
        F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").when(F.col("event_type") == "error", "retry_wait").when(F.col("event_type") == "purchase", "completed").otherwise("archived").alias("status"),
        (F.col("event_id") % 8 + 1).cast("long").alias("attempts"),
        F.when(F.col("event_id") % 3 > 0, F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("claimed_at"),
        F.when(F.col("event_id") % 4 > 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_retry_at"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 10).alias("job_id"),
        "value",
        "event_type",
        "user_id",
    )


QUEUE_SQL = """queue AS (
    SELECT event_id AS id, 'Channel' || (user_id % 40) AS channel, event_id // 2 AS message_id, ts AS received_at,
        CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'retry_wait' WHEN 'purchase' THEN 'completed' ELSE 'archived' END AS status,
        event_id % 8 + 1 AS attempts, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 2 MINUTE END AS claimed_at, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 1 HOUR END AS next_retry_at,
        CASE WHEN event_id % 5 = 0 THEN event_id * 10 END AS job_id, value, event_type, user_id
    FROM events)"""


# ---- pages as the articles and career pages of postings: each page gets a link, a company and so on by its id, and some anchors at the end of its article

ARTICLE_LINKS = [
    "https://freshershunt.in/p/", "https://acme.wd1.myworkdayjobs.com/job/", "https://careers.acme.com/jobs/", "https://isro.gov.in/notice/", "https://bit.ly/", "https://www.linkedin.com/jobs/", "https://forms.gle/",
    "https://acme.com/apply?utm_source=x&job_id=", "http://www.bolt-labs.com/careers/", "nonsense", None,
]
COMPANIES = [None, "Acme", "Bolt Labs Pvt Ltd", "ISRO", "Acme & Sons"]
TITLES = [None, "Backend Engineer", "Data Analyst", "The Senior Machine Learning Developer Intern"]
SITES = [None, "Pune", "New Delhi, India"]
ARTICLE_ENDS = [
    "",
    """<a href="https://acme.wd1.myworkdayjobs.com/r/1"><b>Apply</b> now</a> <a href='https://forms.gle/z'>Register</a> <a href="https://t.me/jobs">Apply now</a>""",
    """<button class="b">Apply now</button> Acme hires a Backend Engineer in Pune. <meta property="og:site_name" content="Acme Careers">""",
    """<button>Apply now</button> A Data Analyst for Pune. <meta content='Acme &amp; Sons | Bolt Labs | ISRO' name='og:site_name'>""",
    """<form action="/apply/1"><input type="file" name="resume"></form> Bolt Labs Pvt Ltd wants a Data Analyst, remote. Apply now""",
    """This position has been filled. <a href="/apply/own">Apply here</a> <a href="https://acme.com/careers/9?utm_source=x">more jobs</a> <a rel="nofollow sponsored" href="https://acme.com/jobs/1">Apply</a>""",
    """<a href="https://bolt-labs.com/">home</a><a href="https://bolt-labs.com/jobs/77">Apply link &raquo;</a><a href="https://bolt-labs.com/jobs/77/">Official site</a><!-- <a href="https://acme.com/jobs/3">Apply</a> -->"""
    """<a href="https://out.example.org/go?url=https%3A%2F%2Fboards.greenhouse.io%2Facme%2Fjobs%2F1">Direct link</a>""",
    """<a href="https://ad.doubleclick.net/clk?url=https%3A%2F%2Facme.com%2Fjobs">Apply</a><a href="https://docs.google.com/forms/d/1/viewform">Application form</a><a href=https://www.indeed.com/jobs/2>Jobs</a>"""
    """<a href="https://freshershunt.in/other">Apply</a><a href="//cdn.example.com/share?x=1">share</a><a href="mailto:a@b.example">Apply</a>""",
]
STATUSES = [None, "pending", "verified", "needs_review", "verified", None, "needs_review", "verified"]


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, company, role, location, status, resolved): all pages as articles."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.concat(cases("page_id", ARTICLE_LINKS), F.col("page_id").cast("string")).alias("url"),
        F.replace(F.col("html"), F.lit("</article>"), F.concat(cases("page_id", ARTICLE_ENDS), F.lit("</article>"))).alias("html"),
        cases("page_id", COMPANIES).alias("company"),
        cases("page_id", TITLES).alias("role"),
        cases("page_id", SITES).alias("location"),
        cases("page_id", STATUSES).alias("status"),
        F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("https://jobs.lever.co/acme/"), F.col("page_id").cast("string"))).when(F.pmod("page_id", F.lit(9)) == 1, F.lit("https://t.co/x")).alias("resolved"),
    )


def literal(value: str | None) -> str:
    """A text as an SQL literal."""
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_case(key: str, values: list[str | None]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in enumerate(values)) + " END"


ARTICLES_SQL = f"""articles AS (
    SELECT page_id, {sql_case('page_id', ARTICLE_LINKS)} || page_id AS url, replace(html, '</article>', {sql_case('page_id', ARTICLE_ENDS)} || '</article>') AS html,
        {sql_case('page_id', COMPANIES)} AS company, {sql_case('page_id', TITLES)} AS role, {sql_case('page_id', SITES)} AS location, {sql_case('page_id', STATUSES)} AS status,
        CASE WHEN page_id % 2 = 0 THEN 'https://jobs.lever.co/acme/' || page_id WHEN page_id % 9 = 1 THEN 'https://t.co/x' END AS resolved
    FROM pages)"""

# ---- documents as posts: each document between a first line and some last lines, by its id

HEADS = ["", "🔹 Acme is hiring: Backend Engineer", "=====", "Apply: https://careers.acme.example/jobs/1.", "Join our Telegram channel https://t.me/jobs", "Register here", "Company: Acme Labs\r\n Location - Pune "]
TAILS = [
    "", "https://forms.gle/abc", "Follow us on https://instagram.com/x and apply https://bit.ly/q)", "@jobsvilla", "- - -", "Apply link\nhttps://acme.example/x?y=1,\n\n\n\nAll the best",
    "Subscribe to our YouTube channel: https://youtu.be/1 | Career: https://acme.example/careers", "👉 Details – https://www.linkedin.com/company/acme/ •", "https://linktr.ee/x\nhttps://www.linkedin.com/jobs/view/1",
    "more jobs:", "Apply here: https://freshershunt.in/p/1. Mentioned at https://freshershunt.in/p/12 too, " + "and so on " * 14 + "https://freshershunt.in/p/1",
]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): all documents as posts; a null text stays null."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat(cases("doc_id", HEADS), F.lit("\n"), "text", F.lit("\n"), cases("doc_id", TAILS)).alias("text"))


POSTS_SQL = f"posts AS (SELECT doc_id AS id, {sql_case('doc_id', HEADS)} || chr(10) || text || chr(10) || {sql_case('doc_id', TAILS)} AS text FROM documents)"



def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, link, company, body, source, channel, created): all posts with a link and a company by their id."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("channel"))
    day = F.make_dt_interval(F.pmod("id", F.lit(400)))
    return posts(spark, sf_dir).withColumnRenamed("text", "body").join(docs, "id").select(
        "id", F.concat(cases("id", ARTICLE_LINKS), F.col("id").cast("string")).alias("link"), cases("id", COMPANIES).alias("company"), "body", "source", "channel",
        F.when(F.pmod("id", F.lit(17)) > 0, F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("created"),
    )


AUDITED_SQL = f"""{POSTS_SQL}, audited AS (SELECT p.id, {sql_case('p.id', ARTICLE_LINKS)} || p.id AS link, {sql_case('p.id', COMPANIES)} AS company, p.text AS body, d.source, d.lang AS channel,
    CASE WHEN p.id % 17 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (p.id % 400) DAY END AS created FROM posts p JOIN documents d ON d.doc_id = p.id)"""

# ---- posts with labelled lines, and customers with company names of all sorts

DETAILS = [
    "", "Role: Data Analyst\nSalary - 4 LPA\nSalary: 5 LPA", "• Skills required : SQL, Python\n- bring your laptop\nApply Link - https://acme.example/apply", "Company: Telegram channel\nCompany : Bolt Labs",
    "Mail ads@promo.example or jobs@acme.example\nlast date to apply: 30 Sep", "Acme Off Campus Drive 2026 | Bangalore\nAcme hires. It is good.", "Backend Engineer\nAcme\nAcme – Backend Engineer",
    "Batch: 2025 📌\nJob Type - Internship,\nExp: 0-1 years", "Qualification: B.E/B.Tech (https://t.me/x)\n📍Location: Pune -", "How to apply\nIcontent.method t.me/abc keeps", "@handle here @someone\nShare with your friends", "-----\nPay:\nDeadline - @x",
]


def detailed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, company, role): posts with labelled lines and some stored fields."""
    both = posts(spark, sf_dir).withColumn("text", F.concat(cases("id", DETAILS), F.lit("\n"), "text"))
    return both.select("id", "text", cases("id", COMPANIES).alias("company"), cases("id", [None, "Backend Engineer", " "]).alias("role"))


DETAILED_SQL = f"{POSTS_SQL}, detailed AS (SELECT id, {sql_case('id', DETAILS)} || chr(10) || text AS text, {sql_case('id', COMPANIES)} AS company, {sql_case('id', [None, 'Backend Engineer', ' '])} AS role FROM posts)"

NAMES = [
    None, "Tata Consultancy Services (TCS)", "Confidential", "byjus.in", "Larsen & Toubro Off Campus Drive 2026", "A", "2026", "Micron Technology Inc.", "HPE Careers", "Start-up", "Leading MNC", "www.Zoho.com", "  ",
    "Not Disclosed", "State Bank of India!", "Deutsche-Bank AG", "[New] Acme, Pvt. Ltd.",
]


def named_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): all customers, most with a name of the list."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.coalesce(cases("c_custkey", NAMES), F.concat("c_name", F.lit(" Private Limited"))).alias("name"))


NAMED_SQL = f"named AS (SELECT c_custkey AS id, coalesce({sql_case('c_custkey', NAMES)}, c_name || ' Private Limited') AS name FROM customer)"
