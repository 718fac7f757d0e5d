"""Decisions over judged links (UR16-UR21, UR23, SC8, SC10, SC11): what is stored, repaired or left to a reader. All are CASE expressions over
columns that other functions give; pages and redirects come as tables, as nothing here uses a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions import posts as P, urls as U
from postgrove.functions.text import accepted_field, accepted_type, ascii_bounds, trimmed
from postgrove.operators import pages as A

# What the parts of a page's evidence weigh, and from which sum on a link counts as verified.
EVIDENCE = {"official": 30, "action": 30, "company": 20, "role": 10, "location": 5, "active": 5}
VERIFIED_AT = 70
# What signs of the company and of the role weigh, and from which sum on they count as met.
COMPANY_SIGNS = {"text": 40, "title": 30, "url": 20, "site": 25}
ROLE_SIGNS = {"text": 50, "word": 15, "title": 25}
MET_AT = 40
# What shows that one can apply on a page, or that one no longer can.
ACTION = [
    r"<button\b[^>]*>[^<]{0,60}\bapply\b",
    r"<a\b[^>]*\bhref\b[^>]*>[^<]{0,60}\bapply\b",
    r"""<input\b[^>]*type\s*=\s*["']submit["'][^>]*value\s*=\s*["'][^"']*\bapply\b""",
    r"""<form\b[^>]*\baction\s*=\s*["'][^"']*(?:apply|application)""",
    r"""\bdata-(?:automation|qa|testid)\s*=\s*["'][^"']*apply""",
]
FORM, FORM_FIELD = r"<form\b[^>]*>", r"""\bname\s*=\s*["'][^"']*(?:resume|cv|application)|\btype\s*=\s*["']file["']"""
SYSTEM_WORDS = r"\bapply|submit|application\b"
POSTING_ID = r"(?i)[?&/](?:job[_-]?id|position[_-]?id|req[_-]?id|jobid|requisition[_-]?id)[=/]"
CLOSED = [r"position.*?(?:filled|closed)", r"application.*?(?:closed|expired)", r"no longer.*?accepting", r"deadline.*?passed", r"this\s+(?:job|position|role).*?(?:expired|closed)"]
ANYWHERE = r"\b(remote|hybrid|work from home|wfh|anywhere)\b"
TELLING = r"engineer|developer|analyst|manager|intern|designer|architect|scientist"
TITLE = r"<title[^>]*>([^<]+)</title>"
SITE_NAME = r"""<meta\b[^>]*(?:property|name)\s*=\s*["']og:site_name["'][^>]*>"""
# Trust in the results of a web search and in links of a site map, and words that say nothing of a role.
TIERS = {"system": 80, "company": 100, "careers": 40, "other": 20}
MAPPED_PATH = r"(?i)/(?:careers?|jobs?|job-?de\w+|apply|application|openings?|vacanc\w*|positions?|recruit\w*|candidate)(?:[/\-_.?=]|$)"
ROLE_FILLER = [
    "off", "campus", "drive", "hiring", "recruitment", "batch", "freshers", "fresher", "apply", "now", "online", "jobs", "job", "opening", "openings", "vacancy", "notification", "salary",
    "eligibility", "for", "and", "the", "2024", "2025", "2026", "2027",
]
# Links in a body, the punctuation behind them, words that call to apply, and how far around a link they count.
BODY_LINK = r"""(?i)https?://[^\s<>"'`)\]}]+"""
BODY_TAIL = r"[.,;:!?]+$"
CALLS = r"(?i)\b(?:apply|application|register|registration|click\s+here|direct\s+link|job\s+link|official\s+link)\b"
AROUND = 120


def judge_resolved(df: DataFrame, url: Column, resolved: Column, company: Column, now: str = "_now") -> DataFrame:
    """UR12: ``df`` with ``now``, the link as it stands judged, and kind and link of what it leads to: a wrapper counts as its target, and as suspicious if that is unknown or another wrapper."""
    both = U.judge(U.judge(df, url, company, now), resolved, company, "_beyond")
    wrapper, beyond = F.col(f"{now}_kind") == "wrapper", F.col("_beyond_kind")
    known = F.col("_beyond_link").isNotNull()
    kind = F.when(~wrapper, F.col(f"{now}_kind")).when(~known | (beyond == "wrapper"), "suspicious").otherwise(beyond)
    return U.worked_out(both, kind=kind, link=F.when(wrapper & known, F.col("_beyond_link")).otherwise(F.col(f"{now}_link")))


def winners(candidates: DataFrame) -> DataFrame:
    """UR15 by post: how many candidates its page has and the one that may be taken without a reader, if any."""
    ranked = U.best_candidates(candidates)
    return ranked.groupBy("post").agg(F.count(F.lit(1)).alias("n_found"), F.max(F.when(F.col("taken"), F.col("url"))).alias("winner"), F.max(F.when(F.col("taken"), F.col("score"))).alias("winner_score"))


def ingest_decision(posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """UR16 over posts (id, url, resolved: where a wrapper leads, company, readable: the page could be read) and page candidates (post, url, score, pos): a direct link is stored; an
    aggregator's page gives its sure candidate if that is direct itself; everything else is left to review with what was found."""
    judged = judge_resolved(posts, F.col("url"), F.col("resolved"), F.col("company"))
    met = U.judge(judged.join(winners(candidates).withColumnRenamed("post", "id"), "id", "left"), F.col("winner"), F.col("company"), "_won")
    article = F.col("kind") == "aggregator"
    fine = article & F.col("readable") & (F.col("_won_kind") == "direct")
    reason = (
        F.when(F.col("kind") == "direct", "direct").when(F.col("kind") == "unresolvable", "unresolvable").when(~article, F.col("kind")).when(~F.col("readable"), "page unreadable")
        .when(F.col("n_found").isNull(), "no candidate").when(F.col("winner").isNull(), "none conclusive").when(fine, "resolved from the page").otherwise("best candidate is not direct")
    )
    return met.select(
        "id",
        F.when(F.col("kind") == "direct", F.col("link")).when(fine, F.col("_won_link")).alias("apply_url"),
        F.when(article, F.col("link")).alias("source_url"),
        reason.alias("reason"),
    )


def repair_decision(posts: DataFrame, candidates: DataFrame) -> DataFrame:
    """UR17 over posts (id, apply_url, url_status, source_url, company, resolved) and candidates (post, url, score, pos) of the pages of aggregators: repaired, flagged or unchanged, with the
    link, status and source to write. Pending posts stay, verified ones stay while their link is judged direct; a sure direct candidate of an aggregator's page replaces its link; else an aggregator's link
    moves to the source and any other stays for review."""
    old, status = F.col("apply_url"), F.col("url_status")
    judged = judge_resolved(posts, old, F.col("resolved"), F.col("company"))
    met = U.judge(judged.join(winners(candidates).withColumnRenamed("post", "id"), "id", "left"), F.col("winner"), F.col("company"), "_won")
    now = F.col("_now_kind")
    said = lambda *values: F.coalesce(status.isin(*values), F.lit(False))
    left_alone = said("pending") | (said("verified") & ((now == "direct") | ((F.col("kind") == "direct") & F.col("link").eqNullSafe(old))))
    direct, article = F.col("kind") == "direct", F.col("kind") == "aggregator"
    nothing = (F.col("kind") == "unresolvable") & F.col("link").isNull()
    found = article & (F.col("_won_kind") == "direct")
    return met.select(
        "id",
        F.when(left_alone, "unchanged").when(direct | F.coalesce(found, F.lit(False)), "repaired").otherwise("flagged").alias("outcome"),
        F.when(left_alone, old).when(direct, F.col("link")).when(nothing, None).when(found, F.col("_won_link")).when(article, None).otherwise(old).alias("apply_url"),
        F.when(left_alone, status).when(direct | F.coalesce(found, F.lit(False)), "verified").when(nothing & old.isNull(), "pending").otherwise("needs_review").alias("url_status"),
        F.when(~left_alone & article, F.col("link")).otherwise(F.col("source_url")).alias("source_url"),
        F.when(left_alone, now).when(F.coalesce(found, F.lit(False)), "direct").otherwise(F.col("kind")).alias("verdict"),
        F.when(~left_alone & F.coalesce(found, F.lit(False)), F.col("winner_score")).alias("score"),
    )


def body_links(text: Column) -> Column:
    """UR18: array of (raw, at, calls) for each link of a body: the link without the punctuation behind it, where it starts (from 0), and whether words within AROUND
    characters before or behind it call to apply."""
    gaps, found = F.split(text, BODY_LINK, -1), F.regexp_extract_all(text, F.lit(BODY_LINK), F.lit(0))

    def entry(whole: Column, i: Column) -> Column:
        at = F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(found, F.lit(1), i), ""))
        return F.struct(F.regexp_replace(whole, BODY_TAIL, "").alias("raw"), at.cast("int").alias("at"))

    def judged(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["at"] - AROUND, F.lit(0)) + 1, F.least(x["at"], F.lit(AROUND)))
        behind = F.substring(text, x["at"] + F.length(x["raw"]) + 1, F.lit(AROUND))
        return F.struct(x["raw"].alias("raw"), x["at"].alias("at"), (before.rlike(ascii_bounds(CALLS)) | behind.rlike(ascii_bounds(CALLS))).alias("calls"))

    return F.transform(F.transform(found, entry), judged)


def rewritten(text: Column, better: Column) -> Column:
    """UR18: aggregators' links that words call to apply at get the link that ``better`` (map from link to link) has for them, each at its own place; all else stays."""
    def splice(x: Column) -> Column:
        new = lambda y: F.when(y["calls"] & (U.verdict(y["raw"], F.lit(None).cast("string")) == "aggregator"), F.element_at(better, y["raw"]))
        gaps = F.split(text, BODY_LINK, -1)
        tails = F.transform(F.regexp_extract_all(text, F.lit(BODY_LINK), F.lit(0)), lambda whole: F.regexp_extract(whole, BODY_TAIL, 0))
        links = F.zip_with(x, tails, lambda y, tail: F.concat(F.coalesce(new(y), y["raw"]), tail))
        return F.array_join(F.zip_with(gaps, links, lambda gap, link: F.concat(gap, F.coalesce(link, F.lit("")))), "")

    return U.let(body_links(text), splice)


def search_results(found: DataFrame) -> DataFrame:
    """UR19 over the results of a web search (job, place, url, title, company): only direct links, in order of trust: the company's host, an applicant system, a careers path, others; the
    search's own order decides between equals."""
    judged = U.judge(found, F.col("url"), F.col("company"), "_j").where("_j_kind = 'direct' AND _j_link IS NOT NULL").withColumn("link", F.col("_j_link"))
    tier = (
        F.when(F.col("_j_system"), TIERS["system"]).when(F.col("_j_company"), TIERS["company"])
        .when(F.col("link").rlike(r"(?i)/careers?|/jobs?|/apply"), TIERS["careers"]).otherwise(TIERS["other"])
    )
    placed = judged.withColumn("tier", tier).withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("tier"), "place")))
    return placed.select("job", "rank", "link", (F.col("tier") / 10).cast("int").alias("score"), F.when(F.col("tier") >= TIERS["system"], "high").otherwise("medium").alias("confidence"), F.nullif("title", F.lit("")).alias("label"))


def mapped_links(found: DataFrame) -> DataFrame:
    """UR19 over a site map's links (job, url, title, company, role): direct ones of an applicant system, the company or a path, each once with its best score; high only where the role is named too."""
    judged = U.judge(found, F.col("url"), F.col("company"), "_j").where("_j_kind = 'direct' AND _j_link IS NOT NULL").withColumn("link", F.col("_j_link"))
    path, title = A.path_of(F.col("link")), trimmed(F.coalesce("title", F.lit("")))
    words = F.filter(F.split(F.lower(F.coalesce("role", F.lit(""))), "[^a-z0-9+#]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*ROLE_FILLER))
    named = F.size(F.filter(words, lambda w: F.lower(F.concat(path, F.lit(" "), title)).contains(w)))
    flag = lambda when, n: F.when(when, n).otherwise(0)
    parts = judged.withColumns({"lead": flag(F.col("_j_system"), 3) + flag(F.col("_j_company"), 3) + flag(path.rlike(MAPPED_PATH), 2), "named": named})
    scored = parts.where("lead > 0").withColumn("score", F.col("lead") + F.least("named", F.lit(2)))
    once = scored.groupBy("job", "link").agg(F.max("score").alias("score"), F.max(F.struct("score", "named"))["named"].alias("named"))
    return once.select("job", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("score"), "link")).alias("rank"), "link", "score", F.when((F.col("score") >= 5) & (F.col("named") > 0), "high").otherwise("medium").alias("confidence"))


def rendered_links(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """UR19 over an article's candidates (job, link, score, confidence) and the bare links that its page shows (job, page_url, url, company): direct links of other hosts that belong to an
    applicant system or the company are added at medium, unless the article has them."""
    judged = U.judge(links, A.absolute(F.col("url"), F.col("page_url")), F.col("company"), "_j").withColumn("link", F.col("_j_link"))
    system, own = F.col("_j_system"), F.col("_j_company")
    extra = judged.where((F.col("_j_kind") == "direct") & (F.col("_j_host") != U.host_of(F.col("page_url"))) & (system | own)).groupBy("job", "link").agg(F.max(F.when(system & own, 4).otherwise(3)).alias("score"))
    new = extra.join(candidates.select("job", "link"), ["job", "link"], "left_anti").withColumn("confidence", F.lit("medium"))
    both = candidates.select("job", "link", "score", "confidence").unionByName(new)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("score"), "link")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """UR20 over (id, url, html, company, role, location): the signs that a page is the posting's own and open, their sum, and the verdict. A page must be direct and official, offer an
    application and not be closed; one that is no applicant system must name the company. Pages that were not read keep a sum of 0."""
    url, company, role, place = F.col("url"), F.col("company"), F.col("role"), F.col("location")
    pages = U.judge(pages.withColumn("_page_host", U.host_of(url)), url, company, "_j")
    host = F.col("_page_host")
    plain = F.lower(F.col("html"))
    for pattern in (r"(?s)<script[^>]*>.*?</script>", r"(?s)<style[^>]*>.*?</style>", r"<[^>]+>", f"[{P.SPACE}]+"):
        plain = F.regexp_replace(plain, pattern, " ")
    meta, content = F.regexp_extract(F.lower(F.col("html")), SITE_NAME, 0), r"""\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    site = F.concat(F.regexp_extract(meta, content, 1), F.regexp_extract(meta, content, 2))  # one of them is empty
    read = pages.withColumns({
        "_html": F.lower(F.col("html")), "_text": P.stripped(plain), "_direct": F.col("_j_kind") == "direct", "_system": U.under(host, U.APPLICANT_SYSTEMS),
        "_title": F.regexp_extract(F.lower(F.col("html")), TITLE, 1), "_site": site,
        "_names": F.filter(F.split(F.lower(company), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*U.GENERIC_COMPANY)),
        "_words": F.filter(F.split(F.lower(role), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "for")),
        "_places": F.filter(F.split(F.lower(place), r"\s+|,"), lambda w: F.length(w) > 2),
    }).withColumn("_official", F.col("_direct") & (F.col("_system") | U.matches_company(host, company) | host.rlike(U.OFFICIAL_SUFFIX)))
    html, text = F.col("_html"), F.col("_text")
    some = lambda c, hay: F.coalesce(F.exists(F.col(c), lambda w: hay.contains(w)), F.lit(False))
    add = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    given = lambda c: F.coalesce(c != "", F.lit(False))
    of_company = add(text.contains(F.lower(company)), COMPANY_SIGNS["text"]) + add(some("_names", F.col("_title")), COMPANY_SIGNS["title"]) + add(some("_names", F.lower(url)), COMPANY_SIGNS["url"]) + add(some("_names", F.col("_site")), COMPANY_SIGNS["site"])
    telling = F.size(F.filter("_words", lambda w: w.rlike(TELLING) & text.contains(w)))
    of_role = add(text.contains(F.lower(role)), ROLE_SIGNS["text"]) + F.greatest(telling, F.lit(0)) * ROLE_SIGNS["word"] + add(some("_words", F.col("_title")), ROLE_SIGNS["title"])
    acts = html.rlike("|".join(f"(?:{ascii_bounds(p)})" for p in ACTION)) | (html.rlike(FORM) & html.rlike(ascii_bounds(FORM_FIELD))) | (F.col("_system") & html.rlike(ascii_bounds(SYSTEM_WORDS))) | url.rlike(POSTING_ID)
    scored = read.withColumns({
        "company_score": F.when(given(company), F.least(of_company, F.lit(100))).otherwise(0), "role_score": F.when(given(role), F.least(of_role, F.lit(100))).otherwise(0),
        "has_location": ~given(place) | text.contains(F.lower(place)) | some("_places", text) | text.rlike(ascii_bounds(ANYWHERE)),
        "has_action": acts, "active": ~text.rlike("|".join(CLOSED)), "official": F.coalesce("_official", F.lit(False)),
    })
    seen = F.col("official") & F.col("_html").isNotNull()
    flags = {"official": F.col("official"), "action": F.col("has_action"), "company": F.col("company_score") >= MET_AT, "role": F.col("role_score") >= MET_AT, "location": F.col("has_location"), "active": F.col("active")}
    total = sum((add(v, EVIDENCE[k]) for k, v in flags.items()), F.lit(0))
    judged = scored.withColumn("confidence", F.when(seen, total).otherwise(0))
    good = seen & F.col("has_action") & F.col("active") & (F.col("_system") | flags["company"]) & (F.col("confidence") >= VERIFIED_AT)
    zero = lambda c, default: F.when(seen, F.col(c)).otherwise(default).alias(c)
    return judged.select(
        "id", "url", "official", F.when(F.col("official"), F.when(F.col("_system"), "applicant system").otherwise("company page")).alias("source_type"), zero("company_score", 0), zero("role_score", 0),
        zero("has_location", False), zero("has_action", False), zero("active", True), "confidence", F.coalesce(good, F.lit(False)).alias("verified"),
    )


def discovered(evidence: DataFrame, stages: tuple[str, ...] = ("direct", "scrape", "search", "site"), per_stage: int = 4, calls: int = 5) -> DataFrame:
    """UR21 over judged pages (job, stage, place, url, external, verified): stages in order, at most ``per_stage`` new links each and ``calls`` external pages in all;
    the first verified link ends a job's search. What counts against a budget is what stands before a link in this order."""
    of = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    once = evidence.withColumn("_stage", of).groupBy("job", "url").agg(F.min_by(F.struct("_stage", "place", "external", "verified", "stage"), F.struct("_stage", "place")).alias("r")).select("job", "url", "r.*")
    order = Window.partitionBy("job").orderBy("_stage", "place", "url")
    tried = once.withColumn("_k", F.row_number().over(Window.partitionBy("job", "_stage").orderBy("place", "url"))).where(F.col("_k") <= per_stage)
    spent = tried.withColumn("_spent", F.sum(F.col("external").cast("int")).over(order)).where(~F.col("external") | (F.col("_spent") <= calls))
    first = F.min_by(F.struct("url", "stage"), F.when(F.col("verified"), F.struct("_stage", "place", "url")))
    return spent.groupBy("job").agg(first.alias("f"), F.count(F.lit(1)).alias("n_allowed")).select("job", "f.url", "f.stage", "n_allowed")


def damage(stored: Column) -> Column:
    """UR23: why a stored link cannot be used, judged by itself; null if it can, or if there is none."""
    host = P.host_of(stored)
    return F.when(F.coalesce(stored == "", F.lit(True)), None).when(host == "", "not a link").when(~host.contains("."), "malformed host").when(P.promotional_link(stored), "promotion")


def restored_link(stored: Column, raw_text: Column) -> Column:
    """UR23: a link that cannot be used gives way to the post's own best link, or to none; all others stay."""
    return F.when(damage(stored).isNotNull(), P.apply_link(F.coalesce(raw_text, F.lit("")))).otherwise(stored)


def sanitized(labelled: DataFrame) -> DataFrame:
    """SC8-SC11 over labels (id, text, is_job, company, role, location, employment_type, apply_url) that a model gave: fields that the text does not bear out are dropped; a post
    without a company or a role left is none."""
    text = F.col("text")
    rows = labelled.select(
        "id", "is_job", *[accepted_field(F.col(c), text, most).alias(c) for c, most in (("company", 120), ("role", 160), ("location", 160))], accepted_type(F.col("employment_type")).alias("employment_type"),
        F.when(U.safe(trimmed(F.col("apply_url"))) & text.contains(trimmed(F.col("apply_url"))), trimmed(F.col("apply_url"))).alias("apply_url"),
    )
    reason = F.when(~F.coalesce("is_job", F.lit(False)), "not a job").when(F.col("company").isNull(), "no company").when(F.col("role").isNull(), "no role").otherwise("ok")
    return rows.withColumn("outcome", reason).drop("is_job")
