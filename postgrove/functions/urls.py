"""Link functions (UR1-UR16, UR22-UR24) over http(s) links: ``judge`` over a table's links, with reasons and hosts of all alphabets, and column
expressions for links in ASCII.

Spark's URL parser keeps the case of hosts, so they are lowered here; links that it cannot parse are null. International
host names become ASCII in ``judge`` and are judged so (punycode is suspicious by itself).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions.idna import ascii_link

# Kinds of hosts; an entry stands for itself and all hosts below it.
AGGREGATORS = [
    "freshershunt.in", "job4freshers.co.in", "offcampusjobs4u.com", "freshersvoice.com", "freshercareers.in", "placementdrive.in", "fresheroffcampus.com", "kickcharm.com",
    "offcampusjobdrives.com", "jobs4fresher.com", "careerten.com",
]
APPLICANT_SYSTEMS = [
    "myworkdayjobs.com", "workdayjobs.com", "workday.com", "taleo.net", "successfactors.com", "successfactors.eu", "oraclecloud.com", "greenhouse.io", "lever.co", "ashbyhq.com",
    "smartrecruiters.com", "icims.com", "jobvite.com", "darwinbox.in", "darwinbox.com", "zohorecruit.com", "zohorecruit.in", "keka.com", "freshteam.com", "joinsuperset.com", "eightfold.ai",
    "phenompeople.com", "avature.net", "brassring.com", "peoplestrong.com", "hirist.tech",
]
FORM_HOSTS = [
    "forms.gle", "forms.office.com", "forms.microsoft.com", "forms.cloud.microsoft", "typeform.com", "zohoforms.com", "forms.zohopublic.in", "forms.zohopublic.com",
]
FORM_PATH_HOSTS = ["docs.google.com", "airtable.com"]
JOB_BOARDS = [
    "linkedin.com", "indeed.com", "indeed.co.in", "naukri.com", "glassdoor.com", "glassdoor.co.in", "monsterindia.com", "foundit.in", "shine.com", "timesjobs.com", "internshala.com",
    "angel.co", "wellfound.com",
]
WRAPPERS = [
    "bit.ly", "bitly.com", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "rb.gy", "is.gd", "buff.ly", "lnkd.in", "l.facebook.com", "lm.facebook.com",
    "l.instagram.com", "href.li", "urlz.fr", "s.id", "linktr.ee", "openinapp.co", "pdlink.in", "pdlinks.in", "imp.i384100.net", "go.acciojob.com", "link.outskill.com",
]
SUSPICIOUS_PARTS = [
    "fresher", "offcampus", "off-campus", "jobs4u", "placement", "govtjob", "sarkari", "careerdose", "alljob", "jobalert", "jobupdate", "jobsdrive", "jobhunt", "naukriupdate",
]
CAREER_LABELS = ["career", "careers", "job", "jobs", "apply", "applications", "recruit", "recruiting", "recruitment", "hiring", "talent"]
TWO_PART_SUFFIXES = ["co.in", "co.uk", "co.jp", "co.kr", "co.nz", "co.za", "com.au", "com.br", "com.mx", "com.sg", "ac.in", "ac.uk", "gov.in", "org.uk", "net.in"]
GENERIC_COMPANY = [
    "the", "inc", "ltd", "llc", "llp", "plc", "pvt", "private", "limited", "corp", "corporation", "company", "group", "global", "india", "technologies", "technology", "solutions",
    "services", "systems", "software", "labs", "consulting", "international",
]
WRAPPED_IN = ["url", "u", "target", "redirect", "redirect_to", "redirecturl", "dest", "destination", "link", "goto", "out", "q"]
TRACKING = r"(?i)(utm_[a-z_]*|fbclid|gclid|msclkid|igshid|mc_[a-z]+|ref|ref_src|source|src|campaign)"
OFFICIAL_SUFFIX = r"(?i)(?:^|\.)(?:gov|gov\.in|nic\.in|mil|ac\.in|edu|edu\.in|ac\.uk|res\.in)$"
APPLY_PATH = r"(?i)/(?:careers?|jobs?|job-?de\w+|apply|application|openings?|vacanc\w*|positions?|recruit\w*|forms?|viewform|hcmui|candidate|search)(?:[/\-_.?=]|$)"
FORM_PATH = r"(?i)/forms?\b|/viewform|/pages/responsepage"
ARTICLE_SLUG = (
    r"(?i)/(?:[^/?#]+[-_])?(?:off[-_]?campus|walk[-_]?in|recruitment|recruiting|hiring|campus[-_]?drive|placement[-_]?drive|job[-_]?opening|mega[-_]?drive)(?:[-_][^/?#]*)?(?:/|$)"
)
INVISIBLE = "[​-‏‪-‮⁠-⁤⁦-⁩﻿￹-￼]"
HOPS = 5


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: Catalyst would otherwise copy the expression to each place that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each of which stands once in the plan: Catalyst copies a projected expression to every filter and column that uses it, but not
    what a generator gives, here a single row."""
    given = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], given)


def host_of(url: Column) -> Column:
    """UR2: small letters, without www. or dots at the end."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")


def under(host: Column, entries: list[str]) -> Column:
    """JN9: the host or one of its parents is an entry; a comparison with constants, so no join."""
    def parents(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))

    return F.arrays_overlap(let(F.split(host, r"\."), parents), F.array(*[F.lit(e) for e in entries]))


def unwrapped(url: Column) -> Column:
    """The link that a wrapper's query carries, by the first parameter that holds one."""
    values = F.array(*[F.trim(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(p)))) for p in WRAPPED_IN])
    return F.coalesce(F.get(F.filter(values, lambda v: v.rlike("(?i)^https?://")), F.lit(0)), url)


def normalize(raw: Column) -> Column:
    """UR1: https, host in small letters without www., no user, fragment or tracking parameters, no lone slash at the end; null for anything but http(s)."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), INVISIBLE, "")
    with_scheme = lambda t: F.when(t == "", None).when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), t).otherwise(F.concat(F.lit("https://"), t))
    return let(let(let(text, with_scheme), unwrapped), _rebuilt)


def _rebuilt(full: Column) -> Column:
    part = lambda name: F.try_parse_url(full, F.lit(name))
    scheme = F.lower(part("PROTOCOL"))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    shown_port = F.when((port != "") & (port != F.when(scheme == "http", "80").otherwise("443")), F.concat(F.lit(":"), port)).otherwise("")
    kept = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(f"^{TRACKING}$"))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/"))
    cut = F.when((path != "/") & (F.size(kept) == 0), F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.when(scheme.isin("http", "https") & (host_of(full) != ""), F.concat(F.lit("https://"), host_of(full), shown_port, cut, query))


def registered_label(host: Column) -> Column:
    """The label before the public suffix, two-part suffixes included."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    at = F.when(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".").isin(*TWO_PART_SUFFIXES), n - 2).otherwise(n - 1)
    return F.when((n >= 2) & (at >= 1), F.get(labels, at - 1))


def matches_company(host: Column, company: Column) -> Column:
    """UR4."""
    words = F.split(F.regexp_replace(F.lower(company), "&", " and "), "[^a-z0-9]+")
    tokens = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_COMPANY))

    def judge(x: Column) -> Column:
        label, many = x["label"], F.size(x["tokens"]) > 1
        hit = lambda t: (label == t) | label.startswith(F.concat(t, F.lit("-"))) | label.endswith(F.concat(F.lit("-"), t)) | (many & (F.regexp_replace(label, "-", "") == t))
        return F.exists(F.when(many, F.concat(x["tokens"], F.array(F.array_join(x["tokens"], "")))).otherwise(x["tokens"]), hit)

    return F.coalesce(let(F.struct(let(host, registered_label).alias("label"), tokens.alias("tokens")), judge), F.lit(False))


def career_host(host: Column) -> Column:
    """UR5."""
    return F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(x) for x in CAREER_LABELS]))


def suspicion(host: Column, path: Column) -> Column:
    """UR7: punycode, a telling part of the host, or an article's slug."""
    flat = F.regexp_replace(host, "[^a-z0-9]", "")
    parts = reduce(lambda a, b: a | b, [host.contains(p) | flat.contains(p.replace("-", "")) for p in SUSPICIOUS_PARTS])
    return host.rlike(r"(?:^|\.)xn--") | parts | path.rlike(ARTICLE_SLUG)


def verdict(raw: Column, company: Column, own: tuple[str, ...] = ("localhost",)) -> Column:
    """UR3: the first rule that applies decides."""
    def judge(x: Column) -> Column:
        host, path = x["host"], x["path"]
        return (
            F.when(host.isNull() | ~host.contains("."), "unresolvable")
            .when(under(host, list(own)) | under(host, AGGREGATORS), "aggregator")
            .when(under(host, WRAPPERS), "wrapper")
            .when(under(host, APPLICANT_SYSTEMS) | under(host, FORM_HOSTS), "direct")
            .when(under(host, FORM_PATH_HOSTS), F.when(path.rlike(FORM_PATH), "direct").otherwise("suspicious"))
            .when(under(host, JOB_BOARDS), "suspicious")
            .when(host.rlike(OFFICIAL_SUFFIX), "direct")
            .when(~suspicion(host, path) & (matches_company(host, company) | career_host(host) | path.rlike(APPLY_PATH)), "direct")
            .otherwise("suspicious")
        )

    parts = lambda url: F.struct(host_of(url).alias("host"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")).alias("path"))
    return let(let(normalize(raw), parts), judge)


def _texts(values: list[str] | tuple[str, ...]) -> str:
    """A list of texts in SQL."""
    return "array(" + ", ".join("r'" + v + "'" for v in values) + ")"


def _rules(own: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """UR3 in SQL over what ``judge`` works out: when a rule applies, the kind and the reason that it gives. The first that applies decides."""
    below = lambda entries: f"arrays_overlap(_parents, {_texts(entries)})"
    return [
        ("_link IS NULL", "unresolvable", "CASE WHEN coalesce(_text, '') = '' THEN 'no link' ELSE 'not a web link' END"),
        ("NOT contains(_host, '.')", "unresolvable", "'no public host'"),
        (below(own), "aggregator", "'own site'"),
        (below(AGGREGATORS), "aggregator", "concat('aggregator ', _host)"),
        (below(WRAPPERS), "wrapper", "concat('wrapper ', _host)"),
        ("_system", "direct", "concat(CASE WHEN _own THEN 'applicant system of the company ' ELSE 'applicant system ' END, _host)"),
        (f"{below(FORM_HOSTS)} OR {below(FORM_PATH_HOSTS)} AND _path RLIKE r'{FORM_PATH}'", "direct", "'form'"),
        (below(FORM_PATH_HOSTS), "suspicious", "concat('no form at ', _host)"),
        (below(JOB_BOARDS), "suspicious", "concat('job board ', _host)"),
        (f"_host RLIKE r'{OFFICIAL_SUFFIX}'", "direct", "'official domain'"),
        ("_odd IS NOT NULL", "suspicious", "_odd"),
        ("_own", "direct", "concat('host of the company ', _host)"),
        (f"arrays_overlap(_labels, {_texts(CAREER_LABELS)})", "direct", "concat('careers host ', _host)"),
        (f"_path RLIKE r'{APPLY_PATH}'", "direct", "'path of an application'"),
        ("true", "suspicious", "'no sign'"),
    ]


def _steps(own: tuple[str, ...]) -> dict[str, str]:
    """What ``judge`` works out, one after the other, in SQL over _raw and _company."""
    rules = _rules(own)
    part = lambda link, name: f"try_parse_url({link}, '{name}')"
    host = lambda link: rf"regexp_replace(regexp_replace(lower({part(link, 'HOST')}), r'\.+$', ''), r'^www\.', '')"
    suffix = f"array_join(slice(_labels, greatest(size(_labels) - 1, 1), 2), '.') IN ({', '.join(f'{chr(39)}{x}{chr(39)}' for x in TWO_PART_SUFFIXES)})"
    words = r"split(regexp_replace(lower(_company), '&', ' and '), '[^a-z0-9]+')"
    one = "_label = t OR startswith(_label, concat(t, '-')) OR endswith(_label, concat('-', t)) OR (size(_tokens) > 1 AND replace(_label, '-', '') = t)"
    telling = f"get(filter({_texts(SUSPICIOUS_PARTS)}, p -> contains(_host, p) OR contains(regexp_replace(_host, '[^a-z0-9]', ''), replace(p, '-', ''))), 0)"
    return {
        "_text": rf"regexp_replace(regexp_replace(_raw, r'^\s+|\s+$', ''), r'{INVISIBLE}', '')",
        "_given": r"CASE WHEN _text = '' THEN NULL WHEN _text RLIKE r'(?i)^[a-z][a-z0-9+.-]*:' THEN _text ELSE concat('https://', _text) END",
        "_full": f"coalesce(get(filter(transform({_texts(WRAPPED_IN)}, p -> trim(try_url_decode(try_parse_url(_given, 'QUERY', p)))), v -> v RLIKE r'(?i)^https?://'), 0), _given)",
        "_plain": ascii_link("_full"),
        "_scheme": f"lower({part('_plain', 'PROTOCOL')})",
        "_site": host("_plain"),
        "_port": rf"regexp_extract(coalesce({part('_plain', 'AUTHORITY')}, ''), r':(\d+)$', 1)",
        "_kept": rf"filter(split(coalesce({part('_plain', 'QUERY')}, ''), '&'), p -> p <> '' AND NOT regexp_extract(p, '^([^=]*)', 1) RLIKE r'^{TRACKING}$')",
        "_way": f"coalesce(nullif({part('_plain', 'PATH')}, ''), '/')",
        "_link": """CASE WHEN _scheme IN ('http', 'https') AND _site <> '' THEN concat('https://', _site,
            CASE WHEN _port <> '' AND _port <> CASE WHEN _scheme = 'http' THEN '80' ELSE '443' END THEN concat(':', _port) ELSE '' END,
            CASE WHEN _way <> '/' AND size(_kept) = 0 THEN regexp_replace(_way, '/$', '') ELSE _way END, CASE WHEN size(_kept) > 0 THEN concat('?', array_join(_kept, '&')) ELSE '' END) END""",
        "_host": host("_link"),
        "_path": f"coalesce({part('_link', 'PATH')}, '/')",
        "_labels": r"split(_host, r'\.')",
        "_parents": "CASE WHEN _host IS NOT NULL THEN transform(sequence(1, size(_labels)), k -> array_join(slice(_labels, k, size(_labels)), '.')) END",
        "_at": f"CASE WHEN {suffix} THEN size(_labels) - 2 ELSE size(_labels) - 1 END",
        "_label": "CASE WHEN size(_labels) >= 2 AND _at >= 1 THEN get(_labels, _at - 1) END",
        "_tokens": f"filter({words}, w -> length(w) >= 3 AND NOT array_contains({_texts(GENERIC_COMPANY)}, w))",
        "_own": f"coalesce(exists(CASE WHEN size(_tokens) > 1 THEN concat(_tokens, array(array_join(_tokens, ''))) ELSE _tokens END, t -> {one}), false)",
        "_system": f"coalesce(arrays_overlap(_parents, {_texts(APPLICANT_SYSTEMS)}), false)",
        "_odd": rf"CASE WHEN _host RLIKE r'(?:^|\.)xn--' THEN 'international host' WHEN {telling} IS NOT NULL THEN concat('host contains ', {telling}) WHEN _path RLIKE r'{ARTICLE_SLUG}' THEN 'path of an article' END",
        "_rule": "CASE " + " ".join(f"WHEN {when} THEN {k}" for k, (when, *_) in enumerate(rules)) + " END",
        "_kind": f"element_at({_texts([kind for _, kind, _ in rules])}, _rule + 1)",
        "_reason": "CASE _rule " + " ".join(f"WHEN {k} THEN {reason}" for k, (*_, reason) in enumerate(rules)) + " END",
    }


#: Steps that need nothing but what stands in an earlier line are worked out together.
_TOGETHER = ["_text", "_given", "_full", "_plain", "_scheme _site _port _kept _way", "_link", "_host _path", "_labels _tokens", "_parents _at _odd", "_label", "_own _system", "_rule", "_kind _reason"]


def judge(df: DataFrame, raw: Column, company: Column, name: str, own: tuple[str, ...] = ("localhost",)) -> DataFrame:
    """UR1-UR8 over a table: ``df`` with ``name``_link, _host, _path, _system, _company, _kind and _reason of a link. It gives what ``normalize`` and ``verdict`` give, for hosts of
    all alphabets, and why. Each step is what a generator gives (a single row), so it stands once in the plan, and filters and columns may use it as often as they like: Catalyst
    copies a projected expression to everything that uses it. All steps are one statement, so they are analysed once."""
    steps = _steps(own)
    views = [f"LATERAL VIEW inline(array(named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, {steps[c]}' for c in line.split())}))) v{k} AS {', '.join(line.split())}" for k, line in enumerate(_TOGETHER)]
    shown = {"link": "_link", "host": "_host", "path": "_path", "system": "_system", "company": "_own", "kind": "_kind", "reason": "_reason"}
    text = f"SELECT g.*, {', '.join(f'{c} AS {name}_{k}' for k, c in shown.items())} FROM given g {' '.join(views)}"
    text = re.sub(rf"\b(?:{'|'.join([*steps, '_raw', '_company'])})\b", lambda m: "_judge" + m[0], text)  # names that a table hardly has itself
    given = df.select("*", raw.alias("_judge_raw"), company.alias("_judge_company"))
    return df.sparkSession.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM given g", "FROM {given} g"), given=given).drop("_judge_raw", "_judge_company")


def resolved_fields(raw: Column, company: Column, source: Column | None = None) -> Column:
    """UR9: struct(apply_url, url_status, source_url, candidate) to store of a link. A direct one may be applied at; an aggregator's becomes the source; a wrapper or a
    suspicious link is a candidate for a reader, no more. The given source stays otherwise."""
    empty = F.coalesce(F.regexp_replace(raw, r"^\s+|\s+$", "") == "", F.lit(True))
    given = F.nullif(F.trim(F.lit(None).cast("string") if source is None else source), F.lit(""))

    def fields(x: Column) -> Column:
        direct, kind = x["kind"] == "direct", x["kind"]
        status = F.when(direct, "verified").when(empty, "pending").otherwise("needs_review")
        origin = F.when(kind == "aggregator", F.coalesce(x["url"], given)).otherwise(given)
        return F.struct(F.when(direct, x["url"]).alias("apply_url"), status.alias("url_status"), origin.alias("source_url"), F.when(kind.isin("wrapper", "suspicious"), x["url"]).alias("candidate"))

    return let(F.struct(verdict(raw, company).alias("kind"), normalize(raw).alias("url")), fields)


def public_link(apply_url: Column, verified: Column, company: Column) -> Column:
    """UR10: what a reader may follow: verified links, and others only if still judged direct."""
    return F.when(verified.eqNullSafe(True) | (verdict(apply_url, company) == "direct"), apply_url)


def confidence(score: Column) -> Column:
    """UR14."""
    return F.when(score >= 9, "highest").when(score >= 5, "high").when(score >= 4, "medium").when(score > 0, "low").otherwise("none")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """SET5, SRT9, UR15 over (post, url, score, pos): each normalised link once with its best score, in order, and whether the first may be
    taken: a high score and more than one point ahead of the next."""
    once = candidates.groupBy("post", normalize(F.col("url")).alias("link")).agg(F.max("score").alias("score"), F.min_by("url", F.struct(-F.col("score"), "pos")).alias("url"))
    order = Window.partitionBy("post").orderBy(F.desc("score"), "link")
    placed = once.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    sure = (F.col("place") == 1) & (F.col("score") >= 5) & (F.col("score") - F.coalesce("next", F.lit(0)) > 1)
    return placed.select("post", "place", "url", "score", confidence(F.col("score")).alias("confidence"), sure.alias("taken"))


def follow(links: DataFrame, redirects: DataFrame, hops: int = HOPS) -> DataFrame:
    """UR11, UR12 over (url) and known redirects (source, target): up to ``hops`` equi-joins; a link seen before ends the walk as a loop."""
    at = links.select("url", F.col("url").alias("final"), F.array("url").alias("path"), F.lit(None).cast("string").alias("outcome"))
    step = redirects.select(F.col("source").alias("final"), "target")
    for _ in range(hops):
        joined = at.join(step, "final", "left")
        loop, go = F.array_contains("path", F.col("target")), F.col("target").isNotNull() & F.col("outcome").isNull()
        at = joined.select(
            "url",
            F.when(go & ~loop, F.col("target")).otherwise(F.col("final")).alias("final"),
            F.when(go & ~loop, F.array_append("path", F.col("target"))).otherwise(F.col("path")).alias("path"),
            F.when(go & loop, "loop").otherwise(F.col("outcome")).alias("outcome"),
        )
    more = at.join(step.withColumnRenamed("target", "beyond"), "final", "left")
    return more.select("url", "final", (F.size("path") - 1).alias("hops"), F.coalesce("outcome", F.when(F.col("beyond").isNotNull(), "too many hops").otherwise("resolved")).alias("outcome"))


def shown_links(text: Column) -> Column:
    """UR24: links, bare www. hosts and addresses of a text with what they lead to."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)(?:https?://|www\.)[^\s<>"')\]]+|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"""), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("(?i)^https?://"), x).when(x.rlike(r"(?i)^www\."), F.concat(F.lit("https://"), x)).otherwise(F.concat(F.lit("mailto:"), x)))


def safe(url: Column) -> Column:
    """UR22: http or https, and parseable."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))
