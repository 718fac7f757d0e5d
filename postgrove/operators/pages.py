"""Links of an article page (UR13, UR18): anchors with their labels, scored as places to apply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from postgrove.functions import urls as U
from postgrove.functions.text import ascii_bounds

# Hosts that are never a place to apply: advertising, what every page's theme links to, and social pages.
AD_HOSTS = [
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "googletagmanager.com", "google-analytics.com", "amazon-adsystem.com", "adnxs.com", "adsterra.com", "taboola.com",
    "outbrain.com", "mgid.com", "revcontent.com", "media.net", "popads.net", "propellerads.com", "onesignal.com",
]
THEME_HOSTS = [
    "wordpress.org", "wordpress.com", "w.org", "s.w.org", "schema.org", "gravatar.com", "automattic.com", "jetpack.com", "gstatic.com", "googleapis.com", "cloudflare.com", "play.google.com",
    "apps.apple.com",
]
SOCIAL_HOSTS = [
    "instagram.com", "facebook.com", "fb.com", "youtube.com", "youtu.be", "twitter.com", "x.com", "threads.net", "discord.gg", "discord.com", "reddit.com", "pinterest.com", "t.me",
    "telegram.me", "wa.me", "whatsapp.com", "chat.whatsapp.com",
]
# Paths that share a page, labels that name an application strongly or weakly or another posting, paths of applications and of front doors.
SHARE_PATH = r"(?i)/(?:sharer?(?:\.php)?|share(?:article|-offsite)?|intent/tweet|pin/create|submit)(?:[/?]|$)"
STRONG = r"(?i)\bapply\s*(?:now|here|link|online)?\b|\bapplication\s*(?:link|form|portal)\b|\bclick\s+here\s+to\s+(?:apply|register)\b|\bregistration\s+link\b"
WEAK = r"(?i)\bregist\w*\b|\benroll\w*\b|\bofficial\s+(?:website|site|notification|link|page)\b|\bcareers?\b|\b(?:job|direct)\s+link\b|\bvacanc\w*\b"
UNRELATED = (
    r"(?i)\b(?:also|other|similar|related|more|latest|recommended|previous|next)\s+(?:apply|jobs?|openings?|vacanc\w*|posts?)\b|\bapply\s+(?:for|to)\s+(?:other|another|similar|related)\b"
)
PAGE_APPLY_PATH = r"(?i)/(?:careers?|jobs?|job-?de\w+|apply|application|openings?|vacanc\w*|positions?|recruit\w*|forms?|viewform|hcmui|candidate)(?:[/\-_.?=]|$)"
FRONT_DOOR = r"(?i)^/?$|^/(?:index|home)\.[a-z]+$"
# What the parts of a score weigh.
POINTS = {"system": 5, "company": 4, "path": 3, "form": 2, "strong": 2, "weak": 1}
# Entities in links and labels.
ENTITIES = [(r"&(?:amp|#0*38|#[xX]0*26);", "&"), (r"&(?:quot|#0*34);", '"'), (r"&(?:apos|#0*39);", "'"), (r"&(?:lt|#0*60);", "<"), (r"&(?:gt|#0*62);", ">"), (r"&(?:nbsp|#0*160);", " ")]

ARTICLE = r"(?is)<article\b[^>]*>(.*?)</article\s*>"
ENTRY = r"""(?is)<div\b[^>]*class\s*=\s*["'][^"']*(?:entry-content|post-content|article-content|td-post-content|single-content)[^"']*["'][^>]*>(.*)"""
NO_CONTENT = (r"(?s)<!--.*?-->", r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>")
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
BODY_OVER = 200


def decoded(c: Column) -> Column:
    return reduce(lambda x, step: F.regexp_replace(x, *step), ENTITIES, c)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, however it is quoted; null if there is none."""
    quoted = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, quoted, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(quoted), decoded(F.trim(value)))


def body(html: Column) -> Column:
    """The article if the page marks one of more than BODY_OVER characters, else all behind the start of an entry of that size, else the whole page; without scripts and comments."""
    article, entry = F.regexp_extract(html, ARTICLE, 1), F.regexp_extract(html, ENTRY, 1)
    found = F.when(F.length(article) > BODY_OVER, article).when(F.length(entry) > BODY_OVER, entry).otherwise(html)
    return reduce(lambda c, p: F.regexp_replace(c, p, " "), NO_CONTENT, found)


def anchors(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with (pos, href, rel, label) of every anchor in the article, in order."""
    text = F.get(F.transform(F.array(body(F.col("html"))), lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all(b, F.lit(ANCHOR), F.lit(2)).alias("inner"))), F.lit(0))
    others = [c for c in pages.columns if c != "html"]
    each = pages.select(*others, F.posexplode(text).alias("pos", "a"))
    label = F.regexp_replace(decoded(F.regexp_replace("a.inner", r"(?s)<[^>]*>", " ")), r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", " ")
    return each.select(*others, "pos", attribute(F.col("a.tag"), "href").alias("href"), attribute(F.col("a.tag"), "rel").alias("rel"), F.trim(F.regexp_replace(label, r"\s+", " ")).alias("label"))


def absolute(href: Column, page: Column) -> Column:
    """A link as seen from its page; mail, script and fragment links are null."""
    root = F.regexp_extract(page, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?i)^(https?://[^/]+(?:/.*)?)/[^/]*$", "$1")
    return (
        F.when(href.rlike(r"(?i)^(?:mailto|tel|javascript|data):|^#|^$"), None)
        .when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def path_of(link: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(link, F.lit("PATH")), F.lit("")), F.lit("/"))


def candidates(pages: DataFrame, company: Column) -> DataFrame:
    """UR13 over (page_id, url, html): the links of an article that may be applied at, each once with its best score. A link needs a sign of a
    destination (applicant system, the company's host, a path, a form); a label only adds to it. ``company`` may be a column of ``pages``."""
    found = U.worked_out(anchors(pages.withColumn("_of", company)), _target=absolute(F.col("href"), F.col("url")), _site=U.host_of(F.col("url")))
    found = U.judge(found, F.col("_target"), F.col("_of"), "_j").where(F.col("_j_link").isNotNull() & F.col("_site").isNotNull() & ~F.coalesce(U.under(U.host_of(F.col("_target")), AD_HOSTS), F.lit(False)))
    host, path, label, kind = F.col("_j_host"), F.col("_j_path"), F.col("label"), F.col("_j_kind")
    own = (host == F.col("_site")) | host.endswith(F.concat(F.lit("."), F.col("_site")))
    barred = (
        ~host.contains(".") | own | U.under(host, AD_HOSTS + THEME_HOSTS + SOCIAL_HOSTS) | path.rlike(SHARE_PATH) | F.coalesce(F.col("rel").rlike(ascii_bounds(r"(?i)\bsponsored\b")), F.lit(False))
        | label.rlike(ascii_bounds(UNRELATED)) | (kind == "aggregator")
    )
    flag = lambda when, name: F.when(when, POINTS[name]).otherwise(0)
    destination = (
        flag((kind == "direct") & F.col("_j_system"), "system") + flag(F.col("_j_company"), "company") + flag(path.rlike(PAGE_APPLY_PATH), "path")
        + flag((kind == "direct") & U.under(host, U.FORM_HOSTS + U.FORM_PATH_HOSTS), "form")
    )
    strength = F.when(label.rlike(ascii_bounds(STRONG)), POINTS["strong"]).when(label.rlike(ascii_bounds(WEAK)), POINTS["weak"]).otherwise(0)
    led = U.worked_out(found, link=F.col("_j_link"), _barred=barred, _to=destination, _said=strength, _door=path.rlike(FRONT_DOOR)).where(~F.col("_barred") & (F.col("_to") > 0) & ~(F.col("_door") & (F.col("_to") <= POINTS["path"])))
    first = Window.partitionBy("page_id", "link").orderBy(F.desc("score"), "pos")
    once = led.withColumn("score", F.col("_to") + F.col("_said")).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return once.select("page_id", "pos", "link", F.nullif(F.substring("label", 1, 120), F.lit("")).alias("label"), "score", U.confidence(F.col("score")).alias("confidence"))
