"""Company names (SC17, SC18): the comparable form of a name, whether it names an employer at all, and where its site may be."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from postgrove.functions.text import ascii_bounds
from postgrove.functions.urls import let

# Asides, what posts add to a name, legal forms, and names that are none.
ASIDE = r"[(\[{][^)\]}]*[)\]}]"
ADDED = r"\b(?:off[\s-]?campus|on[\s-]?campus|drive|driving|hiring|recruitment|recruiting|careers?|jobs?|internships?|opening|openings|vacancy|vacancies|walk[\s-]?in|batch|freshers?|20\d\d)\b"
LEGAL = r"\b(?:private|pvt|pvt\.|limited|ltd|inc|incorporated|llc|llp|plc|gmbh|ag|sa|bv|corp|corporation|co)\b"
NO_NAME = (
    r"^(?:confidential|undisclosed|unknown|n\s*a|none|null|nil|tbd|various|multiple|several|mnc|mncs|startup|start[\s-]?up|company|companies|client|clients|employer|organisation|organization|org|firm|hiring"
    r"|recruiter|recruitment|consultancy|consultant|top\s+(?:mnc|companies|product)|(?:product|service)[\s-]based(?:\s+company)?|not\s+(?:specified|mentioned|disclosed|available)|multiple\s+companies|leading\s+\w+)$"
)
DOMAIN = r"^[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+$"
SHORTEST, LONGEST = 2, 40
# Companies whose site is not called after them.
KNOWN = {
    "hpe": "hpe.com", "hewlettpackardenterprise": "hpe.com", "deutschebank": "db.com", "larsenandtoubro": "larsentoubro.com", "larsentoubro": "larsentoubro.com", "landt": "larsentoubro.com",
    "indigo": "goindigo.in", "goindigo": "goindigo.in", "indiapost": "indiapost.gov.in", "isro": "isro.gov.in", "upsc": "upsc.gov.in", "sbi": "sbi.co.in", "statebankofindia": "sbi.co.in",
    "tcs": "tcs.com", "tataconsultancyservices": "tcs.com", "micron": "micron.com", "microntechnology": "micron.com", "fujitsu": "global.fujitsu", "zeta": "zeta.tech", "weekday": "weekday.works",
    "weekdayworks": "weekday.works", "yash": "yash.com", "yashtechnologies": "yash.com", "iocl": "iocl.com", "indianoil": "iocl.com", "johnsonandjohnson": "jnj.com",
}
# The steps from a name in small letters to its comparable form, in order.
STEPS = [(ASIDE, " "), ("&", " and "), (ADDED, " "), (r"[^a-z0-9.\s-]", " "), (LEGAL, " "), (r"[\s-]+", " "), (r"\s*\.\s*", "."), (r"^\.+|\.+$", "")]


def normalized_name(company: Column) -> Column:
    """SC17: the comparable words of a name; empty for none."""
    low = F.lower(F.coalesce(company, F.lit("")))
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, ascii_bounds(step[0]), step[1]), STEPS, low))


def name_key(company: Column) -> Column:
    """SC17: one key for a name in any spelling of its spaces and case."""
    return F.regexp_replace(normalized_name(company), r"\s+", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def names_employer(company: Column) -> Column:
    """SC17: a name worth looking up."""
    def judge(name: Column) -> Column:
        bare = F.regexp_replace(name, r"[\s.]", "")
        return ~name.rlike(NO_NAME) & F.length(bare).between(SHORTEST, LONGEST) & bare.rlike("[a-z]")

    return let(normalized_name(company), judge)


def domains(company: Column) -> Column:
    """SC17: hosts to try, best first: the known one; the name if it is a host itself; the whole name under three suffixes. Never a part of a name."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    none = F.array().cast("array<string>")

    def guesses(name: Column) -> Column:
        bare = F.regexp_replace(name, r"[\s.]", "")
        given = F.element_at(known, F.regexp_replace(name, r"\s+", ""))
        guessed = F.array(*[F.concat(bare, F.lit(suffix)) for suffix in (".com", ".in", ".co.in")])
        return F.when(given.isNotNull(), F.array(given)).when(~name.contains(" ") & name.rlike(DOMAIN), F.array(F.regexp_replace(name, r"^www\.", ""))).otherwise(guessed)

    return F.when(names_employer(company), let(normalized_name(company), guesses)).otherwise(none)


def known_domain(company: Column) -> Column:
    return name_key(company).isin(*KNOWN)


def domain_matches(company: Column, domain: Column, reachable: Column, parked: Column, site_name: Column, final_host: Column) -> Column:
    """SC18: a site that answers, is not parked, and says the company's name, by its own name or by the other host that it leads to."""
    def judge(x: Column) -> Column:
        said = lambda t: (t != "") & (t.contains(x["name"]) | x["name"].contains(t))
        moved = (x["landed"] != x["guessed"]) & said(x["landed"])
        return (F.length(x["name"]) >= SHORTEST) & (said(x["site"]) | moved)

    empty = lambda c: compact(F.coalesce(c, F.lit("")))
    parts = F.struct(compact(normalized_name(company)).alias("name"), empty(site_name).alias("site"), empty(final_host).alias("landed"), empty(domain).alias("guessed"))
    return F.coalesce(reachable, F.lit(False)) & ~F.coalesce(parked, F.lit(False)) & let(parts, judge)
