"""Text functions (SC1-SC27) as column expressions; white space and letters are ASCII unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# What marks a post as a job post, as word or stem patterns.
JOB_SIGNALS = (
    r"hiring|hire[sd]?|recruit\w*|vacanc(?:y|ies)|opening[s]?|opportunit(?:y|ies)|job[s]?|work\s*from\s*home|\bwfh\b|walk[\s-]*in|placement|off[\s-]*campus|on[\s-]*campus|campus\s*drive|drive"
    r"|career[s]?|employment|apply|application[s]?|registration|register|referral|intern(?:ship)?[s]?|fresher[s]?|graduate[s]?|trainee|apprentice(?:ship)?|engineer(?:ing)?|developer|analyst"
    r"|scientist|designer|consultant|architect|programmer|tester|associate|executive|specialist|technician|manager|\bsde\d?\b|\bswe\d?\b|\bsdet\b|\bqa\b|devops|full\s*stack|frontend|backend"
    r"|batch|eligibilit(?:y|ies)|eligible|stipend|salary|\bctc\b|\blpa\b|experience\s*:|last\s*date|deadline|data\s*science|machine\s*learning|artificial\s*intelligence|ml\s*engineer"
    r"|data\s*engineer|data\s*analyst|product\s*manager|ui\s*/\s*ux|cyber\s*security|network\s*engineer|system\s*admin|cloud|java|python|react|node|angular|sql|\bb\.?tech\b|\bm\.?tech\b"
    r"|\bb\.?e\b|\bb\.?sc\b|\bmca\b|\bbca\b|\bmba\b|notification|requirement[s]?|qualification[s]?|joining|selection|shortlist|interview|aptitude|package|urgent|immediate|walk\s*-?\s*in"
    r"|hiring\s*alert|job\s*alert|experience[d]?"
)
# Greetings and promotion.
NOISE = (
    r"\bjoin\b|\bsubscribe\b|\bfollow\b|\bshare\b|\bdm\b|\bcollab\w*|\bpromot\w*|\badvertis\w*|good\s*(?:morning|evening|night)|t\.me\/|telegram\.me\/|telegram\.dog\/|whats\s*app"
)
# What makes a field value promotion.
PROMOTIONAL_VALUES = (
    r"^@[\w]+$",
    r"(?i)(?:^|\/\/|\s)(?:www\.)?(?:t\.me|telegram\.me|telegram\.dog)\/",
    r"(?i)\b(?:whats\s*app|whatsapp|wa\.me|chat\.whatsapp\.com)\b",
    r"(?i)\b(?:collabs?|collaborations?|promotions?|promote|advertis\w*|sponsor\w*)\b",
    r"(?i)\bjoin\s+(?:now|us|our|the|this)\b",
    r"(?i)\bsubscribe\b",
    r"(?i)^(?:dm|dm\s+.*)$",
    r"(?i)\bmessage\s+(?:here|me|us)\b",
)
URL = r"""(?i)https?://[^\s<>"')\]]+"""
LEAST_USEFUL = 15
EMPLOYMENT_TYPES = ("internship", "full-time", "part-time", "contract", "apprenticeship", "training")


def ascii_bounds(pattern: str) -> str:
    """Word borders by ASCII letters, digits and _ only, whatever the Java version holds a letter to be."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    parts, depth, begin = [], 0, 0
    for k, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(pattern[begin:k])
            begin = k + 1
    return [*parts, pattern[begin:]]


def plain_words(pattern: str) -> tuple[list[str], str]:
    """The alternatives that come down to a plain text which a place must hold, what may follow it being optional, and the other alternatives as one pattern. An alternative that holds one of these texts
    in any case is left out."""
    cut = r"(?:\[[a-z]+\]\?|\(\?:[^()|]*(?:\|[^()|]*)*\)\?|\\w\*)$"
    bare = []
    for part in alternatives(pattern):
        while (shorter := re.sub(cut, "", part)) != part:
            part = shorter
        bare.append(part)
    words = sorted({p for p in bare if re.fullmatch("[a-z]+", p)})
    words = [w for w in words if not any(o != w and o in w for o in words)]
    return words, "|".join(p for p in bare if not any(w in p for w in words))


def by_first_letter(pattern: str) -> str:
    """The same alternatives under their first letters, with or without a word border before: a place in a text is then tried for a few letters instead of every alternative."""
    groups: dict[str, list[str]] = {}
    for part in alternatives(pattern):
        border = r"\b" if part.startswith(r"\b") else ""
        letter, rest = part[len(border) : len(border) + 1], part[len(border) + 1 :]
        plain = letter.isalpha() and rest[:1] not in ("?", "*", "+", "{")
        groups.setdefault(border + letter if plain else part, []).append(rest if plain else "")
    return "|".join(head + (f"(?:{'|'.join(rests)})" if any(rests) else "") for head, rests in groups.items())


def by_border(pattern: str) -> str:
    """The same alternatives for texts in small letters: those that begin a word stand together behind one look back, so that places inside words are left at once."""
    parts = alternatives(pattern)
    begins = [p[2:] for p in parts if re.match(r"\\b[a-z]", p)]
    others = [p for p in parts if not re.match(r"\\b[a-z]", p)]
    found = [f"(?<![A-Za-z0-9_])(?:{by_first_letter('|'.join(begins))})"] if begins else []
    return ascii_bounds("|".join(found + ([by_first_letter("|".join(others))] if others else [])))


def prefix_tree(words: list[str]) -> str:
    """One pattern for all words, which share their beginnings."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        if "" in node:  # what is longer holds the shorter word
            return ""
        parts = [re.escape(c) + written(below) for c, below in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return written(tree)


def says(text: Column, pattern: str) -> Column:
    """The pattern stands in ``text``, in any case: one pass for all plain texts, one for what else is left. Letters beyond ASCII are no capitals of others."""
    words, rest = plain_words(pattern)
    low = F.lower(F.regexp_replace(text, "[\u0130\u212a]", "\u0001"))
    hits = lambda x: [x.rlike(p) for p in (prefix_tree(words) if words else "", by_border(rest) if rest else "") if p]
    return F.get(F.transform(F.array(low), lambda x: reduce(lambda a, b: a | b, hits(x))), F.lit(0))


def trimmed(c: Column) -> Column:
    """White space of all kinds cut at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Letters whose capital is one letter, though Java writes it as two: ß, and Greek ones with an iota below.
ONE_CAPITAL = {"ß": "ẞ"} | {x: x.title() for x in map(chr, range(0x1F80, 0x1FFD)) if len(x.upper()) > 1 and len(x.title()) == 1}


def capitals(c: Column) -> Column:
    """Capitals letter by letter, as SQL has them: a letter gives one letter, and what has no capital of its own stays (``upper`` makes SS of ß and FI of ﬁ)."""
    one = F.create_map(*[F.lit(x) for pair in ONE_CAPITAL.items() for x in pair])
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(one, x), F.when(F.length(F.upper(x)) == 1, F.upper(x)), x)), "")


def any_match(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(ascii_bounds(p)) for p in patterns])


def prefilter(text: Column) -> Column:
    """SC4: ``send``, or the reason not to: a job signal wins over everything else."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "no text")
        .when(says(t, JOB_SIGNALS), "send")
        .when(F.length(t) < LEAST_USEFUL, "too short, no job signal")
        .when(says(t, NOISE), "promotion/greeting only")
        .otherwise("no job signal")
    )


def urls(text: Column) -> Column:
    """SC3."""
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def squeezed(c: Column) -> Column:
    """SC5: small letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def grounded(value: Column, text: Column) -> Column:
    """SC5: the value stands in the text, whatever stands between its letters."""
    needle = squeezed(value)
    return (needle != "") & squeezed(text).contains(needle)


def promotional(value: Column) -> Column:
    """SC6."""
    return any_match(value, PROMOTIONAL_VALUES)


def accepted_field(value: Column, text: Column, most: int) -> Column:
    """SC7: a field that a reader of the post gave, if it is short, means something, holds no link or promotion and is grounded."""
    v = trimmed(value)
    absent = F.lower(v).isin("", "n/a", "na", "none", "null", "not specified", "not mentioned", "unknown", "-")
    good = ~absent & (F.length(v) <= most) & ~promotional(v) & ~v.rlike(r"(?i)https?:\/\/|www\.\w|\bt\.me\/|\blnkd\.in\/") & grounded(v, text)
    return F.when(good, v)


def accepted_type(value: Column) -> Column:
    """SC9."""
    v = F.lower(trimmed(value))
    return F.when(v.isin(*EMPLOYMENT_TYPES), v)


def normalized(c: Column) -> Column:
    """SC13: small letters, digits, + and #, with one space between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9+#]+", " "))


def contains_term(haystack: Column, term: Column) -> Column:
    """SC13: a whole term; an empty one is in nothing."""
    needle = normalized(term)
    return (needle != "") & F.concat(F.lit(" "), normalized(haystack), F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def clean_cell(c: Column) -> Column:
    """SC19: a table cell without images, tags, link targets and ornaments."""
    for pattern, into in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[\u2000-\u206f\u2700-\u27bf\ufe00-\ufe0f]", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, into)
    return F.trim(c)


def missing_cell(c: Column) -> Column:
    """SC19: empty, "n/a" and the like, or anything with a long dash."""
    return F.coalesce((c == "") | c.rlike(r"(?i)^[-n/a]+$") | c.rlike(r"[\u2013\u2014]"), F.lit(True))


def posted_date(c: Column) -> Column:
    """SC19: 2026-09-05, 2026/9/5, "5 Sep 2026" or "Sep 5, 2026"; dates that do not exist are null."""
    t = trimmed(c)
    iso = F.regexp_extract(t, r"^(\d{4})[-/]([01]?\d)[-/]([0-3]?\d)(?:[T\s].*)?$", 0) != ""
    parts = [F.regexp_extract(t, r"^(\d{4})[-/]([01]?\d)[-/]([0-3]?\d)", k) for k in (1, 2, 3)]
    padded = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    spoken = F.regexp_replace(F.initcap(t), ",", "")
    tries = [F.try_to_timestamp(spoken, F.lit(f)) for f in ("d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")]
    return F.when(missing_cell(t), None).when(iso, F.try_to_timestamp(padded, F.lit("yyyy-MM-dd"))).otherwise(F.coalesce(*tries)).cast("date")


def source_id(url: Column, company: Column, role: Column) -> Column:
    """SC20: the identity of an imported row."""
    flat = lambda c: F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")
    return F.concat(F.lit("github:"), F.substring(F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), flat(company), flat(role)), 256), 1, 40))


def numeric_id(source_id_: Column) -> Column:
    """SC20: a positive number from the identity."""
    value = F.conv(F.substring(F.sha2(source_id_, 256), 1, 8), 16, 10).cast("long") % 2_000_000_000
    return F.when(value == 0, 1).otherwise(value)


def tidy(c: Column) -> Column:
    """SC24: line ends made equal, format characters gone, runs of spaces and blank lines cut."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\p{Cf}", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def list_clean(c: Column, most: int) -> Column:
    """SET7: trimmed, not empty, each once in any case with its first spelling, the first ``most``."""
    t = F.filter(F.transform(c, trimmed), lambda x: x != "")
    once = F.filter(t, lambda x, i: F.array_position(F.transform(t, F.lower), F.lower(x)) == i + 1)
    return F.slice(once, 1, most)


def token_hash(c: Column) -> Column:
    """SC27."""
    return F.sha2(c, 256)


def shown_type(kind: Column, role: Column) -> Column:
    """SC22: the given type, else guessed from the title."""
    return F.coalesce(F.when(F.trim(kind) != "", F.trim(kind)), F.when(role.rlike("(?i)intern"), "Internship"), F.lit("Full-time"))


def monogram(c: Column) -> Column:
    """SC22: initials of the first two words."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def safe_file_name(c: Column) -> Column:
    """SC25: the name of a PDF file without its folders, of plain characters, at most 120; null for any other."""
    base = trimmed(F.element_at(F.split(c, r"[/\\\\]", -1), -1))
    return F.when((F.length(base) <= 120) & base.rlike(r"(?i)^[A-Za-z0-9_ .()-]+\.pdf$"), base)


def search_query(company: Column, role: Column, location: Column, batch: Column) -> Column:
    """SC25: what to ask a web search for a posting's own page; null without a company."""
    given = lambda c: F.nullif(c, F.lit(""))
    quoted = lambda c: F.concat(F.lit('"'), given(c), F.lit('"'))
    return F.when(given(company).isNotNull(), F.concat_ws(" ", quoted(company), quoted(role), given(location), given(batch), F.lit("careers apply official")))


def site_terms(role: Column, filler: list[str]) -> Column:
    """SC25: up to four words of a role worth looking for in a site map; null if none is."""
    words = F.filter(F.split(F.lower(role), "[^a-z0-9+#]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*filler))
    return F.nullif(F.array_join(F.slice(words, 1, 4), " "), F.lit(""))
