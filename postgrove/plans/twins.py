"""DuckDB expressions for the twins of link queries: written over regular expressions and lists of DuckDB, apart from the functions they are compared with."""

from __future__ import annotations

from postgrove.functions import urls as U
from postgrove.sources.tables import literal

#: A link's parts: scheme, host, port, path, query.
_PARTS = r"^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"


def part(link: str, k: int) -> str:
    return f"regexp_extract({link}, '{_PARTS}', {k}, 'i')"


def host(link: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(lower({part(link, 2)}), '\.+$', ''), '^www\.', ''), '')"


def path(link: str) -> str:
    return f"coalesce(nullif({part(link, 4)}, ''), '/')"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(literal, values)) + "]"


def under(name: str, entries: list[str]) -> str:
    return rf"coalesce(regexp_matches({name}, '(^|\.)({'|'.join(e.replace('.', chr(92) + '.') for e in entries)})$'), false)"


def unwrapped(link: str) -> str:
    values = [f"CASE WHEN regexp_matches(url_decode(regexp_extract({part(link, 5)}, '(?:^|&){p}=([^&]*)', 1)), '^https?://', 'i') THEN trim(url_decode(regexp_extract({part(link, 5)}, '(?:^|&){p}=([^&]*)', 1))) END" for p in U.WRAPPED_IN]
    return f"coalesce({', '.join(values)}, {link})"


def matches_company(name: str, company: str) -> str:
    """Over columns, as the host is used several times."""
    labels = f"string_split({name}, '.')"
    at = f"CASE WHEN array_to_string({labels}[-2:], '.') IN ({', '.join(map(literal, U.TWO_PART_SUFFIXES))}) THEN len({labels}) - 2 ELSE len({labels}) - 1 END"
    label = f"CASE WHEN len({labels}) >= 2 AND ({at}) >= 1 THEN {labels}[{at}] END"
    words = f"[w FOR w IN string_split_regex(replace(lower({company}), '&', ' and '), '[^a-z0-9]+') IF len(w) >= 3 AND NOT list_contains({listed(U.GENERIC_COMPANY)}, w)]"
    one = lambda t: f"({label} = {t} OR starts_with({label}, {t} || '-') OR ends_with({label}, '-' || {t}) OR (len({words}) > 1 AND replace({label}, '-', '') = {t}))"
    return f"coalesce(len([t FOR t IN {words} IF {one('t')}]) > 0 OR (len({words}) > 1 AND {one(f'''array_to_string({words}, '')''')}), false)"


def judged(name: str, source: str, raw: str, company: str) -> str:
    """Common table expressions that end in ``name``: all of ``source`` and, named after it, the link in full, normalised, its host and path, and the verdict."""
    n = name
    odd = rf"(regexp_matches({n}_host, '(^|\.)xn--|{'|'.join(U.SUSPICIOUS_PARTS)}') OR regexp_matches(regexp_replace({n}_host, '[^a-z0-9]', '', 'g'), '{'|'.join(x.replace('-', '') for x in U.SUSPICIOUS_PARTS)}') OR regexp_matches({n}_path, '{U.ARTICLE_SLUG[4:]}', 'i'))"
    return rf"""{n}_a AS (SELECT *, regexp_replace({raw}, '^\s+|\s+$', '', 'g') AS {n}_t FROM {source}),
    {n}_b AS (SELECT *, CASE WHEN {n}_t = '' THEN NULL WHEN regexp_matches({n}_t, '^[a-z][a-z0-9+.-]*:', 'i') THEN {n}_t ELSE 'https://' || {n}_t END AS {n}_s FROM {n}_a),
    {n}_c AS (SELECT *, {unwrapped(f'{n}_s')} AS {n}_full FROM {n}_b),
    {n}_d AS (SELECT *, {host(f'{n}_full')} AS {n}_h, {path(f'{n}_full')} AS {n}_p, nullif({part(f'{n}_full', 3)}, '') AS {n}_port,
        [x FOR x IN string_split({part(f'{n}_full', 5)}, '&') IF x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^{U.TRACKING[4:]}$', 'i')] AS {n}_q FROM {n}_c),
    {n}_e AS (SELECT *, 'https://' || {n}_h || CASE WHEN {n}_port IS NOT NULL AND {n}_port <> '443' THEN ':' || {n}_port ELSE '' END
        || CASE WHEN {n}_p <> '/' AND len({n}_q) = 0 THEN regexp_replace({n}_p, '/$', '') ELSE {n}_p END || CASE WHEN len({n}_q) > 0 THEN '?' || array_to_string({n}_q, '&') ELSE '' END AS {n}_link FROM {n}_d),
    {n}_f AS (SELECT *, {host(f'{n}_link')} AS {n}_host, {path(f'{n}_link')} AS {n}_path FROM {n}_e),
    {n} AS (SELECT * EXCLUDE ({n}_t, {n}_s, {n}_h, {n}_p, {n}_port, {n}_q), CASE WHEN {n}_host IS NULL OR NOT contains({n}_host, '.') THEN 'unresolvable' WHEN {under(f'{n}_host', U.AGGREGATORS)} THEN 'aggregator' WHEN {under(f'{n}_host', U.WRAPPERS)} THEN 'wrapper'
        WHEN {under(f'{n}_host', U.APPLICANT_SYSTEMS + U.FORM_HOSTS)} THEN 'direct' WHEN {under(f'{n}_host', U.FORM_PATH_HOSTS)} THEN CASE WHEN regexp_matches({n}_path, '{U.FORM_PATH[4:]}', 'i') THEN 'direct' ELSE 'suspicious' END
        WHEN {under(f'{n}_host', U.JOB_BOARDS)} THEN 'suspicious' WHEN regexp_matches({n}_host, '{U.OFFICIAL_SUFFIX[4:]}', 'i') THEN 'direct'
        WHEN NOT {odd} AND ({matches_company(f'{n}_host', company)} OR len(list_intersect(string_split({n}_host, '.'), {listed(U.CAREER_LABELS)})) > 0 OR regexp_matches({n}_path, '{U.APPLY_PATH[4:]}', 'i')) THEN 'direct' ELSE 'suspicious' END AS {n}_kind FROM {n}_f)"""
