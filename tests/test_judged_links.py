"""Links judged over a table: as the column functions judge them, with reasons, and hosts of all alphabets."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from postgrove.functions import idna, urls as U
from postgrove.plans.link_queries import _CASES

REASONS = {
    1: "no link", 2: "no public host", 3: "aggregator freshershunt.in", 4: "aggregator blog.freshershunt.in", 5: "wrapper bit.ly", 6: "applicant system acme.wd1.myworkdayjobs.com", 7: "form", 8: "form", 9: "no form at docs.google.com",
    10: "job board linkedin.com", 11: "official domain", 12: "host of the company acme.com", 13: "no sign", 14: "careers host careers.bolt.com", 15: "path of an application", 16: "host contains fresher", 17: "path of an article",
    18: "international host", 19: "host of the company tata-elxsi.com", 20: "host contains offcampus",
}


def judged(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame(rows, "id int, raw string, company string")
    return {r["id"]: r for r in U.judge(df, F.col("raw"), F.col("company"), "j").collect()}


def test_every_rule_has_its_reason(spark):
    got = judged(spark, [c[:3] for c in _CASES])
    assert {i: r["j_kind"] for i, r in got.items()} == {i: v for i, _, _, v in _CASES}
    assert {i: r["j_reason"] for i, r in got.items()} == REASONS
    more = judged(spark, [(1, "mailto:a@b.example", None), (2, "http://localhost.localdomain/", None), (3, "https://x.localhost/apply", None), (4, "https://greenhouse.io/x", "Greenhouse Inc"), (5, " ", None)])
    assert [more[k]["j_reason"] for k in range(1, 6)] == ["not a web link", "no sign", "own site", "applicant system of the company greenhouse.io", "no link"]


def test_judged_links_equal_the_column_functions(spark):
    draw = random.Random(4)
    hosts = ["acme.com", "WWW.Acme.co.in", "careers.bolt.com", "bit.ly", "docs.google.com", "intranet", "x.gov.in", "linkedin.com.", "off-campus.example.com", "me:pw@acme.com:8443", "acme.com:80", "", "a b", "[::1]"]
    paths = ["", "/", "/jobs/", "/apply?id=1&utm_source=x", "/x/?url=https%3A%2F%2Fforms.gle%2Fa", "/tcs-off-campus-drive/", "/forms/d#top", "/a?b=%zz", "?q=http://t.co/x", "/​p"]
    rows = [(k, draw.choice(["https://", "http://", "", "HTTP://", "ftp://", "  https://"]) + draw.choice(hosts) + draw.choice(paths), draw.choice([None, "", "Acme & Sons", "Bolt Labs Pvt Ltd"])) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, raw string, company string")
    both = U.judge(df, F.col("raw"), F.col("company"), "j").select("*", U.normalize(F.col("raw")).alias("link"), U.verdict(F.col("raw"), F.col("company")).alias("kind"))
    assert [(r["raw"], r["j_link"], r["j_kind"]) for r in both.collect()] == [(r["raw"], r["link"], r["kind"]) for r in both.collect()]


def test_a_link_is_judged_once_in_the_plan(spark):
    df = spark.createDataFrame([(1, "https://acme.com/x", "Acme")], "id int, raw string, company string")
    used = U.judge(df, F.col("raw"), F.col("company"), "j").where("j_kind = 'direct' AND j_link LIKE '%acme%'").select("j_kind", "j_reason", F.concat("j_kind", "j_host"))
    assert used._jdf.queryExecution().optimizedPlan().toString().count("shorturl.at") == 1


def test_hosts_of_other_alphabets(spark):
    draw = random.Random(2)
    hosts = ["münchen", "bücher", "faß", "日本語", "a日b本c", "пример", "ü" * 20, "\U0001f600x", "abcdefghijklmnopqrstuvwxyzé", "Ünï", "ελ" * 15, "plain"] + ["".join(draw.choice("abcä漢éñ\U0001f600я1-") for _ in range(draw.randint(1, 30))) for _ in range(200)]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", F.expr(idna.ascii_host("h")).alias("a")).collect()
    assert all(r["a"] == (r["h"] if r["h"].isascii() else "xn--" + r["h"].lower().encode("punycode").decode()) for r in got)
    links = judged(spark, [(1, "https://münchen.example/apply?id=1", None), (2, "https://xn--mnchen-3ya.example/apply?id=1", None), (3, "http://me@www.Пример。рф:81/ä", "x"), (4, "https://go.example/?url=https%3A%2F%2Fb%C3%BCcher.example%2F", None)])
    assert links[1]["j_link"] == links[2]["j_link"] == "https://xn--mnchen-3ya.example/apply?id=1" and links[1]["j_kind"] == links[2]["j_kind"] == "suspicious" and links[1]["j_reason"] == "international host"
    assert links[3]["j_link"] == "https://xn--e1afmkfd.xn--p1ai:81/ä" and links[4]["j_link"] == "https://xn--bcher-kva.example/"
