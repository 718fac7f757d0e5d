"""Link decisions at their borders, on rows made for each rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postgrove.functions import details, posts as P
from postgrove.operators import evidence as E, pages as A

WORDS = "<p>" + "words about the posting " * 12 + "</p>"
NEWS = "https://freshershunt.in/acme-drive"


def candidates(spark, body, company="Acme", url=NEWS):
    page = spark.createDataFrame([(1, url, f"<html><nav><a href='https://forms.gle/nav'>Apply</a></nav><article>{WORDS}{body}</article></html>")], "page_id long, url string, html string")
    return {r["link"]: r["score"] for r in A.candidates(page, F.lit(company)).collect()}


@pytest.mark.parametrize(
    "body,want",
    [
        ("<a href='https://jobs.lever.co/acme/1'>Apply Now</a>", {"https://jobs.lever.co/acme/1": 10}),  # system, path names nothing; the host is the system's
        ("<a href='https://t.me/acme'>Apply Now</a><a href='https://youtube.com/jobs'>Apply</a>", {}),
        ("<a href='https://course.example.org/'>Apply Now</a>", {}),  # a label alone is no destination
        ("<a href='https://acme.com/'>Official site</a>", {"https://acme.com/": 5}),
        ("<a href='https://other.org/'>Careers</a>", {}),
        ("<a rel='sponsored' href='https://acme.com/jobs/1'>Apply</a>", {}),
        ("<a href='https://acme.com/jobs/1'>other jobs</a>", {}),
        ("<a href='/jobs/1'>Apply</a><a href='https://sub.freshershunt.in/jobs/1'>Apply</a>", {}),
        ("<a href='https://ad.doubleclick.net/x?url=https%3A%2F%2Facme.com%2Fjobs'>Apply</a>", {}),
        ("<script><a href='https://acme.com/jobs/9'>Apply</a></script><!-- <a href='https://acme.com/jobs/8'>Apply</a> -->", {}),
        ("<a href='https://acme.com/jobs/1'>x</a><a href='https://www.acme.com/jobs/1/?utm_source=a'>Apply here</a>", {"https://acme.com/jobs/1": 9}),
    ],
)
def test_candidates(spark, body, want):
    got = candidates(spark, body)
    if body.startswith("<a href='https://jobs.lever.co"):
        assert list(got) == list(want) and got["https://jobs.lever.co/acme/1"] >= 7
    else:
        assert got == want


def test_a_candidate_of_a_page_without_a_host_or_text(spark):
    assert candidates(spark, "", url=None) == {} and candidates(spark, "<a>no link</a><a href=''>none</a><a href='mailto:a@b.example'>Apply</a>") == {}


def evidence(spark, **row):
    full = {"id": 1, "url": "https://careers.acme.com/jobs/1", "html": None, "company": "Acme", "role": "Backend Engineer", "location": "Pune"} | row
    return E.page_evidence(spark.createDataFrame([full], "id int, url string, html string, company string, role string, location string")).first()


def test_evidence_of_a_company_page(spark):
    page = "<title>Careers at Acme</title><body>Acme hires a Backend Engineer in Pune <button>Apply now</button></body>"
    whole = evidence(spark, html=page)
    assert (whole["confidence"], whole["verified"], whole["company_score"], whole["role_score"]) == (100, True, 90, 65)
    assert not evidence(spark, html=page.replace("Apply now", "Applications are closed"))["verified"]
    closed = evidence(spark, html=page + " This position has been filled")
    assert not closed["active"] and not closed["verified"] and closed["confidence"] == 95
    assert evidence(spark, html=page, location=None)["has_location"] and evidence(spark, html="remote", location="Oslo")["has_location"]
    other = evidence(spark, url="https://isro.gov.in/x", html=page.replace("Acme", "Bolt"))
    assert other["official"] and other["company_score"] == 0 and not other["verified"]  # an official body's page must name the employer
    assert evidence(spark, url="https://acme.wd1.myworkdayjobs.com/x", html="<a href='#'>apply</a> a Backend Engineer")["verified"]  # an applicant system need not


def test_evidence_without_a_page(spark):
    unread = evidence(spark)
    assert (unread["official"], unread["confidence"], unread["active"], unread["verified"]) == (True, 0, True, False)
    for url in ("https://freshershunt.in/p", "https://bit.ly/x", None, "nonsense"):
        assert not evidence(spark, url=url, html="<button>Apply</button> Acme")["official"]


def test_repairs(spark):
    rows = [
        (1, None, None), (2, "https://forms.gle/a", "verified"), (3, "https://forms.gle/a", None), (4, NEWS, "verified"), (5, NEWS + "2", None), (6, "https://news.site.org/p", None), (7, "https://bit.ly/x", None),
        (8, NEWS, "pending"), (9, "mailto:x@y.example", None), (10, "https://intranet/apply", None),
    ]
    posts = spark.createDataFrame(rows, "id long, apply_url string, url_status string").withColumns({"source_url": F.lit("s"), "company": F.lit(None).cast("string"), "resolved": F.when(F.col("id") == 7, "https://forms.gle/w")})
    offers = spark.createDataFrame([(4, "https://forms.gle/z", 9, 0), (5, "https://a.com/jobs/1", 6, 0), (5, "https://b.com/jobs/1", 5, 1)], "post long, url string, score int, pos int")
    got = {r["id"]: (r["outcome"], r["apply_url"], r["url_status"], r["source_url"]) for r in E.repair_decision(posts, offers).collect()}
    assert got == {
        1: ("flagged", None, "pending", "s"), 2: ("unchanged", "https://forms.gle/a", "verified", "s"), 3: ("repaired", "https://forms.gle/a", "verified", "s"), 4: ("repaired", "https://forms.gle/z", "verified", NEWS),
        5: ("flagged", None, "needs_review", NEWS + "2"), 6: ("flagged", "https://news.site.org/p", "needs_review", "s"), 7: ("repaired", "https://forms.gle/w", "verified", "s"), 8: ("unchanged", NEWS, "pending", "s"),
        9: ("flagged", None, "needs_review", "s"), 10: ("flagged", "https://intranet/apply", "needs_review", "s"),
    }


def test_a_body_is_rewritten_in_place(spark):
    far = "x" * 200
    text = f"Apply: https://freshershunt.in/p/1. Not https://freshershunt.in/p/12, {far} https://freshershunt.in/p/1 {far}"
    better = F.create_map(F.lit("https://freshershunt.in/p/1"), F.lit("https://n.example/X"))
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(E.rewritten(F.col("text"), better).alias("said"))
    assert [r["said"] for r in df.collect()] == [text.replace("p/1.", "p/1.").replace("https://freshershunt.in/p/1.", "https://n.example/X.", 1), "", None]
    links = spark.createDataFrame([(text,)], "text string").select(F.explode(E.body_links(F.col("text"))).alias("x")).select("x.*").collect()
    assert [(x["raw"], text[x["at"] : x["at"] + len(x["raw"])] == x["raw"], x["calls"]) for x in links] == [("https://freshershunt.in/p/1", True, True), ("https://freshershunt.in/p/12", True, True), ("https://freshershunt.in/p/1", True, False)]


def test_damaged_links_give_way(spark):
    text = "Join https://t.me/a\nApply: https://acme.example/jobs/1"
    rows = [("https://t.me/a",), ("https://careers/x",), ("nonsense",), ("https://b.example/1",), (None,), ("",)]
    df = spark.createDataFrame(rows, "stored string")
    assert [r["x"] for r in df.select(E.restored_link(F.col("stored"), F.lit(text)).alias("x")).collect()] == ["https://acme.example/jobs/1"] * 3 + ["https://b.example/1", None, ""]
    assert df.select(E.restored_link(F.col("stored"), F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_posts_lose_promotion_only(spark):
    said = lambda t: spark.createDataFrame([(t,)], "t string").select(P.normalize_post(F.col("t")).alias("p")).first()["p"]
    whole = said("🔹 Acme is hiring\r\n\r\n\r\n\r\nJoin our WhatsApp group and apply https://acme.example/jobs/1 @acme_jobs |\nFollow us https://instagram.com/x.\n- - -")
    assert whole["cleaned_text"] == "Acme is hiring\n\nand apply https://acme.example/jobs/1" and whole["apply_url"] == "https://acme.example/jobs/1"
    assert whole["removed_urls"] == ["https://instagram.com/x"] and whole["removed_lines"] == 2
    assert said(None)["cleaned_text"] == "" and said("")["apply_url"] is None
    assert said("https://a.example/1\nApply below\nhttps://b.example/2")["apply_url"] == "https://b.example/2"
    assert said("https://www.linkedin.com/in/me/ https://www.linkedin.com/jobs/view/1")["apply_url"] == "https://www.linkedin.com/jobs/view/1"


def test_details_of_a_post(spark):
    text = "Company: Bolt\nRole - Dev\nSalary: 4 LPA\nSalary: 9 LPA\n• bring a laptop\nApply Link - https://a.example\nMail promo@x.example\nhr@bolt.example\nWe build things. Truly.\nBolt Off Campus Drive 2026 | Pune"
    none = F.lit(None).cast("string")
    d = spark.createDataFrame([(text,)], "t string").select(details.job_details(F.col("t"), F.lit(" "), F.lit("Engineer"), none, none, none).alias("d")).first()["d"]
    assert (d["company"], d["role"], d["salary"], d["email"], d["bullets"]) == ("Bolt", "Engineer", "4 LPA", "hr@bolt.example", ["bring a laptop"])
    assert "We build things. Truly." in d["prose"] and "Off Campus" not in d["prose"]
