"""Candidates: single refusals, absent values, and what a rule compares."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievewright.operators import candidates, identity

COLUMNS = (
    "source string, source_priority string, title string, url string, detail_url string, apply_url string, apply_email string, link_kind string, apply_source string, notice_type string, "
    "eligibility string, kind string, education string, location string, diploma string, salary string, official boolean, email_verified boolean, needs_account boolean, retired boolean, rolling boolean, "
    "entry_level boolean, date_only boolean, positions int, deadline timestamp, published timestamp, discovered timestamp, focus int, actions array<struct<kind:string,url:string>>, document_texts array<string>, extra string"
)
PAGE = "https://www.city.gov.ma/jobs/4711"
PORTAL = "https://portal.gov.ma/entry"


def rows(spark, *given):
    names = [c.strip().split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names) for g in given], COLUMNS)


CASES = [
    ({}, "no_direct_address"),
    ({"retired": True, "apply_url": PAGE}, "retired_source"),
    ({"apply_url": "mailto:hr@city.gov.ma", "apply_email": "HR@city.gov.ma ", "email_verified": True, "official": True}, ""),
    ({"apply_url": "mailto:hr@city.gov.ma", "apply_email": "hr@city.gov.ma", "email_verified": None, "official": True}, "mail_not_verified"),
    ({"detail_url": PAGE, "apply_url": "https://city.gov.ma/go/4711?next=/account/login"}, "sign_in_page"),
    ({"detail_url": PAGE, "apply_url": PAGE}, "description_page"),
    ({"detail_url": PAGE, "apply_url": "http://city.gov.ma/jobs/4711/apply/?utm_source=x"}, ""),
    ({"detail_url": PAGE, "apply_url": "https://city.gov.ma/jobs/4712/apply"}, "generic_or_other_vacancy"),
    ({"detail_url": PAGE, "apply_url": "https://ats.example/offers/88123", "actions": [("apply", "https://ATS.example/offers/88123/?gclid=1")]}, ""),
    ({"detail_url": PAGE, "apply_url": "https://ats.example/offers/88123", "actions": [("info", "https://ats.example/offers/88123"), (None, None)]}, "no_apply_action"),
    ({"detail_url": PAGE, "apply_url": "https://ats.example/offers/88123", "link_kind": "direct_apply", "needs_account": True}, "account_not_verified"),
    ({"detail_url": PAGE, "apply_url": PORTAL, "link_kind": "official_application_channel", "notice_type": "competition", "official": True, "actions": [("Apply", PORTAL + "/")]}, ""),
    ({"detail_url": PAGE, "apply_url": PORTAL, "link_kind": "official_application_channel", "notice_type": "competition", "official": True, "apply_source": "official_pdf", "actions": [("apply", PORTAL)], "document_texts": ["elsewhere", None]}, "portal_not_in_document"),
    ({"detail_url": PAGE, "apply_url": PORTAL, "link_kind": "official_application_channel", "notice_type": "vacancy", "official": True, "actions": [("apply", PORTAL)]}, "portal_not_verified"),
    ({"detail_url": PAGE, "apply_url": PORTAL, "link_kind": "listing"}, "not_an_action"),
]


def test_refusals(spark):
    got = candidates.applied(rows(spark, *({**case, "extra": str(i)} for i, (case, _) in enumerate(CASES))))
    assert got.columns == [c.strip().split()[0] for c in COLUMNS.split(", ")] + ["bound", "refusal"]
    found = {int(r.extra): r.refusal for r in got.collect()}
    assert found == {i: want for i, (_, want) in enumerate(CASES)}


def test_assessment_of_nothing_and_of_a_good_row(spark):
    now = dt.datetime(2024, 5, 2, 12)
    good = {
        "detail_url": PAGE, "url": PAGE, "apply_url": PAGE + "/apply", "official": True, "title": "Clerk", "eligibility": "Morocco", "kind": "job", "published": dt.datetime(2024, 5, 2, 6),
        "deadline": dt.datetime(2024, 5, 20), "positions": 12, "source_priority": "S+", "location": "Fes", "focus": 3, "extra": "good",
    }
    got = {r.extra: r for r in candidates.assessed(rows(spark, good, {}), F.lit(now)).collect()}
    assert (got["good"].standing, got["good"].reasons, got["good"].score) == ("publish", [], 98)
    assert len(got["good"].points) == 12 and got["good"].points["diploma"] == 0
    assert got[None].standing == "reject" and got[None].score == 0
    assert got[None].reasons == ["eligibility_unknown", "no_page", "no_application", "publication_unknown", "no_deadline", "no_direct_address"]
    assert candidates.assessed(rows(spark), F.lit(now)).count() == 0


@pytest.mark.parametrize("change, want", [({}, []), ({"location": "Rabat"}, ["location"]), ({"apply_url": "http://www.h.example/jobs/1/?utm_source=x"}, []), ({"document_urls": ["https://h.example/b.pdf", None]}, ["document_urls"]), ({"notice_type": None}, [])])
def test_changed_columns(spark, change, want):
    one = {"positions": 1, "deadline": "2024-05-01", "salary": None, "contract": "c", "location": "Fes", "apply_url": "https://h.example/jobs/1", "notice_type": "vacancy", "notice_status": None, "document_urls": ["https://h.example/b.pdf", "https://h.example/a.pdf"]}
    schema = "positions int, deadline string, salary string, contract string, location string, apply_url string, notice_type string, notice_status string, document_urls array<string>"
    of = lambda row: spark.createDataFrame([tuple(row.values())], schema)
    old = {**one, "document_urls": one["document_urls"][::-1], "salary": " "}
    got = of({**one, **change}).alias("a").crossJoin(of(old).alias("r")).select(identity.changed_columns().alias("c")).first().c
    assert got == want
