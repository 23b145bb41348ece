"""Slugs, running means, provenance and rewriting at source positions: corner cases beside the queries' oracles."""

import itertools

import pytest
from pyspark.sql import functions as F

from sievewright.functions import slugs
from sievewright.operators import fields, rewrite, speed

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("company", "title", "want"), [
    ("Orange Business", "Consultant cyber-sécurité", "orange-business-consultant-cyber-securite"), ("", "", "job"), (None, None, "job"), ("وزارة الداخلية", "100 منصب 2026", "wzara-aldakhlya-mnsb"),
    ("ﻣﻬﻨﺪﺱ", "ﬃ", "mhnds-ffi"), ("٣ ١٢", "日本", "job"), ("a b c d e", "f g h i j", "a-b-c-d-e-f-g-h"), ("x" * 60, "y" * 60, "x" * 60 + "-" + "y" * 29),
])
def test_stems(spark, company, title, want):
    assert one(spark, slugs.stem(F.lit(company), F.lit(title))) == want


def test_longest_match_spells_first(spark):
    table = {"a": "1", "ab": "2", "abc": "3", "b": "4"}
    assert one(spark, slugs.transliterated(F.lit("abcabab\nxaé"), table)) == "322\nx1é"


def test_english_stems(spark):
    assert one(spark, slugs.english_stem(F.lit("وزارة التعليم"), F.lit("أستاذ محاضر ingénieur réseaux"), F.lit("الدار البيضاء"))) == "ministry-lecturer-engineer-network-casablanca"
    assert one(spark, slugs.english_stem(F.lit(""), F.lit("emploi"), F.lit(None))) == "employment-opportunity"
    assert one(spark, slugs.english_stem(F.lit("Acme"), F.lit(None), F.lit(None))) == "acme-job"


def test_batches_merge_in_any_order(spark):
    import datetime as dt

    rows = [(c, s, dt.datetime(2026, 1, d)) for c, s, d in [("a", 1.00004, 1), ("a", 3.0, 2), ("b", 2.0, 3), ("b", None, 4), ("c", None, 5), ("a", 0.1, 6)]]
    df = spark.createDataFrame(rows, "c string, s double, at timestamp")
    parts = [speed.summed(df.filter(f"day(at) % 3 = {i}"), "c", "s", "at") for i in range(3)]
    whole = sorted(speed.means(speed.summed(df, "c", "s", "at")).collect())
    for order in ((0, 1, 2), (2, 0, 1)):
        assert sorted(speed.means(speed.merged(parts[order[0]], speed.merged(parts[order[1]], parts[order[2]]))).collect()) == whole
    assert {r.candidate: (r.successes, None if r["mean"] is None else float(r["mean"]), r.fastest) for r in whole} == {"a": (3, 1.3667, False), "b": (2, 1.0, True), "c": (1, None, False)}
    listed = spark.createDataFrame([("a", 1), ("z", 2), ("b", 3)], "name string, n int")
    assert [r.name for r in speed.preferred(listed, speed.summed(df, "c", "s", "at"), "name", "n").orderBy("rank").collect()] == ["b", "a", "z"]
    assert speed.means(speed.merged(parts[0].limit(0))).count() == 0


@pytest.mark.parametrize(("table", "document", "detail", "official", "want"), [
    ("Positions: 12", "12 positions", "", True, ("source_table", "high")), ("", "avant le 05/06/2026 positions 12", "12", True, ("official_pdf", "high")), ("", None, "positions 12", False, ("official_detail_page", "medium")),
    ("12", "", "", True, ("extracted_field", "medium")),
])
def test_provenance_of_a_value(spark, table, document, detail, official, want):
    got = one(spark, fields.provenance(F.lit("12"), F.lit(official), F.lit(table), F.lit(document), F.lit(detail), ("Positions",)))
    assert tuple(got) == want
    assert tuple(one(spark, fields.provenance(F.lit(None).cast("string"), F.lit(True), F.lit(table), F.lit(""), F.lit("")))) == ("missing", "heuristic")


def test_layers_of_one_page(spark):
    page = spark.createDataFrame([(1, "a", " "), (2, None, "b")], "id int, x string, y string")
    facts = fields.merged("id", fields.from_row(page, "id", {"f": F.col("y"), "g": F.lit("s")}, "source"), fields.from_row(page, "id", {"f": F.col("x")}))
    assert sorted(map(tuple, facts.collect())) == [(1, "f", "a", "row", "medium"), (1, "g", "s", "source", "low"), (2, "f", "b", "source", "low"), (2, "g", "s", "source", "low")]
    assert [(r.id, r.f, r.g, r.origins) for r in fields.wide(facts, "id", ["f", "g"]).orderBy("id").collect()] == [(1, "a", "s", {"f": "row", "g": "source"}), (2, "b", "s", {"f": "source", "g": "source"})]


ROW = {"links": [{"kind": "apply", "label": "Apply <now>", "url": "https://a.example/x?q=1&r=2"}, {"kind": "document", "label": None, "url": " "}], "images": [{"url": "https://i.example/1", "alt": 'a "b"'}], "hub": "https://hub.example/"}
PIECES = ["<table><tr><th>Ref.</th><td>العمل</td></tr><tr><td>x<td>none</table>", "<p>المصدر: وكالة</p>", "<h2>Référence :</h2>", "<li>التوظيف &amp; <b>الترشيح</b>", "<script>var a='<p>العمل</p>'</script>", "<a href='https://a.example/x?q=1&amp;r=2#z'>go</a>", "<img src='https://i.example/1'>", "<p>plain\r\n text", "<!-- التوظيف -->", "<br/>", "</div>", "<p", "&nbsp;&#1575;&copy"]


def test_rewriters_commute_and_leave_the_rest_alone(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    pages += ["".join(p) for p in itertools.permutations(PIECES, 2)] + ["".join(PIECES), "", "\n\n<p>\nالعمل"]
    for source in pages:
        want = rewrite.rewrite(source, ROW)
        assert all(rewrite.rewrite(source, ROW, order) == want for order in itertools.islice(itertools.permutations(rewrite.REWRITERS), 0, 120, 17))
        page = rewrite.Source(source)
        removed = [e for r in rewrite.REMOVERS for e in r(page, ROW)]
        page.gone = [e[:2] for e in removed]
        edits = [*removed, *(e for r in rewrite.REWRITERS[2:] for e in r(page, ROW))]
        assert all(0 <= a <= b <= len(source) for a, b, _ in edits)
        # what no edit touches is there, in order
        at = 0
        for a, b, text in sorted(edits, key=lambda e: (e[0], -e[1])):
            if a >= at:
                assert source[at:a] in want
                at = b
        assert rewrite.rewrite(source, {"links": None, "images": None, "hub": None}, (rewrite.action_links, rewrite.hub_link, rewrite.page_images)) == source
    assert rewrite.rewrite(None, ROW) is None


def test_rewriting_once_is_enough():
    source = "".join(PIECES[:8])
    once = rewrite.rewrite(source, ROW)
    assert rewrite.rewrite(once, ROW) == once and "العمل</td>" not in once and once.count("hub.example") == 1
    assert rewrite.applied("0123456789", [(2, 4, "x"), (1, 6, ""), (9, 9, "y"), (10, 10, "z")]) == "0678y9z"
