"""The publication gate over pages rendered from the customers, each with the defect that its balance picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .catalogue import query, spread, table
from .gate_queries import oracle

#: Reasons by defect; a page may break later rules too, the first one counts.
_REASONS = (
    "", "no_html", "no_title", "no_description", "visible_markup", "repeated_blocks", "language_mix", "image_missing", "top_heading", "heading_repeats_title", "related_block", "related_text", "label_link", "script",
    "description_length", "employer_voice", "internal_metadata", "reference_leak", "promotion", "no_source", "repeated_rows", "fact_missing", "unverified_link", "portal_unverified", "other_vacancy", "portal_unclassified",
    "channel_called_direct", "title_style", "link_twice", "cover_not_first", "document_pages",
)


@oracle(f"""with c as (select c_custkey, floor(abs(c_acctbal) * 100)::bigint % {len(_REASONS)} as d from customer), r as (select *, {list(_REASONS)}[d + 1] as reason from c) select c_custkey, reason = '' as passed, reason from r""")
@query
def publication_quality(spark, sf_dir):
    """The first rule that a page of each customer breaks."""
    d = F.floor(F.abs("c_acctbal") * 100).cast("bigint") % len(_REASONS)
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")).withColumn("reason", F.get(F.array(*map(F.lit, _REASONS)), d.cast("int")))
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")

    def broken(**defects):
        """What a defect puts in a place; elsewhere what a good page has there."""
        out = defects.pop("good")
        for reason, value in defects.items():
            out = F.when(F.col("reason") == reason, value).otherwise(out)
        return out

    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    sentence = "The post asks for a diploma and three years of work with public clients of the region, by the notice of the office."
    long = " ".join(["الشغل"] * 40 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)])
    more = broken(
        good=F.lit(""), visible_markup=F.lit("<p>{ \"a\": \"b\" }</p>"), repeated_blocks=F.lit(f"<p>First. {sentence} {sentence} End.</p>"), language_mix=F.lit(f"<p>{long}</p>"), top_heading=F.lit("<h1>x</h1>"), heading_repeats_title=F.concat(F.lit("<h2>Recrutement de "), name, F.lit(" techniciens pour le réseau</h2>")),
        related_block=F.lit("<div class='a pRelate'></div>"), related_text=F.lit("<p>مقالات ذات صلة</p>"), label_link=F.lit("<a href='https://s.example/search/label/jobs'>x</a>"), script=F.lit("<script>1</script>"), internal_metadata=F.lit("<p>Réf : 7</p>"),
        reference_leak=F.concat(F.lit("<p>code ZX-"), key, F.lit("</p>")), promotion=F.lit("<p>فرصة رائعة</p>"), repeated_rows=F.lit("<table><tr><td>A</td><td>b</td></tr><tr><td>a</td><td>B.</td></tr></table>"),
        channel_called_direct=F.lit("<p>رابط التقديم المباشر</p>"), link_twice=F.lit("<a href='https://s.example/j/1'>x</a><a href='https://s.example/j/1?utm_source=y'>z</a>"),
    )
    image = broken(good=F.lit("<img src='https://i.example/c.png'><img src='https://i.example/1.png'>"), image_missing=F.lit(""), cover_not_first=F.lit("<img src='https://i.example/1.png'><img src='https://i.example/c.png'>"), document_pages=F.lit("<img src='https://i.example/c.png'>"))
    body = F.concat(image, F.lit("<p>"), name, F.lit(" &amp; co</p><a href='https://s.example/j/2?a=1&amp;b=2'>go</a>"), more)
    apply = broken(good=F.lit("https://s.example/jobs/12345"), portal_unverified=F.lit("https://s.example/portal"), portal_unclassified=F.lit("https://s.example/portal"))
    description = F.rpad(F.concat(name, F.lit(" cherche des techniciens pour le réseau de la région")), 120, ".")
    page = quality.Page(
        html=broken(good=body, no_html=F.lit(" ")), title=broken(good=F.concat(F.lit("Recrutement de "), name, F.lit(" techniciens pour le réseau")), no_title=none, title_style=F.lit("Offre")),
        description=broken(good=description, no_description=F.lit(""), description_length=F.lit("short"), employer_voice=F.concat(description, F.lit(" نبحث عن"))), source=broken(good=F.lit("https://s.example/n"), no_source=none), notice=F.lit("vacancy"),
        application=apply, kind=broken(good=F.lit("direct_apply"), channel_called_direct=F.lit("official_application_channel")), bound=~F.col("reason").isin("portal_unverified", "other_vacancy"), image=F.lit(True), cover=F.lit("https://i.example/c.png"),
        documents=F.array(F.lit("https://i.example/1.png")), references=F.array(F.concat(F.lit("zx-"), key), none), lacking=broken(good=empty, fact_missing=F.array(F.lit("deadline"))), unverified=broken(good=empty, unverified_link=F.array(F.lit("u"))),
    )
    gate = quality.publication_gate(page)
    return rows.select("c_custkey", gate.alias("gate")).select("c_custkey", "gate.passed", "gate.reason")
