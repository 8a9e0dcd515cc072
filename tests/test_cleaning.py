"""The whole cleaners on small synthetic documents."""

from docketry.operators import cleaning
from docketry.plans.literals import ARCHIVE, REPORT_PAGES, SIGNED

def test_report(spark):
    r = cleaning.clean_report(spark.createDataFrame([("r", REPORT_PAGES)], "doc_id string, text string")).first()
    assert "LAL CHAND" in r.header and "S.C.R." not in r.header
    assert r.body.startswith("RAO, J.-The petitioner owns a mill") and r.body.endswith("The petition is allowed.")
    assert r.trailer.startswith("Petition allowed.") and "Agent for" in r.trailer
    assert r.footnotes == ["(1) [1950] S.C.R. 605."] and r.warnings == []


def test_signed(spark):
    r = cleaning.clean_signed(spark.createDataFrame([("s", SIGNED)], "doc_id string, text string")).first()
    assert "Page" not in r.body and "Digitally" not in r.body and "REPORTABLE" not in r.body
    assert "1. The petitioner owns a mill that lies at the river." in r.body and "\n\nNew Delhi;\n\n" in r.body and "I agree." in r.body
    assert "CAUSE TITLE AGAIN" not in r.body and r.footnotes == ["1 AIR 1981 SC 90."]
    assert r.trailer.startswith("ITEM NO.5") and r.warnings == []


def test_archive_and_dispatch(spark):
    rows = {r.doc_id: r for r in cleaning.clean_site(spark.createDataFrame([("a", ARCHIVE), ("s", SIGNED), ("e", None), ("x", "no mark here")], "doc_id string, text string")).collect()}
    a = rows["a"]
    assert a.body.startswith("The petitioner owns a mill beside") and "JUDIS" not in a.header and a.footnotes == ["(1) [1957] 31 I.T.R. 826."]
    assert a.trailer == "Petition dismissed.\nV. P. S." and "It was closed, and" in a.body
    assert rows["x"].warnings == [cleaning.NO_START] and "I agree." in rows["s"].body


def test_archive_authors_and_quotations(spark):
    """An author announced in capitals and printed in lower case; an indented quotation is a paragraph of its own."""
    full = "the petitioner said that the mill beside the river had been his"
    lines = [
        "http://JUDIS.NIC.IN", "The judgment of the Court was delivered by SUBBA RAO, C.J.", "Subba Rao, C.J. This is so as " + full,
        full + " for a", "long time. He relied on the rule that",
        "     no mill shall be closed without a hearing that",
        "     is held in public and in his presence as is right'",
        full + " since",
        "then; and", full + " too.", "Das, J. agreed.",
    ]
    r = cleaning.clean_archive(spark.createDataFrame([("a", "\n".join(lines))], "doc_id string, text string")).first()
    paras = r.body.split("\n\n")
    assert "SUBBA RAO, C.J. This is so" in r.body and "Das, J. agreed." in r.body
    assert any(p.startswith("no mill shall") and p.endswith("is right'") for p in paras), paras
    assert any(p.startswith("the petitioner said") and "then; and" in p for p in paras), paras
