"""Small literal tables for operators whose grammar the data tables do not speak, with the results to expect."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """A SELECT of literal rows."""

    def lit(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join(f"({', '.join(lit(v) for v in r)})" for r in rows)
    return f"select * from (values {body}) t({', '.join(columns)})"


#: text, canonical form, reporter key, issues as of 2026-01-01
CITATIONS = [
    ("(1981) 2 SCC 412", "(1981) 2 SCC 412", "SCC", ""),
    ("(1981) 2 S.C.C. 412", "(1981) 2 SCC 412", "SCC", ""),
    ("1994 Supp. (2) S.C.C. 31", "1994 Supp (2) SCC 31", "SCC", ""),
    ("(2011) 7 scc (l & s) 9", "(2011) 7 SCC (L&S) 9", "SCC (L&S)", ""),
    ("(2011) 7 SCC (cri) 10", "(2011) 7 SCC (Cri) 10", "SCC (Cri)", ""),
    ("A.I.R. 1962 S.C. 77", "AIR 1962 SC 77", "AIR SC", ""),
    ("AIR 1944 bom 5", "AIR 1944 Bom 5", "AIR Bom", ""),
    ("[1971] 3 S.C.R. 208", "[1971] 3 SCR 208", "SCR", ""),
    ("[1976] Supp. SCR 44", "[1976] Supp SCR 44", "SCR", ""),
    ("1976 Supp (2) SCR 44", "[1976] Supp (2) SCR 44", "SCR", ""),
    ("(2014) 3 SCALE 7", "(2014) 3 SCALE 7", "SCALE", ""),
    ("JT 2003 (9) SC 55", "JT 2003 (9) SC 55", "JT", ""),
    ("2025 insc 31", "2025 INSC 31", "INSC", ""),
    ("(2088) 1 SCC 5", "(2088) 1 SCC 5", "SCC", "2088 is in the future"),
    ("(1961) 1 SCC 0", "(1961) 1 SCC 0", "SCC", "SCC has no Supreme Court reports before 1969; page number cannot be 0"),
    ("(1991) 0 SCC 8", "(1991) 0 SCC 8", "SCC", "volume number cannot be 0"),
    ("AIR 1931 SC 6", "AIR 1931 SC 6", "AIR SC", "AIR SC has no Supreme Court reports before 1950"),
    ("see (1981) 2 SCC 412", None, None, None),
    ("(1981) SCC", None, None, None),
    ("1981 2 412", None, None, None),
    ("", None, None, None),
]

#: running text, canonical citations in order
FOUND = [
    ("As held in (1981) 2 SCC 412 : AIR 1981 SC 90, and again in [1971] 3 SCR 208.", "(1981) 2 SCC 412 | AIR 1981 SC 90 | [1971] 3 SCR 208"),
    ("Nothing is cited here.", ""),
    ("JT 2003 (9) SC 55 and 2025 INSC 31; (2014) 3 SCALE 7", "JT 2003 (9) SC 55 | 2025 INSC 31 | (2014) 3 SCALE 7"),
]

NAMES = [
    ("In 1991, Lal Chand v. Union of Hills, the rule was laid down.", "Lal Chand v. Union of Hills"),
    ("It followed Meena Devi vs. Orchard Mills Ltd. and Anr. in full.", "Meena Devi v. Orchard Mills Ltd. and Anr."),
    ("No case is named, and nothing v. something is not a name.", ""),
]


def cases(spark: SparkSession) -> DataFrame:
    rows = [
        ("a", "Lal Chand v. Union of Hills", ["Lal Chand"], 1991, 2, ["(1991) 2 SCC 40"]),
        ("b", "Meena Devi v. Orchard Mills", [], 1985, 2, ["(1985) 1 SCC 7"]),
        ("c", "Rustom Irani v. Port Trust", [], 1977, None, []),
        ("d", "Sarla Bai v. Municipal Board", [], 1999, 3, ["(1999) 5 SCC 1"]),
        ("e", "Tara Nath v. Revenue Officer", [], 2001, None, []),
    ]
    return spark.createDataFrame(rows, "case_id string, title string, aliases array<string>, year int, bench_strength int, citations array<string>")


def records(spark: SparkSession) -> DataFrame:
    day = dt.date
    rows = [
        ("a", 0, "court site", "court", True, "Lal Chand vs Union of Hills", day(1991, 3, 4), ["P. Rao", "K. Sen"], ["(1991) 2 SCC 40"]),
        ("a", 1, "report", "reports", False, "LAL CHAND V. UNION OF HILLS", day(1991, 3, 4), ["Justice K. Sen", "Justice P. Rao"], ["(1991) 2 S.C.C. 40"]),
        ("b", 0, "court site", "court", True, "Meena Devi v. Orchard Mills", day(1985, 6, 1), ["P. Rao", "K. Sen"], []),
        ("b", 1, "report", "reports", False, "Meena Devi v. Orchard Mills", day(1985, 6, 2), ["P. Rao", "K. Sen"], []),
        ("c", 0, "court site", "court", True, "Rustom Irani v. Port Trust", day(1977, 1, 1), [], []),
        ("c", 1, "mirror", "court", False, "Rustom Irani v. Port Trust", day(1977, 1, 1), [], []),
        ("d", 0, "blog", "blog", False, "Sarla Bai v. Municipal Board", None, [], []),
        ("d", 1, "report", "reports", False, "Sarla Bai v. Municipal Board", None, [], []),
    ]
    return spark.createDataFrame(rows, "case_id string, rec_ord int, source string, origin string, official boolean, title string, decision_date date, judges array<string>, citations array<string>")


#: case, status, reasons
VERIFIED = [
    ("a", "verified", ""),
    ("b", "partly_verified", "sources differ on decision_date"),
    ("c", "could_not_verify", "fewer than two independent sources"),
    ("d", "could_not_verify", "no official source"),
    ("e", "could_not_verify", "no source has this case"),
]


def paragraphs(spark: SparkSession) -> DataFrame:
    rows = [
        ("j", 1, "The petitioner owned a mill beside the river."),
        ("j", 2, "In Lal Chand v. Union of Hills, (1991) 2 SCC 40, this Court spoke of a “fair and open hearing” before closure."),
        ("j", 3, "Counsel also named Tara Nath v. Revenue Officer without a report."),
        ("j", 4, "Section 9 says that “no mill shall be closed unless its owner\nhas been heard and reasons are given”. The order is set aside."),
    ]
    return spark.createDataFrame(rows, "doc_id string, ordinal int, text string")


def claims(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "holding", 'Section 9 says "no mill shall be closed unless its owner has been heard".', [4]),
        (2, "holding", "The order was set aside.", []),
        (3, "holding", "The order was set aside.", [4, 9]),
        (4, "ratio", 'The Court wanted a "fair and open hearing" for all.', [1]),
        (5, "ratio", 'It says "no mill shall be closed ... reasons are given".', [4]),
        (6, "ratio", 'It says "no mill may be closed".', [4]),
        (7, "facts", "The Court followed Lal Chand v. Union of Hills, (1991) 2 SCC 40.", [2]),
        (8, "facts", "It followed Vikram Seth v. Harbour Company.", [2]),
        (9, "facts", "Lal Chand is at AIR 1991 SC 8.", [2]),
        (10, "issues", "Counsel named Tara Nath v. Revenue Officer.", [3]),
        (11, "opinions", "In Gopal Das v. Mill Board, [1990] 2 SCR 10, the order was set aside.", [4]),
        (12, "obiter", " ", [1]),
    ]
    return spark.createDataFrame([(i, "j", s, t, p) for i, s, t, p in rows], "claim_id int, doc_id string, section string, text string, paragraphs array<int>")


def subject(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("j", ["Gopal Das v. Mill Board"], ["[1990] 2 SCR 10"])], "doc_id string, names array<string>, citations array<string>")


def known_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Lal Chand v. Union of Hills",)], "name string")


#: claim, problems, flags, kept
CHECKED = [
    (1, "", "", True),
    (2, "the claim cites no paragraph", "", False),
    (3, "no such paragraph: 9", "", False),
    (4, "quotation is in paragraph 2: fair and open hearing", "", False),
    (5, "", "", True),
    (6, "quotation not found: no mill may be closed", "", False),
    (7, "", "", True),
    (8, "case not named in the cited paragraphs: Vikram Seth v. Harbour Company", "", False),
    (9, "citation not in the cited paragraphs: AIR 1991 SC 8", "", False),
    (10, "", "case not in the table: Tara Nath v. Revenue Officer", True),
    (11, "", "", True),
    (12, "the claim is empty", "", False),
]


REPORT = """IN THE COURT OF HILLS
Lal Chand v. Union of Hills

J U D G M E N T

P. RAO, J.

1. The petitioner owns a mill and asks that the Govern-
ment open it again.

2. The govern-
ment says that the mill was closed by law. The government relies on

   "18. Procedure of closure"

BACKGROUND

3. The petition is allowed.

...........J.
[P. RAO]
New Delhi;
May 1, 1991

K. SEN, J.—I do not agree. The petition fails.
"""


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", REPORT), ("plain", "One block of text.\n\nAnother block."), ("none", None)], "doc_id string, text string")


#: document, ordinal, opinion, the court's own number, text
SPLIT = [
    ("r", 1, 0, "1", "The petitioner owns a mill and asks that the Government open it again."),
    ("r", 2, 0, "2", 'The government says that the mill was closed by law. The government relies on\n\n"18. Procedure of closure"'),
    ("r", 3, 0, None, "BACKGROUND"),
    ("r", 4, 0, "3", "The petition is allowed."),
    ("r", 5, 1, None, "I do not agree. The petition fails."),
    ("plain", 1, 0, None, "One block of text."),
    ("plain", 2, 0, None, "Another block."),
]

STAMPED = [
    "The first line of the page.",
    "Signature Not Verified    and here the text goes on",
    "",
    "Digitally signed by",
    "P RAO",
    "Date: 2021.03.04         beside the date",
    "17:20:11 IST",
    "Reason:",
    "THE TEXT AFTER THE STAMP",
]

#: line number, text
UNSTAMPED = [
    (1, "The first line of the page."),
    (2, "and here the text goes on"),
    (6, "beside the date"),
    (9, "THE TEXT AFTER THE STAMP"),
]


REPORT_PAGES = "\f".join([
    "\n".join(["SUPREME COURT REPORTS      [1978] 3 S.C.R.", "", "LAL CHAND", "v.", "UNION OF HILLS", "[P. RAO AND K. SEN, JJ.]",
               "The Judgment of the Court was", "delivered by", "RAO, J.-The petitioner owns a mill beside the river and he",
               "asks that it be opened again as soon as it can be.", "(1) [1950] S.C.R. 605."]),
    "\n".join(["LAL CHAND v. UNION (Rao, J.)      965", "", "The mill was closed without a hearing and without any reason.",
               "The petition is allowed.", "                                        Petition allowed.", "Agent for the petitioner: A. B. Seth."]),
])

SIGNED = "\f".join([
    "\n".join(["REPORTABLE", "IN THE SUPREME COURT OF INDIA", "JUDGMENT", "", "1. The petitioner owns a mill that", "Signature Not Verified    lies at the river.", "Digitally signed by", "P RAO", "Date: 2021.03.04", "17:20:11 IST", "Reason:", "1  AIR 1981 SC 90.", "Page 1 of 3"]),
    "\n".join(["REPORTABLE", "2. The mill was closed.", "New Delhi;", "IN THE SUPREME COURT OF INDIA", "CAUSE TITLE AGAIN", "JUDGMENT", "", "I agree.", "Page 2 of 3"]),
    "\n".join(["REPORTABLE", "ITEM NO.5", "RECORD OF PROCEEDINGS", "The court met.", "Page 3 of 3"]),
])

ARCHIVE = "http://JUDIS.NIC.IN    SUPREME COURT OF INDIA\nPETITIONER:\nLAL CHAND\nJUDGMENT:\nThe petitioner owns a mill beside the river, and he works there.\n(1) [1957] 31 I.T.R. 826.\n  31\nIt was closed, and no reason was given to him at any time.\n                              Petition dismissed.\nV. P. S.\n"

#: document, first words of the body, trailer, footnotes, warnings
CLEANED = [
    ("a", "The petitioner owns a mill beside the river, and he works there.\n\nIt was closed, and no reason was given to him at any time.", "Petition dismissed.\nV. P. S.", "(1) [1957] 31 I.T.R. 826.", ""),
    ("s", "JUDGMENT\n\n1. The petitioner owns a mill that lies at the river.\n\n2. The mill was closed.\n\nNew Delhi;\n\nJUDGMENT\n\nI agree.", "ITEM NO.5\nRECORD OF PROCEEDINGS\nThe court met.", "1 AIR 1981 SC 90.", ""),
]
CLEANED_REPORT = [("r", "RAO, J.-The petitioner owns a mill beside the river and he asks that it be opened again as soon as it can be. The mill was closed without a hearing and without any reason. The petition is allowed.", "Petition allowed.\nAgent for the petitioner: A. B. Seth.", "(1) [1950] S.C.R. 605.", "")]
