"""Whole cleaners: page-layout text to header, body, trailer and footnotes, one row per document.

Each is a chain of operators on tables of lines. Marks (where the judgment starts and ends) are conditional minima per
document, joined back to its lines; only footnote numbers that run on across pages need a pass over a document in order.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docketry.operators import layout
from docketry.session import settled

# Marks of footnotes, of the start and of the end of a judgment.
FOOTNOTE = "^[.·]?\\s*(?:\\(?\\s*[\\dIl'!z]{1,2}\\s*\\)\\s*|\\d{1,2}\\s{2,})\\S"
CITATION_HINT = "\\b(?:1[89]\\d\\d|20\\d\\d)\\b|SCC|S\\.\\s*C\\.\\s*R|\\bAIR\\b|U\\.\\s*S\\.|Law\\.? Ed|L\\.\\s*R\\.|All ER|A\\.C\\.|[Ss]upra|reported|\\sv\\.?\\s|\\bNo\\.? ?\\d"
ORDER_OF_COURT = "(?i)JUDGMENT\\s*/\\s*ORDER\\s+OF\\s+THE\\s+SUPREME\\s+COURT"
DELIVERED = "(?i)The\\s+(?:following\\s+)?(?:Judgments?|Orders?|Opinions?)\\*?\\s+\\S{1,3}\\s+the\\s+Court\\s+(?:was|were)\\s+(?:delivered|passed|pronounced)(?:\\s+by)?"
DELIVERED_LOOSE = "(?i)\\b(?:was|were)\\s+delivered\\s+by\\b"
HEADING = "(?i)^(?:J\\s*U\\s*D\\s*G\\s*M\\s*E\\s*N\\s*T|O\\s*R\\s*D\\s*E\\s*R)$"
AUTHOR_START = "^(?:PER\\s+)?(?:DR\\.?\\s+)?[A-Z][A-Z.'\\-:~]+(?:\\s+[A-Z][A-Za-z.'\\-:~]*){0,6},?\\s*(?:C\\.?\\s*J\\.?(?:\\s*I\\.?)?|JJ?\\.)\\s*(?:[-—–:]|\\s[A-Z]|$)"
TRAILER = "(?i)^(?:Agents?\\s+for\\b|Headnotes\\s+prepared\\s+by\\b|Result\\s+of\\s+the\\s+case\\b)"
DISPOSAL = "^[A-Z][a-z]+(?:\\s+[a-z]+){1,5}\\s*\\.$"
BENCH = "^[\\[(].*[A-Z]{3}"
PROCEEDINGS = "(?i)^RECORD\\s+OF\\s+PROCEEDINGS$"
ITEM = "(?i)^ITEM\\s+NO\\b"
INITIALS = "^(?:[A-Z]\\.\\s?){2,4}$"
ARCHIVE_DISPOSAL = "^[A-Z][a-z]+(?:\\s+[a-z]+){1,5}\\s*[.,]?$"
COURT_TITLE = "(?i)^IN\\s+THE\\s+SUPREME\\s+COURT\\s+OF\\s+INDIA$"
PLACE = "(?i)^(?:New\\s+Delhi[;,.]?|[.…·\\s]{3,}\\s*J\\.?|[\\[(]\\s*[A-Z][A-Za-z.\\s'\\-]+[\\])]|(?:\\d{1,2}(?:st|nd|rd|th)?\\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December),?\\s+(?:\\d{1,2},?\\s+)?\\d{4}\\.?)$"
ARCHIVE_HEAD = "(?i)^\\s*http://JUDIS\\.NIC\\.IN\\b"
ARCHIVE_MARK = "^\\s*JUDGMENT:\\s*$"
NOTE_LINES, BENCH_LINES, AUTHOR_LINES, ITEM_LINES, NOTE_AHEAD = 6, 80, 6, 6, 25
NO_START = "the start of the judgment was not found: all of the text is taken"
NO_END = "the end of the judgment was not found"


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_no", "line_no")


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", layout.content(F.col("raw"))).where("line <> ''").withColumn("at", F.row_number().over(_doc()))


def _first(cond: Column) -> Column:
    return F.min(F.when(cond, F.col("at")))


def report_footnotes(lines: DataFrame) -> DataFrame:
    """Lines with `note`: whether they are in the block of footnotes at the page's foot, which begins at the first of its
    last six lines that looks like a note with a reference."""
    kept = layout.edges(lines)
    begins = (F.col("from_bottom") <= NOTE_LINES) & (F.col("from_top") > 1) & F.col("line").rlike(FOOTNOTE) & F.col("line").rlike(CITATION_HINT)
    start = F.min(F.when(begins, F.col("from_top"))).over(Window.partitionBy("doc_id", "page_no"))
    return kept.withColumn("note", F.coalesce(F.col("from_top") >= start, F.lit(False))).select("doc_id", "page_no", "line_no", "raw", "line", "note")


def _assembled(rows: DataFrame, marks: DataFrame, notes: DataFrame, docs: DataFrame, outline: Column | None = None) -> DataFrame:
    """header, body (paragraphs parted by blank lines), trailer, footnotes, warnings.

    rows: numbered content lines; marks: doc_id, header_end, body_start, body_end (a line's number or null), warnings.
    """
    placed = rows.join(marks, "doc_id")
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("at", "line")))), lambda x: x["line"]), "\n")
    ends = F.coalesce("body_end", F.lit(1 << 30))
    texts = placed.groupBy("doc_id").agg(joined(F.col("at") < F.col("header_end")).alias("header"), joined(F.col("at") >= ends).alias("trailer"))
    body = placed.where((F.col("at") >= F.col("body_start")) & (F.col("at") < ends)).select("doc_id", "page_no", "line_no", "raw")
    paras = layout.paragraphs(body, alone=f"{HEADING}|{PLACE}", outline=outline).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    out = docs.select("doc_id").distinct().join(marks.select("doc_id", "warnings"), "doc_id", "left").join(texts, "doc_id", "left").join(paras, "doc_id", "left").join(notes, "doc_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    none = F.array().cast("array<string>")
    return out.select("doc_id", blank("header"), blank("body"), blank("trailer"), F.coalesce("footnotes", none).alias("footnotes"), F.coalesce("warnings", none).alias("warnings"))


def _warned(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in pairs)))


def clean_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Report pages: heads, page numbers, margins and footnotes out; the judgment begins at the court's order, at the author
    behind `delivered by`, at that line itself or at a heading, and ends at the agents' or the disposal line."""
    lines = layout.page_lines(docs, id_col, text_col)
    stripped = layout.strip_edges(layout.strip_heads(lines).select("doc_id", "page_no", "line_no", "raw"), top=0, bottom=3)
    noted = settled(report_footnotes(stripped), "noted")
    notes = noted.where("note").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line"))), lambda x: x["line"]).alias("footnotes"))
    text = noted.where(~F.col("note")).select("doc_id", "page_no", "line_no", "raw")
    column = layout.text_column(text)
    rows = _numbered(layout.strip_margins(text).select("doc_id", "page_no", "line_no", "raw", "indent").join(column, ["doc_id", "page_no"]))
    disposal = F.col("line").rlike(DISPOSAL) & (F.col("indent") > (F.col("right") - F.col("left")) * 0.35)
    rows = settled(rows.withColumn("ends", F.col("line").rlike(TRAILER) | disposal), "rows")
    # The end of the case before, in front of this one's bench.
    head = rows.where((F.col("at") <= BENCH_LINES) & F.col("line").rlike(BENCH))
    bench = head.groupBy("doc_id").agg(F.coalesce(_first(F.col("line").rlike("J\\.?\\]")), F.min("at")).alias("bench"))
    before = rows.join(bench, "doc_id").where("ends and at < bench").groupBy("doc_id").agg(F.max("at").alias("old"))
    rows = rows.join(before, "doc_id", "left").where(F.col("at") > F.coalesce("old", F.lit(0))).drop("old")
    two = F.concat_ws(" ", "line", F.lead("line").over(_doc()))
    spans = lambda pattern: F.when(F.col("line").rlike(pattern), F.col("at")).when(two.rlike(pattern) & ~F.lead("line").over(_doc()).rlike(pattern), F.col("at") + 1)
    rows = rows.withColumns({"strict": spans(DELIVERED), "loose": spans(DELIVERED_LOOSE)})
    rules = rows.groupBy("doc_id").agg(
        _first(F.col("line").rlike(ORDER_OF_COURT)).alias("order"), F.min("strict").alias("strict"), F.min("loose").alias("loose"),
        _first(F.col("line").rlike(HEADING)).alias("heading"), F.min("at").alias("top"),
    )
    marker = F.coalesce("strict", "loose")
    author = rows.select("doc_id", "at", "line").join(rules.select("doc_id", marker.alias("marker")), "doc_id").where((F.col("at") >= F.col("marker")) & (F.col("at") < F.col("marker") + AUTHOR_LINES) & F.col("line").rlike(AUTHOR_START))
    rules = rules.join(author.groupBy("doc_id").agg(F.min("at").alias("author")), "doc_id", "left")
    start = F.coalesce(F.col("order") + 1, "author", "strict", "heading")
    rules = settled(rules.withColumn("start", start), "rules")
    ended = rows.join(rules.select("doc_id", F.coalesce("start", "top").alias("from")), "doc_id").where("ends and at >= from").groupBy("doc_id").agg(F.min("at").alias("body_end"))
    marks = rules.join(ended, "doc_id", "left").select("doc_id", F.coalesce("start", "top").alias("header_end"), F.coalesce("start", "top").alias("body_start"), "body_end", _warned((F.col("start").isNull(), NO_START), (F.col("body_end").isNull(), NO_END)).alias("warnings"))
    return _assembled(rows, marks, notes, lines)


_NOTE = re.compile(r"\s*(\d{1,3})(?:\s+(\S.*))?$")


def take_footnotes(pages: pd.DataFrame) -> pd.DataFrame:
    """One document's content lines with `note`: the number of the footnote that a line belongs to, or 0.

    A note begins at a line with the number that is due, among a page's last lines; the rest of the page is notes. A
    heading lets the next opinion begin with 1 again.
    """
    pages = pages.sort_values(["page_no", "line_no"])
    due, again, out = 1, False, []
    for _, page in pages.groupby("page_no", sort=True):
        raws = page["raw"].tolist()
        again = again or (due > 1 and any(re.match(HEADING, r.strip()) for r in raws))
        marks = [0] * len(raws)
        for first in [due, 1] if again else [due]:
            begin = next((i for i in range(max(0, len(raws) - NOTE_AHEAD), len(raws)) if (m := _NOTE.match(raws[i])) and int(m[1]) == first and (m[2] or i + 1 < len(raws))), None)
            if begin is not None:
                number = first - 1
                for i in range(begin, len(raws)):
                    m = _NOTE.match(raws[i])
                    number += bool(m and int(m[1]) == number + 1 and (m[2] or i + 1 < len(raws)))
                    marks[i] = number
                due, again = number + 1, False
                break
        out += marks
    return pages.assign(note=out)


def clean_signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Signed judgments: stamps, running lines, page numbers, footnotes and contents out; the judgment begins at its heading
    and ends at the record of proceedings; cover pages of further opinions go."""
    lines = layout.page_lines(docs, id_col, text_col)
    bare = settled(layout.strip_stamps(lines), "bare")
    kept = layout.strip_edges(bare, layout.running_lines(bare)).select("doc_id", "page_no", "line_no", "raw")
    kind = dict(kept.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in kept.columns) + ", note int"
    noted = settled(kept.groupBy("doc_id").applyInPandas(take_footnotes, schema), "noted")  # a document is a unit
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    first = F.when((F.col("note") > 0) & (F.coalesce(F.lag("note").over(order), F.lit(0)) != F.col("note")), 1).otherwise(0)
    numbered = noted.withColumn("n", F.sum(first).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("note > 0")
    notes = numbered.groupBy("doc_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "line_no", layout.content(F.col("raw")).alias("t")))), lambda x: x["t"]), " ").alias("t"))
    notes = notes.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("footnotes"))
    text = noted.where("note = 0").select("doc_id", "page_no", "line_no", "raw")
    text = text.join(layout.contents_lines(text).select("doc_id", "page_no", "line_no"), ["doc_id", "page_no", "line_no"], "left_anti")
    rows = settled(drop_cover_pages(settled(_numbered(text), "numbered")), "rows")
    marks = rows.groupBy("doc_id").agg(_first(F.col("line").rlike(HEADING)).alias("start"), F.min("at").alias("top"))
    marks = marks.withColumn("from", F.coalesce("start", "top"))
    close = rows.join(marks, "doc_id").where((F.col("at") >= F.col("from")) & F.col("line").rlike(PROCEEDINGS)).groupBy("doc_id").agg(F.min("at").alias("record"))
    items = rows.join(close, "doc_id").where((F.col("at") < F.col("record")) & (F.col("at") >= F.col("record") - ITEM_LINES) & F.col("line").rlike(ITEM)).groupBy("doc_id").agg(F.min("at").alias("item"))
    marks = marks.join(close, "doc_id", "left").join(items, "doc_id", "left")
    marks = marks.select("doc_id", F.col("from").alias("header_end"), F.col("from").alias("body_start"), F.coalesce("item", "record").alias("body_end"), _warned((F.col("start").isNull(), NO_START)).alias("warnings"))
    return _assembled(rows, marks, notes, lines)


def drop_cover_pages(rows: DataFrame) -> DataFrame:
    """Numbered lines without those between an opinion's place, date or signature and the next heading, where the court's
    title stands among them."""
    marked = rows.withColumns({"h": F.col("line").rlike(HEADING), "s": F.col("line").rlike(PLACE), "c": F.col("line").rlike(COURT_TITLE)})
    back, ahead = _doc().rowsBetween(Window.unboundedPreceding, -1), _doc().rowsBetween(1, Window.unboundedFollowing)
    here = lambda c: F.when(F.col(c), F.col("at"))
    titles = marked.where("h").withColumn("k", F.row_number().over(_doc())).where("k > 1").select("doc_id", F.col("at").alias("hi"))
    signed = marked.withColumn("lo", F.max(here("s")).over(back)).where("h").select("doc_id", F.col("at").alias("hi"), "lo").where("lo is not null")
    spans = signed.join(titles, ["doc_id", "hi"])
    court = marked.where("c").select("doc_id", F.col("at").alias("c_at"))
    spans = spans.join(court, "doc_id").where("c_at between lo and hi").select("doc_id", "lo", "hi").distinct()
    gone = rows.select("doc_id", "at").join(spans, "doc_id").where("at > lo and at < hi").select("doc_id", "at").distinct()
    return rows.join(gone, ["doc_id", "at"], "left_anti")


# How a preamble says who delivered judgments, and an author printed in lower case.
ANNOUNCED = r"(?i)(?:was|were)\s+delivered\s+by|delivered\s+(?:a\s+)?(?:separate|seperate|dissenting)"
TITLE_CASE_AUTHOR = r"^\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}),\s*(?:C\.\s*J\.|J\.)\s+[A-Z]"
PREAMBLE_LINES, AUTHOR_WITHIN = 40, 60


def announced_authors(rows: DataFrame) -> DataFrame:
    """Numbered lines in which an author's name in lower case is in capitals, where the document's first lines say that
    judgments were delivered and name that author in capitals."""
    first = rows.where(F.col("at") <= PREAMBLE_LINES).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("preamble"))
    first = first.where(F.col("preamble").rlike(ANNOUNCED))
    name = F.nullif(F.regexp_extract("raw", TITLE_CASE_AUTHOR, 1), F.lit(""))
    told = F.coalesce(F.contains("preamble", F.concat(F.upper(name), F.lit(","))), F.lit(False))
    capital = lambda c: F.when(told, F.replace(F.col(c), name, F.upper(name))).otherwise(F.col(c)).alias(c)
    joined = rows.join(first, "doc_id", "left")
    return joined.select(*(capital(c) if c in ("raw", "line") else F.col(c) for c in rows.columns))


def clean_archive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Archive texts: banners out, cut tails put back, notes above lone page numbers taken out; the judgment begins behind
    its mark, or else at the first author's line, and ends at a disposal line among the last six."""
    lines = layout.page_lines(docs, id_col, text_col).where(~F.col("raw").rlike(ARCHIVE_HEAD))
    rows = settled(announced_authors(settled(_numbered(layout.merge_tails(settled(lines, "lines"))), "merged")), "announced")
    lone = F.col("line").rlike("^\\d{1,4}$")
    note = F.col("line").rlike("^\\(\\s*\\d{1,2}\\s*\\)\\s*\\S") & (F.col("line").rlike(CITATION_HINT) | F.col("line").rlike("^\\(\\s*\\d{1,2}\\s*\\).*\\d"))
    # Notes stand in an unbroken run above a lone number: the next line that is no note is one.
    ahead = _doc().rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"lone": lone, "is_note": note})
    rows = rows.withColumn("note", F.col("is_note") & F.coalesce(F.first(F.when(~F.col("is_note"), F.col("lone")), ignorenulls=True).over(ahead), F.lit(False)))
    notes = rows.where("note").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: F.split(x["line"], "\\s+(?=\\(\\s*\\d{1,2}\\s*\\)\\s)"))).alias("footnotes"))
    rows = rows.where("not note and not lone")
    marked = rows.groupBy("doc_id").agg(_first(F.col("line").rlike(ARCHIVE_MARK)).alias("mark"), F.collect_list(F.length(F.rtrim("raw"))).alias("w"))
    rows = rows.join(marked.select("doc_id", "mark", layout.nearest_rank(F.col("w"), 0.9).alias("width")), "doc_id")
    # The editor's notes: the unbroken run of initials, agents and disposal lines at the end; a disposal line counts if it
    # stands to the right or above another note.
    up = Window.partitionBy("doc_id").orderBy(F.desc("at"))
    disposal, initials = F.col("line").rlike(ARCHIVE_DISPOSAL), F.col("line").rlike(INITIALS) | F.col("line").rlike(TRAILER)
    rows = rows.withColumn("from_end", F.row_number().over(up))
    late = (F.col("from_end") <= NOTE_LINES) & (F.col("at") > F.coalesce("mark", F.lit(0)))
    sure = initials | (disposal & (layout.indent(F.col("raw")) > F.col("width") * 0.3))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"run": F.min(F.when(late & (disposal | initials), 1).otherwise(0)).over(so_far), "sure": F.max(F.when(sure, 1).otherwise(0)).over(so_far)})
    mark, end = F.min("mark"), _first((F.col("run") == 1) & (F.col("sure") == 1))
    # Without a mark the judgment begins at the first author's line near the top.
    marks = rows.withColumn("author", F.when((F.row_number().over(_doc()) <= AUTHOR_WITHIN) & F.col("line").rlike(AUTHOR_START), F.col("at"))).groupBy("doc_id").agg(F.coalesce(mark + 1, F.min("author")).alias("start"), end.alias("body_end"), F.min("at").alias("top"))
    marks = marks.select("doc_id", F.coalesce("start", "top").alias("header_end"), F.coalesce("start", "top").alias("body_start"), "body_end", _warned((F.col("start").isNull(), NO_START)).alias("warnings"))
    return _assembled(rows.select("doc_id", "page_no", "line_no", "raw", "line", "at"), marks, notes, lines, layout.by_outline(author=AUTHOR_START))


def clean_site(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of the court's website: archive texts by their banner in the first 200 characters, the others as signed ones."""
    archive = F.coalesce(F.substring(text_col, 1, 200).rlike("(?i)http://JUDIS\\.NIC\\.IN\\b"), F.lit(False))
    return clean_archive(docs.where(archive), id_col, text_col).unionByName(clean_signed(docs.where(~archive), id_col, text_col))
