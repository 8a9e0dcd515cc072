"""Pages, lines and their layout as tables: one row per line, windows instead of loops.

Lines: doc_id, page_no, line_no, raw (line_no counts within the page, from 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What page furniture looks like.
CONTROL = "[\\x00-\\x08\\x0b\\x0e-\\x1f\\x7f]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
DASH_ESCAPES = {"\\027": "—", "\\026": "–"}
PAGE_NUMBER = "^[^\\w\\s]{0,2}\\s*\\d{1,4}\\s*[^\\w\\s]{0,2}$"
PAGE_OF = "(?i)\\bPage\\s+\\d+(?:\\s+of\\s+\\d+)?\\s*$"
LEADER = "(?:\\.{4,}|…{2,}|(?:\\.\\s){4,})\\s*\\.*\\s*\\d{0,4}\\s*$"
CONTENTS_HEADING = "(?i)^(?:INDEX|CONTENTS|TABLE OF CONTENTS)$"
ABBREVIATION_END = "(?:\\b[A-Z]|\\b(?:Dr|Mr|Mrs|Ms|Messrs|No|Nos|Sh|Smt|Shri|St|vs?|viz|i\\.e|e\\.g))\\.$"
NUMBERED = "^\\d{1,3}(?:\\.\\d{1,3})*\\.\\s"
EDGE_PUNCTUATION = ".,;:!?\"'“”‘’()[]{}*"
GAP = 3  # blanks that part the segments of a line
EDGE_TOP, EDGE_BOTTOM = 2, 3  # content lines of a page where running lines stand
RUNNING_PAGES, RUNNING_SHARE = 3, 0.3


def clean_text(text: Column) -> Column:
    """One kind of line end, ligatures spelled out, dash escapes read, no control characters; form feeds stay."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for a, b in (LIGATURES | DASH_ESCAPES).items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, CONTROL, "")


def page_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines of whole texts; form feeds part pages."""
    pages = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(clean_text(F.col(text_col)), "\f")).alias("page_no", "page"))
    return pages.select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.posexplode(F.split("page", "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def content(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, "\\s+", " "))


def indent(raw: Column) -> Column:
    return F.length(raw) - F.length(F.ltrim(raw))


def segments(raw: Column) -> Column:
    """Runs of text parted by three blanks or more: (start, end, text)."""
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(raw, "\\S+(?: {1,2}\\S+)*", f"{mark}$0{mark}"), mark)
    at = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p))
    return F.filter(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.struct(at(i).alias("start"), (at(i) + F.length(p)).alias("end"), p.alias("text")))), lambda s: s.isNotNull())


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of the sorted values, the last one at most (an aggregate's array)."""
    n = F.size(values)
    return F.get(F.sort_array(values), F.least(n - 1, F.floor(n * F.lit(share)).cast("int")))


def text_column(lines: DataFrame, width: int = 25, least: int = 5) -> DataFrame:
    """(doc_id, page_no, left, right) of the text column: low and high starts and ends of the wide segments."""
    wide = lines.select("doc_id", "page_no", F.explode(segments(F.col("raw"))).alias("s")).where(F.col("s.end") - F.col("s.start") >= width)
    grouped = wide.groupBy("doc_id", "page_no").agg(F.collect_list("s.start").alias("starts"), F.collect_list("s.end").alias("ends"))
    few = F.size("starts") < least
    whole = lines.groupBy("doc_id", "page_no").agg(F.max(F.length("raw")).alias("w"))
    found = grouped.select("doc_id", "page_no", F.when(~few, nearest_rank(F.col("starts"), 0.1)).alias("left"), F.when(~few, nearest_rank(F.col("ends"), 0.9)).alias("right"))
    return whole.join(found, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", "w").alias("right"))


def edges(lines: DataFrame) -> DataFrame:
    """Content lines with their place from the top and from the bottom of the page."""
    page = Window.partitionBy("doc_id", "page_no")
    kept = lines.withColumn("line", content(F.col("raw"))).where("line <> ''")
    return kept.withColumns({"from_top": F.row_number().over(page.orderBy("line_no")), "from_bottom": F.row_number().over(page.orderBy(F.desc("line_no")))})


def running_lines(lines: DataFrame, top: int = EDGE_TOP, bottom: int = EDGE_BOTTOM, least_pages: int = RUNNING_PAGES, least_share: float = RUNNING_SHARE) -> DataFrame:
    """(doc_id, line, pages): lines at the edges of many of a document's pages."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_no").alias("all_pages"))
    edge = edges(lines).where((F.col("from_top") <= top) | (F.col("from_bottom") <= bottom))
    counted = edge.groupBy("doc_id", "line").agg(F.count_distinct("page_no").alias("pages"))
    return counted.join(pages, "doc_id").where((F.col("pages") >= least_pages) & (F.col("pages") >= F.col("all_pages") * least_share)).select("doc_id", "line", "pages")


def strip_edges(lines: DataFrame, running: DataFrame | None = None, top: int = 3, bottom: int = 4, furniture: str = PAGE_NUMBER) -> DataFrame:
    """Content lines without the unbroken runs of furniture at the top and bottom of pages.

    Furniture is a page number, `Page n of m` or a running line. A line goes if it and all lines between it and the
    page's edge are furniture: a running minimum from either edge, instead of a loop.
    """
    kept = edges(lines)
    mark = F.col("line").rlike(furniture) | F.col("line").rlike(PAGE_OF)
    if running is not None:
        kept = kept.join(running.select("doc_id", "line", F.lit(True).alias("is_running")), ["doc_id", "line"], "left")
        mark = mark | F.coalesce("is_running", F.lit(False))
    page = Window.partitionBy("doc_id", "page_no")
    flag = lambda place, most: F.when(mark & (F.col(place) <= most), 1).otherwise(0)
    kept = kept.withColumns({
        "top_run": F.min(flag("from_top", top)).over(page.orderBy("from_top").rowsBetween(Window.unboundedPreceding, 0)),
        "bottom_run": F.min(flag("from_bottom", bottom)).over(page.orderBy("from_bottom").rowsBetween(Window.unboundedPreceding, 0)),
    })
    return kept.where("top_run = 0 and bottom_run = 0").select("doc_id", "page_no", "line_no", "raw", "line")


def blank_islands(lines: DataFrame) -> DataFrame:
    """Content lines with `blanks`, the blank lines before them on the page, and `island`, the number of their run."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    kept = lines.withColumn("line", content(F.col("raw"))).where("line <> ''")
    kept = kept.withColumn("blanks", F.col("line_no") - F.coalesce(F.lag("line_no").over(page), F.lit(0)) - 1)
    return kept.withColumn("island", F.sum(F.when((F.col("blanks") > 0) | (F.lag("line_no").over(page).isNull()), 1).otherwise(0)).over(page))


def modal_spacing(lines: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, page_no, spacing): the usual number of blank lines after unfinished lines of a page.

    Pages with fewer than `least` such gaps take the document's; without any it is 0. Of equally frequent numbers the
    one that comes first in the text wins.
    """
    order = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    rows = blank_islands(lines).withColumns({"prev": F.lag("line").over(order)}).where(F.col("prev").isNotNull() & ~ends_sentence(F.col("prev")))
    at = F.struct("page_no", "line_no")
    mode = lambda df, *by: df.groupBy(*by, "blanks").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).groupBy(*by).agg(F.sum("n").alias("total"), F.min_by("blanks", F.struct(-F.col("n"), "first")).alias("mode"))
    page = mode(rows, "doc_id", "page_no").where(F.col("total") >= least).select("doc_id", "page_no", F.col("mode").alias("page_mode"))
    doc = mode(rows, "doc_id").select("doc_id", F.col("mode").alias("doc_mode"))
    every = lines.select("doc_id", "page_no").distinct()
    return every.join(page, ["doc_id", "page_no"], "left").join(doc, "doc_id", "left").select("doc_id", "page_no", F.coalesce("page_mode", "doc_mode", F.lit(0)).alias("spacing"))


def ends_sentence(line: Column) -> Column:
    """Whether a line ends with a stop (behind which quotes and brackets may close) that is no abbreviation's."""
    bare = F.regexp_replace(line, "[\"”’')\\]]+$", "")
    return bare.rlike("[.?!:;]$") & ~bare.rlike(ABBREVIATION_END)


def by_outline(short: float = 0.8, author: str | None = None) -> Column:
    """Whether a line begins a paragraph in a text whose quotations are indented blocks.

    It does behind a blank line, behind a finished line that is short of the text's width, where it is indented further
    than the line before and that is finished or short, and where it is indented less and that is finished or closes a
    quotation, which is a block of lines indented alike; an author's line behind a finished one begins one too. Clauses
    that end in a semicolon are not finished. For rows with line, indent, width, blanks and full, one document a window.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    before = lambda c, n=1: F.lag(c, n).over(order)
    last, step = F.coalesce(before("line"), F.lit("")), F.col("indent") - before("indent")
    done = ends_sentence(last) & ~last.rlike(";$")
    little = (before("width") < before("full") * short) & (before("page_no") == F.col("page_no"))
    block = F.coalesce((F.abs(before("indent") - before("indent", 2)) <= 1) & (before("indent") >= 4), F.lit(False))
    out = before("line").isNull() | ((F.col("blanks") > 0) & (before("page_no") == F.col("page_no"))) | (done & little)
    out = out | ((step >= 2) & (done | little)) | ((step <= -2) & (done | (block & last.rlike("[\"”’']$"))))
    return out | (done & F.col("line").rlike(author)) if author is not None else out


def paragraphs(lines: DataFrame, indent_by: int = 2, short: float = 0.8, alone: str | None = None, outline: Column | None = None) -> DataFrame:
    """(doc_id, paragraph, text, n_lines) from content lines (doc_id, page_no, line_no, raw).

    A paragraph begins behind a blank line, at a number with a dot, at an indented line behind a finished one, and
    behind a finished line that is short of the page's width; or where `outline` says so, if it is given. Lines that
    match `alone` are paragraphs of their own. A word hyphenated at a line's end is not joined here.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    rows = blank_islands(lines).withColumns({"indent": indent(F.col("raw")), "width": F.length(F.rtrim("raw"))})
    whole = ["doc_id"] if outline is not None else ["doc_id", "page_no"]
    rows = rows.withColumn("full", F.max("width").over(Window.partitionBy(*whole)))
    before = lambda c: F.lag(c).over(order)
    finished = ends_sentence(F.coalesce(before("line"), F.lit(".")))
    starts = (
        before("line").isNull()
        | ((F.col("blanks") > 0) & (before("page_no") == F.col("page_no")))
        | F.col("line").rlike(NUMBERED)
        | (finished & (F.col("indent") >= before("indent") + indent_by))
        | (finished & (before("width") < before("full") * short))
    )
    starts = starts if outline is None else outline
    if alone is not None:
        starts = starts | F.col("line").rlike(alone) | F.coalesce(before("line").rlike(alone), F.lit(False))
    rows = rows.withColumn("starts", F.when(starts, 1).otherwise(0))
    rows = rows.withColumn("paragraph", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = rows.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line"))).alias("l"), F.count(F.lit(1)).alias("n_lines"))
    return grouped.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text"), "n_lines")


def contents_lines(lines: DataFrame, apart: int = 6, least: int = 3) -> DataFrame:
    """Lines of tables of contents: dot-leader lines, at least three, none further than six lines from the last.

    Gaps and islands over the documents' content lines; a heading directly above is taken too.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    rows = lines.withColumn("line", content(F.col("raw"))).where("line <> ''").withColumn("at", F.row_number().over(order)).withColumn("above", F.lag("line").over(order))
    led = rows.where(F.col("line").rlike(LEADER))
    led = led.withColumn("new", F.when(F.col("at") - F.coalesce(F.lag("at").over(order), F.lit(-apart - 1)) > apart, 1).otherwise(0))
    led = led.withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = led.groupBy("doc_id", "cluster").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"), F.min_by("above", "at").alias("above")).where(F.col("n") >= least)
    spans = spans.select("doc_id", F.when(F.col("above").rlike(CONTENTS_HEADING), F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), "hi")
    return rows.join(spans, "doc_id").where("at between lo and hi").select("doc_id", "page_no", "line_no", "line").distinct()


def vocabulary(lines: DataFrame) -> DataFrame:
    """(doc_id, word, n): lower-cased words without their edge punctuation; a line's last word is left out if a hyphen
    ends it, as that may be only the line's end."""
    words = F.filter(F.split(F.col("raw"), "\\s+"), lambda w: w != "")
    whole = F.when(F.element_at(words, -1).endswith("-"), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    rows = lines.withColumn("w", words).where(F.size("w") > 0).select("doc_id", F.explode(whole).alias("token"))
    word = F.lower(F.btrim(F.col("token"), F.lit(EDGE_PUNCTUATION)))
    return rows.select("doc_id", word.alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def next_content(lines: DataFrame) -> DataFrame:
    """Lines with `following`, the next line of the document that is not blank ('' behind the last)."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    line = content(F.col("raw"))
    ahead = F.first(F.when(line != "", line), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumn("following", F.coalesce(ahead, F.lit("")))


# Report pages: running heads, margins; signed pages: stamps; archive pages: cut line tails

# What running heads, printers' marks, margin letters and hanging numbers look like.
REPORTS_HEAD = "S\\S{0,2}P\\S{1,6}\\W{0,3}[Cc]\\S{2,3}R[Tt]\\W{0,3}\\S{0,2}EP|Digital Supreme Court Reports"
VOLUME_HEAD = "(?i)^[\\[(]\\s*\\S{4}\\s*[\\])jJ}]\\s+(?:SUPP\\.?\\s*)?\\S{1,3}\\s+S\\s*\\.\\s*C\\s*\\."
PRINTER_MARK = "(?i)^\\d{1,3}\\s*[-—]\\s*\\d{1,3}\\s+S\\.?\\s*C\\.?\\s+India"
SHORT_HEAD = "S\\s*[.;:,]?\\s*C\\s*[.;:,]?\\s*R\\b\\.?|REPORTS\\b"
TITLE_HEAD = "\\s(?:v|vs|V)\\.?\\s"
AUTHOR_IN_HEAD = "[(\\[][^)\\]]{2,30},\\s*\\S{1,4}\\.?\\s*[)\\]]"
HEAD_PAGE = "^\\S{0,2}\\d{2,4}\\b|\\b\\d{2,4}\\S{0,2}$"
MARGIN_LETTER = "^[^\\w\\s()]{0,2}[A-H0][^\\w\\s()]{0,2}$|^[^\\w\\s()]{1,2}$"
HANGING_NUMBER = "^\\(?[1-9]\\d{0,2}(?:\\.\\d{1,3})*[.)]?$"

# Words that stand by themselves however short they are.
SHORT_WORDS = "a an and any are as at be but by can do for had has he her his if in is it its may no not now of on or our she so the to up was we who".split()


def head_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), "[^a-z]", "")


def repeated_heads(lines: DataFrame, top: int = 4) -> DataFrame:
    """(doc_id, key): letters of title lines that stand more than once among the first lines of pages."""
    keyed = edges(lines).where(F.col("from_top") <= top).select("doc_id", head_key(F.col("line")).alias("key")).where("key <> ''")
    return keyed.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key")


def is_running_head(line: Column, repeated: Column) -> Column:
    """Whether a content line is a report's head: its name, the volume, a page number, a printer's mark, or a title with a
    page number, with an author, or seen on other pages."""
    title = line.rlike(TITLE_HEAD) & (line.rlike(HEAD_PAGE) | line.rlike(AUTHOR_IN_HEAD) | repeated)
    short = line.rlike(SHORT_HEAD) & (F.length(line) < 45)
    return line.rlike(REPORTS_HEAD) | line.rlike(VOLUME_HEAD) | line.rlike(PAGE_NUMBER) | line.rlike(PRINTER_MARK) | short | title


def strip_heads(lines: DataFrame, top: int = 4) -> DataFrame:
    """Content lines without the unbroken run of heads at the top of each page.

    A title that wraps, with the page number on its first line and the `v.` on its second, all capitals, is a head too.
    """
    kept = edges(lines).withColumn("key", head_key(F.col("line")))
    kept = kept.join(repeated_heads(lines, top).withColumn("again", F.lit(True)), ["doc_id", "key"], "left")
    page = Window.partitionBy("doc_id", "page_no").orderBy("from_top")
    after, before = F.lead("line").over(page), F.lag("line").over(page)
    wraps = lambda a, b: a.rlike("\\s\\d{2,4}$|^\\d{2,4}\\s") & ~a.rlike("[a-z]") & ~F.regexp_replace(b, TITLE_HEAD, " ").rlike("[a-z]") & b.rlike(TITLE_HEAD)
    head = is_running_head(F.col("line"), F.coalesce("again", F.lit(False))) | F.coalesce(wraps(F.col("line"), after), F.lit(False)) | F.coalesce(wraps(before, F.col("line")), F.lit(False))
    kept = kept.withColumn("is_head", F.when(head & (F.col("from_top") <= top), 1).otherwise(0))
    kept = kept.withColumn("run", F.min("is_head").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where("run = 0").select("doc_id", "page_no", "line_no", "raw", "line")


def strip_margins(lines: DataFrame) -> DataFrame:
    """Lines whose segments outside the page's text column are gone: margin letters, and notes left and right of it;
    a paragraph number that hangs left of the column stays."""
    placed = lines.join(text_column(lines), ["doc_id", "page_no"])

    def stays(s: Column) -> Column:
        letter = s["text"].rlike(MARGIN_LETTER)
        left = (s["end"] <= F.col("left")) & ~s["text"].rlike(HANGING_NUMBER)
        right = s["start"] >= F.col("right")
        return ~(letter | left | right)

    kept = placed.withColumn("s", F.filter(segments(F.col("raw")), stays))
    text = F.array_join(F.transform("s", lambda s: s["text"]), "   ")
    start = F.when(F.size("s") > 0, F.col("s")[0]["start"] - F.col("left")).otherwise(0)
    return kept.select("doc_id", "page_no", "line_no", F.concat(F.repeat(F.lit(" "), F.greatest(start, F.lit(0))), text).alias("raw"), start.alias("indent"))


def strip_stamps(lines: DataFrame) -> DataFrame:
    """Lines without signature stamps that share lines with the text: a fold over each page's lines in order.

    The states are outside, after the stamp's first line, inside the signer's name, and after the date. The stamp's
    segment goes from its line; a line that held nothing else goes with it, as do blank lines inside the stamp.
    """
    rows = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("l"))

    def step(acc: Column, x: Column) -> Column:
        first = F.regexp_extract(x["raw"], "^\\s*(\\S+(?: {1,2}\\S+)*)", 1)
        state = acc["state"]
        drop = (
            (first == "Signature Not Verified")
            | ((state == 1) & first.startswith("Digitally signed"))
            | ((state == 2) & (first != "") & (first.rlike("^Date:\\s*\\d{4}[.\\-]\\d{2}[.\\-]\\d{2}") | (F.upper(first) == first)))
            | ((state == 3) & (first.rlike("^\\d{1,2}:\\d{2}:\\d{2}(?:\\s*[A-Z]{2,4})?$") | first.startswith("Reason:")))
        )
        after = (
            F.when(first == "Signature Not Verified", 1)
            .when(drop & (state == 1), 2)
            .when(drop & (state == 2), F.when(first.startswith("Date:"), 3).otherwise(2))
            .when(drop & (state == 3), F.when(first.startswith("Reason:"), 0).otherwise(3))
            .when(first != "", 0)
            .otherwise(state)
        )
        raw = F.when(drop, F.regexp_replace(x["raw"], "^(\\s*)\\S+(?: {1,2}\\S+)*", "")).otherwise(x["raw"])
        gone = (drop | (after > 0)) & (F.trim(raw) == "")
        out = F.when(gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(x["line_no"].alias("line_no"), raw.alias("raw")))))
        return F.struct(after.alias("state"), out.alias("out"))

    empty = F.expr("cast(array() as array<struct<line_no:int,raw:string>>)")
    folded = F.aggregate(F.transform("l", lambda x: F.struct(x["line_no"].cast("int").alias("line_no"), x["raw"].alias("raw"))), F.struct(F.lit(0).alias("state"), empty.alias("out")), step)
    return rows.select("doc_id", "page_no", F.explode(folded["out"]).alias("x")).select("doc_id", "page_no", "x.line_no", "x.raw")


def merge_tails(lines: DataFrame) -> DataFrame:
    """Lines whose ends were cut off and printed at the start of the next line, put together again.

    Only where a document's long lines are usually indented by four or more. Tails are short lines at the margin behind
    an indented one, one or several; whether the cut fell inside a word is told by the document's own words.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    rows = lines.withColumns({"i": indent(F.col("raw")), "t": F.trim("raw")})
    usual = rows.where(F.length("t") > 40).groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_no", "line_no")).alias("at")).groupBy("doc_id").agg(F.min_by("i", F.struct(-F.col("n"), "at")).alias("usual"))
    rows = rows.join(usual, "doc_id", "left")
    short = (F.col("t") != "") & (F.col("i") <= 1) & (F.length("t") <= 12) & (F.size(F.split("t", "\\s+")) <= 2)
    longer = F.last(F.when(~short, F.struct("i", "t")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tail = (F.coalesce("usual", F.lit(0)) >= 4) & short & F.coalesce((longer["i"] >= 4) & (longer["t"] != ""), F.lit(False))
    rows = rows.withColumn("tail", tail).withColumn("before", F.lag("raw").over(order))
    a = F.element_at(F.split(F.trim("before"), "\\s+"), -1)
    b = F.split("t", "\\s+")[0]
    rows = rows.withColumns({"head": F.when(F.col("tail"), F.regexp_replace(a, "\\W+$", "")), "end": F.when(F.col("tail"), F.regexp_replace(b, "^\\W+|\\W+$", "")), "cut_after_sign": F.col("tail") & a.rlike("\\W$")})
    words = vocabulary(lines)
    for name, key in (("n_joined", F.lower(F.concat("head", "end"))), ("n_head", F.lower("head")), ("n_end", F.lower("end"))):
        rows = rows.withColumn("word", key).join(words.withColumnRenamed("n", name), ["doc_id", "word"], "left").drop("word")
    digits = lambda c: F.col(c).rlike("^\\d+$")
    few = F.lower("end").isin(SHORT_WORDS)
    count = lambda c: F.coalesce(c, F.lit(0))
    glued = (
        F.when(F.col("cut_after_sign") | (F.col("head") == "") | (F.col("end") == ""), False)
        .when(digits("head") & (digits("end") | F.col("end").isin("st", "nd", "rd", "th")), True)
        .when(count("n_joined") > 0, True)
        .when((digits("head") != digits("end")) | few, False)
        .otherwise(~((count("n_head") > 1) & (count("n_end") > 1)))
    )
    rows = rows.withColumn("add", F.when(F.col("tail"), F.concat(F.when(glued, "").otherwise(" "), F.col("t"))))
    rows = rows.withColumn("whole", F.count_if(~F.col("tail")).over(order))
    nexts = F.collect_list("add").over(Window.partitionBy("doc_id", "whole").orderBy("page_no", "line_no").rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("raw", F.concat("raw", F.array_join(nexts, ""))).where(~F.col("tail")).select("doc_id", "page_no", "line_no", "raw")
