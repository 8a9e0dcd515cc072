"""Reporter citations in running text, as column expressions.

The grammar is a table, one pattern per reporter, joined into one. Spans are found without a match-position builtin:
every hit is replaced by itself between marks, the text is split at the marks, and running lengths give offsets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import let

# The first year of reports, upper-case courts and series names.
FOUNDED = 1950
FIRST_YEAR = {"SCC": 1969}
UPPER_COURTS = ["SC", "PC", "FC"]
SERIES = {"cri": "Cri", "l&s": "L&S", "tax": "Tax"}

_YEAR = r"(?<!\d)(?:\(\d{4}\)|\d{4})\s*"


REPORTERS = {
    "SCC": _YEAR + r"(?:Supp\s*)?\(?\d{1,2}\)?\s*SCC(?:\s*\((?:Cri|L\s*&\s*S|Tax)\))?\s+\d{1,5}\b",
    "AIR": r"\bAIR\s*\d{4}\s+[A-Za-z]{2,10}\s+\d{1,5}\b",
    "SCR": _YEAR + r"(?:Supp\s*)?(?:\(?\d{1,2}\)?\s*)?SCR\s+\d{1,5}\b",
    "SCALE": r"\(\d{4}\)\s*\d{1,2}\s*SCALE\s+\d{1,5}\b",
    "JT": r"\bJT\s*\d{4}\s*\(\d{1,2}\)\s*SC\s+\d{1,5}\b",
    "INSC": r"(?<!\d)\d{4}\s*INSC\s+\d{1,5}\b",
}
#: At one place at most one reporter's pattern fits, as each names its reporter.
ANY = "(?i)" + "|".join(f"(?:{p})" for p in REPORTERS.values())

_MARK = "\u0001"


def prepare(text: Column) -> Column:
    """Square brackets are round, a dot behind a letter goes, blanks are single."""
    round_ = F.translate(text, "[]", "()")
    return F.trim(F.regexp_replace(F.regexp_replace(round_, "(?<=[A-Za-z])\\.", ""), "\\s+", " "))


def _fields(raw: Column, start: Column) -> Column:
    """The parts of one found citation, with its canonical form and reporter key."""
    part = lambda pattern: F.nullif(F.regexp_extract(raw, "(?i)" + pattern, 1), F.lit(""))
    court, series = part(r"^AIR\s*\d{4}\s+([a-z]+)"), F.lower(F.regexp_replace(part(r"SCC\s*\(([^)]*)\)"), "\\s+", ""))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in SERIES.items() for x in kv)), series)
    first = F.struct(
        start.alias("start"),
        (start + F.length(raw)).alias("end"),
        F.upper(part("(SCC|SCR|SCALE|INSC|AIR|JT)")).alias("reporter"),
        part(r"(\d{4})").cast("int").alias("year"),
        part(r"(\d{1,5})$").cast("int").alias("page"),
        part(r"^\D*\d{4}\D*?(\d{1,2})\)?\s*(?:SCC|SCR|SCALE|SC\s)").cast("int").alias("volume"),
        F.when(F.upper(court).isin(UPPER_COURTS), F.upper(court)).otherwise(F.initcap(court)).alias("court"),
        named.alias("series"),
        raw.rlike("(?i)supp").alias("supplement"),
        raw.alias("raw"),
    )
    kept = ["start", "end", "reporter", "year", "page", "volume", "court", "series", "supplement", "raw"]
    return let(first, lambda c: F.struct(*(c[k].alias(k) for k in kept), _canonical(c).alias("canonical"), _reporter_key(c).alias("reporter_key")))


def scan(prepared: Column) -> Column:
    """Citations of a prepared text in order, none inside another: structs with their span, parts and written form."""
    def spans(pattern: str) -> Column:
        """(start, longest first, raw) of a pattern's matches."""
        pieces = F.split(F.regexp_replace(prepared, pattern, f"{_MARK}$0{_MARK}"), _MARK)
        at = lambda ps, i: F.aggregate(F.slice(ps, F.lit(1), i), F.lit(0), lambda s, p: s + F.length(p))
        span = lambda ps: lambda p, i: F.when(i % 2 == 1, F.struct(at(ps, i).alias("start"), (-F.length(p)).alias("back"), p.alias("raw")))
        return let(pieces, lambda ps: F.filter(F.transform(ps, span(ps)), lambda x: x.isNotNull()))

    def apart(found: Column) -> Column:
        """In order, without those that begin inside one that is kept."""
        kept = lambda k, x: F.coalesce(F.element_at(k, -1)["start"] - F.element_at(k, -1)["back"], F.lit(0)) <= x["start"]
        step = lambda k, x: F.when((F.size(k) == 0) | kept(k, x), F.concat(k, F.array(x))).otherwise(k)
        return F.aggregate(F.array_sort(found), F.expr("cast(array() as array<struct<start:int,back:int,raw:string>>)"), step)

    # A match of one pattern inside that of another matters only where there are several.
    every = F.concat(*(spans("(?i)" + p) for p in REPORTERS.values()))
    found = F.when(F.regexp_count(prepared, F.lit(ANY)) > 1, apart(every)).otherwise(spans(ANY))
    return F.transform(found, lambda x: _fields(x["raw"], x["start"]))


def find_citations(text: Column) -> Column:
    return scan(prepare(text))


def parse_citation(text: Column) -> Column:
    """The citation that the whole text is, or null."""
    one = lambda p: (F.size(p["found"]) == 1) & (p["found"][0]["start"] == 0) & (p["found"][0]["end"] == F.length(p["whole"]))
    return let(prepare(text), lambda whole: let(F.struct(scan(whole).alias("found"), whole.alias("whole")), lambda p: F.when(one(p), F.get(p["found"], F.lit(0)))))


def _canonical(c: Column) -> Column:
    """The one way to write a citation."""
    year, volume, page = c["year"].cast("string"), c["volume"].cast("string"), c["page"].cast("string")
    series = F.when(c["series"].isNotNull(), F.concat(F.lit(" ("), c["series"], F.lit(")"))).otherwise("")
    some = F.coalesce(c["volume"], F.lit(0)) > 0
    scr = F.when(c["supplement"] & some, F.concat(F.lit("Supp ("), volume, F.lit(") "))).when(c["supplement"], "Supp ").when(some, F.concat(volume, F.lit(" "))).otherwise("")
    scc = F.when(c["supplement"], F.concat(year, F.lit(" Supp ("), volume, F.lit(") SCC"))).otherwise(F.concat(F.lit("("), year, F.lit(") "), volume, F.lit(" SCC")))
    return (
        F.when(c["reporter"] == "SCC", F.concat(scc, series, F.lit(" "), page))
        .when(c["reporter"] == "AIR", F.concat(F.lit("AIR "), year, F.lit(" "), c["court"], F.lit(" "), page))
        .when(c["reporter"] == "SCR", F.concat(F.lit("["), year, F.lit("] "), scr, F.lit("SCR "), page))
        .when(c["reporter"] == "SCALE", F.concat(F.lit("("), year, F.lit(") "), volume, F.lit(" SCALE "), page))
        .when(c["reporter"] == "JT", F.concat(F.lit("JT "), year, F.lit(" ("), volume, F.lit(") SC "), page))
        .when(c["reporter"] == "INSC", F.concat(year, F.lit(" INSC "), page))
    )


def _reporter_key(c: Column) -> Column:
    """What a matter has at most one citation of."""
    return F.when(c["series"].isNotNull(), F.concat(c["reporter"], F.lit(" ("), c["series"], F.lit(")"))).when(c["reporter"] == "AIR", F.concat(F.lit("AIR "), c["court"])).otherwise(c["reporter"])


def canonical(c: Column) -> Column:
    return c["canonical"]


def reporter_key(c: Column) -> Column:
    return c["reporter_key"]


def plausibility_issues(c: Column, today: dt.date) -> Column:
    """Why the citation cannot be of a real report, in fixed order; empty if it can."""
    first = F.lit(FOUNDED)
    for name, year in FIRST_YEAR.items():
        first = F.when(c["reporter"] == name, year).otherwise(first)
    name = F.when(c["reporter"] == "AIR", "AIR SC").otherwise(c["reporter"])
    supreme = (c["reporter"] != "AIR") | (c["court"] == "SC")
    return F.array_compact(
        F.array(
            F.when(c["year"] > today.year, F.concat(c["year"].cast("string"), F.lit(" is in the future"))),
            F.when(supreme & (c["year"] < first), F.concat(name, F.lit(" has no Supreme Court reports before "), first.cast("string"))),
            F.when(c["page"] == 0, F.lit("page number cannot be 0")),
            F.when(c["volume"] == 0, F.lit("volume number cannot be 0")),
        )
    )
