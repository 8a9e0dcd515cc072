"""Consensus of records from several sources about one case.

Records: case_id, rec_ord, source, origin, official, title, decision_date, judges, citations. rec_ord orders the
records of a case; the first one is the anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T

# Words of a judge's name that say nothing about who it is.
HONORIFICS = ["justice", "j", "cji", "hon", "ble", "honble", "mr", "mrs", "ms", "dr", "chief"]
LEAST_ORIGINS = 2


def judge_key(name: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(name), lambda t: (F.length(t) > 1) & ~t.isin(HONORIFICS)))


def same_bench(a: Column, b: Column) -> Column:
    """Whether two arrays of names are one bench: each of a takes the first free one of b whose words include, or are
    included in, its own."""
    within = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    keys = F.transform(b, judge_key)

    def take(state: Column, name: Column) -> Column:
        key = judge_key(name)
        free = state["free"]
        hit = F.array_position(F.transform(free, lambda k: (F.size(k) > 0) & (within(key, k) | within(k, key))), True)
        left = F.concat(F.slice(free, F.lit(1), F.greatest(hit.cast("int") - 1, F.lit(0))), F.slice(free, hit.cast("int") + 1, F.greatest(F.size(free) - hit.cast("int"), F.lit(0))))
        return F.struct((state["ok"] & (hit > 0)).alias("ok"), F.when(hit > 0, left).otherwise(free).alias("free"))

    return (F.size(a) == F.size(b)) & F.aggregate(a, F.struct(F.lit(True).alias("ok"), keys.alias("free")), take)["ok"]


def verify(cases: DataFrame, records: DataFrame) -> DataFrame:
    """(case_id, status, reasons, differences, checked, sources) for each case, whether it has records or not.

    cases: case_id, title, aliases, year, bench_strength, citations. status is verified, partly_verified or
    could_not_verify; differences are (field, values by source).
    """
    none = F.array().cast("array<string>")
    r = records
    grouped = r.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("origin").alias("origins"),
        F.bool_or("official").alias("official"),
        F.array_sort(F.collect_list(F.struct("rec_ord", "source", "title", "decision_date", "judges"))).alias("recs"),
    )
    base = cases.select("case_id", F.concat(F.array("title"), F.coalesce("aliases", none)).alias("names"), "year", "bench_strength").join(grouped, "case_id", "left")
    first = F.col("recs")[0]
    base = base.withColumns({
        "titles_agree": F.forall("recs", lambda x: T.titles_match(first["title"], x["title"])),
        "known": F.exists("names", lambda t: T.titles_match(t, first["title"])),
        "dated": F.filter("recs", lambda x: x["decision_date"].isNotNull()),
        "benches": F.filter("recs", lambda x: F.coalesce(F.size(x["judges"]), F.lit(0)) > 0),
    })
    gate = (
        F.when(F.col("n").isNull(), "no source has this case")
        .when(F.col("origins") < LEAST_ORIGINS, "fewer than two independent sources")
        .when(~F.coalesce("official", F.lit(False)), "no official source")
        .when(~F.col("titles_agree"), "the sources name different cases")
        .when(~F.col("known"), "the sources name a case other than the expected one")
    )
    days = F.array_distinct(F.transform("dated", lambda x: x["decision_date"]))
    off_year = (F.size("dated") > 0) & F.col("year").isNotNull() & F.forall("dated", lambda x: F.year(x["decision_date"]) != F.col("year"))
    bench0 = F.col("benches")[0]["judges"]
    benches_differ = (F.size("benches") >= 2) & ~F.forall("benches", lambda x: same_bench(bench0, x["judges"]))
    strength = F.col("bench_strength").isNotNull() & F.exists("benches", lambda x: F.size(x["judges"]) != F.col("bench_strength"))
    by_source = lambda arr, value: F.map_from_entries(F.transform(arr, lambda x: F.struct(x["source"], value(x))))
    last = lambda arr: F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, i + 2, F.size(arr)), lambda y: y["source"] == x["source"]))
    diff = lambda cond, name, values: F.when(cond, F.struct(F.lit(name).alias("field"), values.alias("values")))
    dates = by_source(last(F.col("dated")), lambda x: x["decision_date"].cast("string"))
    sizes = by_source(last(F.col("benches")), lambda x: F.size(x["judges"]).cast("string"))
    names = by_source(last(F.col("benches")), lambda x: F.array_join(x["judges"], ", "))
    cited = citation_agreement(cases, records)
    full = base.join(cited, "case_id", "left")
    field_diffs = F.array_compact(F.array(
        diff(F.size(days) > 1, "decision_date", dates),
        diff(off_year, "year", F.map_concat(dates, F.create_map(F.lit("our_table"), F.col("year").cast("string")))),
        diff(benches_differ, "bench", names),
        diff(strength, "bench_strength", F.map_concat(sizes, F.create_map(F.lit("our_table"), F.col("bench_strength").cast("string")))),
    ))
    differences = F.concat(field_diffs, F.coalesce("cit_diffs", F.expr("cast(array() as array<struct<field:string,values:map<string,string>>>)")))
    checked = F.concat(F.array_compact(F.array(F.lit("title"), F.when(F.size("dated") >= 2, F.lit("decision_date")), F.when(F.size("benches") >= 2, F.lit("bench")))), F.coalesce("cit_checked", none))
    reasons = F.concat(F.transform(differences, lambda d: F.concat(F.lit("sources differ on "), d["field"])), F.when(F.size("dated") < 2, F.array(F.lit("fewer than two sources give a date"))).otherwise(none), F.coalesce("cit_reasons", none))
    full = full.withColumns({"gate": gate, "differences": differences, "checked": checked, "why": reasons})
    status = F.when(F.col("gate").isNotNull(), "could_not_verify").when(F.size("why") > 0, "partly_verified").otherwise("verified")
    blank = F.col("gate").isNotNull()
    return full.select(
        "case_id",
        status.alias("status"),
        F.when(blank, F.array("gate")).otherwise(F.col("why")).alias("reasons"),
        F.when(~blank, F.col("differences")).alias("differences"),
        F.when(~blank, F.col("checked")).otherwise(none).alias("checked"),
        F.coalesce(F.transform("recs", lambda x: x["source"]), none).alias("sources"),
    )


def citation_agreement(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Per case: citation differences by reporter key, the keys that two sources give, and unreadable citations.

    Of one source's citations under a key the last counts; the case table is a source of its own.
    """
    rows = records.select("case_id", "rec_ord", "source", F.posexplode("citations").alias("pos", "text"))
    rows = rows.withColumn("c", C.parse_citation(F.col("text")))
    unread = rows.where("c is null").groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec_ord", "pos", "text"))), lambda x: F.concat(F.lit("unreadable citation: "), x["text"])).alias("cit_reasons"))
    ours = cases.select("case_id", F.posexplode("citations").alias("pos", "text")).select("case_id", F.lit(-1).alias("rec_ord"), F.lit("our_table").alias("source"), "pos", C.parse_citation(F.col("text")).alias("c")).where("c is not null")
    read = rows.where("c is not null").select("case_id", "rec_ord", "source", "pos", "c").unionByName(ours)
    keyed = read.select("case_id", "source", C.reporter_key(F.col("c")).alias("key"), C.canonical(F.col("c")).alias("canonical"), F.struct("rec_ord", "pos").alias("ord"))
    last = keyed.groupBy("case_id", "key", "source").agg(F.max_by("canonical", "ord").alias("canonical"))
    per = last.groupBy("case_id", "key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical").alias("forms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "canonical")))).alias("values"))
    agreed = per.groupBy("case_id").agg(
        F.transform(F.filter(F.array_sort(F.collect_list(F.struct("key", "n"))), lambda x: x["n"] >= 2), lambda x: F.concat(F.lit("citation "), x["key"])).alias("cit_checked"),
        F.array_compact(F.array_sort(F.collect_list(F.when(F.col("forms") > 1, F.struct("key", F.map_entries("values").alias("entries")))))).alias("d"),
    )
    diffs = F.transform("d", lambda x: F.struct(F.concat(F.lit("citation "), x["key"]).alias("field"), F.map_from_entries(x["entries"]).alias("values")))
    return agreed.withColumn("cit_diffs", diffs).drop("d").join(unread, "case_id", "full")


def lookup(resolutions: DataFrame, verifications: DataFrame) -> DataFrame:
    """Resolutions with the verification of the one case that they found; the others could not be verified."""
    one = F.when(F.col("status") == "resolved", F.col("candidates")[0]["case_id"])
    v = verifications.select(F.col("case_id").alias("found_id"), F.col("status").alias("v_status"), F.col("reasons").alias("v_reasons"))
    out = resolutions.withColumn("found_id", one).join(v, "found_id", "left")
    missing = F.when(F.col("found_id").isNull(), F.lit("the query was not resolved to one case")).otherwise(F.lit("no source has this case"))
    return out.select(*resolutions.columns, F.coalesce("v_status", F.lit("could_not_verify")).alias("verification"), F.coalesce("v_reasons", F.array(missing)).alias("reasons"))
