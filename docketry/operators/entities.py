"""The entity table and the resolution of free-text queries to entities.

Entities: case_ord, id, title, year, aliases, citations, cited_by_count (all but the first four may be null).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T
from docketry.operators.similarity import word_join
from docketry.session import settled

NAME_WEIGHT, LEAST_NAME_COVERAGE = 0.3, 0.5
LEAST_SCORE, MARGIN, SUGGESTED = 0.4, 0.1, 5
LONGEST_QUERY = 500
YEAR = r"(?<!\d)(19[5-9]\d|20\d\d)(?!\d)"


def case_names(cases: DataFrame) -> DataFrame:
    """One row per name of a case: title first, then aliases in order, with its distinctive words."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = cases.select("case_ord", "id", F.posexplode(names).alias("name_ord", "name"))
    return rows.withColumn("words", T.distinctive_tokens(F.col("name")))


def case_citations(cases: DataFrame) -> DataFrame:
    """One row per citation of a case, parsed; canonical is null where it cannot be read."""
    rows = cases.select("case_ord", "id", F.posexplode_outer("citations").alias("cit_ord", "text")).where("text is not null")
    c = F.col("citation")
    rows = rows.withColumn("citation", C.parse_citation(F.col("text")))
    return rows.withColumns({"canonical": C.canonical(c), "reporter_key": C.reporter_key(c), "cit_year": c["year"]})


def case_violations(cases: DataFrame, today: dt.date) -> DataFrame:
    """(rule, key, detail) of every rule of the entity table that a row breaks."""
    cits = case_citations(cases)
    pick = lambda df, rule, key, detail: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"), detail.alias("detail"))
    ids = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unread = cits.where("canonical is null")
    odd = cits.where("canonical is not null").withColumn("issues", C.plausibility_issues(F.col("citation"), today)).where(F.size("issues") > 0)
    shared = cits.where("canonical is not null").groupBy("canonical").agg(F.count_distinct("id").alias("n"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("ids")).where("n > 1")
    twice = cits.where("canonical is not null").groupBy("id", "reporter_key").agg(F.count_distinct("canonical").alias("n")).where("n > 1")
    return (
        pick(ids, "unique_id", "id", F.col("n").cast("string"))
        .unionByName(pick(unread, "citation_readable", "id", F.col("text")))
        .unionByName(pick(odd, "citation_plausible", "id", F.array_join("issues", "; ")))
        .unionByName(pick(shared, "citation_of_one_case", "canonical", F.col("ids")))
        .unionByName(pick(twice, "one_citation_per_reporter", "id", F.col("reporter_key")))
    )


def decompose(queries: DataFrame) -> DataFrame:
    """Queries (query_id, query) with their citations, distinctive words outside them, and years."""
    prepared = C.prepare(F.col("query"))
    rows = queries.withColumn("prepared", prepared).withColumn("citations", C.scan(F.col("prepared")))
    # Citations are cut out from the end, so earlier offsets stay right.
    cut = lambda rest, c: F.concat(F.substring(rest, F.lit(1), c["start"]), F.lit(" "), F.substring(rest, c["end"] + 1, F.length(rest)))
    rest = F.aggregate(F.reverse("citations"), F.col("prepared"), cut)
    rows = rows.withColumn("rest", rest)
    return rows.withColumns({"words": T.distinctive_tokens(F.col("rest")), "years": F.transform(F.regexp_extract_all("rest", F.lit(YEAR), 1), lambda y: y.cast("int"))})


def score_names(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, case_ord, id, query_cov, name_cov, score, firm) of every query and case with a word in common.

    Words meet through an inverted index, not query by case: pairs without any alike words would score 0.
    """
    names = case_names(cases).select("case_ord", "id", "name_ord", "words")
    flat = names.groupBy("case_ord", "id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("name_ord", "words")))["words"]).alias("all_words"))
    pool = flat.select("case_ord", F.explode(F.array_distinct(T.with_joined_pairs(F.col("all_words")))).alias("right_word"))
    live = queries.where(F.size("words") > 0).select("query_id", "words")
    asked = live.select("query_id", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "left_word"))
    forward = asked.join(word_join(asked, pool.withColumnRenamed("right_word", "left_word"), "left_word", least=0.0), "left_word").join(pool, "right_word")
    best = forward.groupBy("query_id", "n_words", "case_ord", "pos").agg(F.max("score").alias("s"))
    per = best.groupBy("query_id", "n_words", "case_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("hits"))
    # Words without any match count 0 in the mean; the sum runs from left to right.
    total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["s"])
    per = per.select("query_id", "case_ord", (total / F.col("n_words")).alias("query_cov"), ((F.size("hits") == F.col("n_words")) & F.forall("hits", lambda h: h["s"] >= T.TOKEN_MATCH)).alias("all_words"))
    # The other way: how much of each name the query's words, and joined pairs of them, cover.
    told = live.select("query_id", F.explode(F.array_distinct(T.with_joined_pairs(F.col("words")))).alias("right_word"))
    own = names.select("case_ord", "name_ord", F.size("words").alias("n_name"), F.posexplode("words").alias("pos", "left_word"))
    covered = own.join(word_join(own, told.withColumnRenamed("right_word", "left_word"), "left_word"), "left_word").join(told, "right_word")
    covered = covered.groupBy("query_id", "case_ord", "name_ord", "n_name").agg(F.count_distinct("pos").alias("n"))
    covered = covered.groupBy("query_id", "case_ord").agg(F.max(F.col("n") / F.col("n_name")).alias("name_cov"))
    ids = cases.select("case_ord", "id")
    scored = per.join(covered, ["query_id", "case_ord"], "left").join(ids, "case_ord").withColumn("name_cov", F.coalesce("name_cov", F.lit(0.0)))
    score = (1 - NAME_WEIGHT) * F.col("query_cov") + NAME_WEIGHT * F.col("name_cov")
    return scored.withColumn("score", score).withColumn("firm", F.col("all_words") & (F.col("name_cov") >= LEAST_NAME_COVERAGE))


def resolve_names(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """Status and candidates of queries without citations (decomposed), by window functions over scored pairs."""
    cited = case_citations(cases).groupBy("case_ord").agg(F.collect_set("cit_year").alias("cit_years"))
    years = cases.select("case_ord", "year", F.coalesce("cited_by_count", F.lit(0)).alias("cited")).join(cited, "case_ord", "left")
    years = years.select("case_ord", "cited", F.array_compact(F.array_union(F.array("year"), F.coalesce("cit_years", F.array().cast("array<int>")))).alias("case_years"))
    matches = score_names(queries, cases).where(F.col("score") >= LEAST_SCORE).join(years, "case_ord").join(queries.select("query_id", "years"), "query_id")
    off = (F.size("years") > 0) & ~F.arrays_overlap("years", "case_years")
    matches = matches.withColumn("off_year", off).withColumn("firm", F.col("firm") & ~F.col("off_year"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cited"), "case_ord")
    firm = Window.partitionBy("query_id", "firm").orderBy(F.desc("score"), F.desc("cited"), "case_ord")
    whole = Window.partitionBy("query_id")
    ranked = matches.withColumns({"rank": F.row_number().over(by), "firm_rank": F.row_number().over(firm)})
    ranked = ranked.withColumns({
        "n_firm": F.count_if("firm").over(whole),
        "top": F.max(F.when(F.col("firm") & (F.col("firm_rank") == 1), F.col("score"))).over(whole),
        "second": F.max(F.when(F.col("firm") & (F.col("firm_rank") == 2), F.col("score"))).over(whole),
    })
    clear = (F.col("n_firm") == 1) | (F.col("top") - F.col("second") >= MARGIN)
    status = F.when(F.col("n_firm") == 0, "suggestions").when(clear, "resolved").otherwise("ambiguous")
    shown = (
        F.when(status == "resolved", F.col("firm") & (F.col("firm_rank") == 1))
        .when(status == "ambiguous", F.col("firm") & (F.col("top") - F.col("score") < MARGIN))
        .otherwise(F.col("rank") <= SUGGESTED)
    )
    note = F.when(F.col("off_year"), F.array(F.lit("the year given is not the year of this case"))).otherwise(F.array().cast("array<string>"))
    kept = ranked.withColumn("status", status).where(shown)
    out = kept.groupBy("query_id", "status").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", note.alias("notes")))).alias("c"))
    out = out.withColumn("candidates", F.transform("c", lambda x: F.struct(x["id"].alias("case_id"), F.round(x["score"], 3).alias("score"), x["notes"].alias("notes")))).drop("c")
    return queries.select("query_id").join(out, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def resolve_citations(queries: DataFrame, cases: DataFrame, today: dt.date) -> DataFrame:
    """Status and candidates of queries with citations: rules in order, over the citations' equi-join with the cases."""
    known = case_citations(cases).where("canonical is not null").select("canonical", F.col("id").alias("case_id"), "case_ord").dropDuplicates(["canonical"])
    asked = queries.select("query_id", "words", F.posexplode("citations").alias("pos", "c"))
    asked = asked.withColumns({"canonical": C.canonical(F.col("c")), "odd": F.size(C.plausibility_issues(F.col("c"), today)) > 0})
    joined = asked.join(known, "canonical", "left")
    listed = F.collect_list(F.when(F.col("case_id").isNotNull(), F.struct("pos", "case_id")))
    facts = joined.groupBy("query_id").agg(F.bool_or("odd").alias("odd"), F.bool_or(F.col("case_id").isNull()).alias("unknown"), F.array_distinct(F.transform(F.array_sort(listed), lambda x: x["case_id"])).alias("ids"))
    # What follows reads the facts several times.
    facts = settled(facts.join(queries.select("query_id", "words"), "query_id"), "facts")
    one = facts.where((F.size("words") > 0) & (F.size("ids") == 1))
    fits = score_names(one.select("query_id", "words"), cases).join(one.select("query_id", F.col("ids")[0].alias("id")), ["query_id", "id"]).select("query_id", "firm")
    facts = facts.join(fits, "query_id", "left")
    n = F.size("ids")
    status = (
        F.when(F.col("odd"), "invalid_citation")
        .when(n == 0, "not_found")
        .when(n > 1, "ambiguous")
        .when(F.col("unknown"), "suggestions")
        .when((F.size("words") > 0) & ~F.coalesce("firm", F.lit(False)), "suggestions")
        .otherwise("resolved")
    )
    facts = facts.withColumn("status", status)
    listed = F.transform("ids", lambda i: F.struct(i.alias("case_id"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("notes")))
    return facts.select("query_id", "status", F.when(~F.col("status").isin("invalid_citation", "not_found"), listed).alias("candidates"))


def accepted(queries: DataFrame) -> DataFrame:
    """Queries of 1 to 500 characters."""
    return queries.where(F.length("query").between(1, LONGEST_QUERY))


def rejected(queries: DataFrame) -> DataFrame:
    return queries.where(F.col("query").isNull() | ~F.length("query").between(1, LONGEST_QUERY))


def resolve(queries: DataFrame, cases: DataFrame, today: dt.date) -> DataFrame:
    """(query_id, status, candidates, citations) for every query: by citation if it has one, else by name."""
    parts = settled(decompose(queries).drop("prepared", "rest"), "queries")  # each branch reads it
    cited = parts.where(F.size("citations") > 0)
    named = parts.where((F.size("citations") == 0) & (F.size("words") > 0))
    blank = parts.where((F.size("citations") == 0) & (F.size("words") == 0)).select("query_id", F.lit("not_found").alias("status"))
    out = resolve_citations(cited, cases, today).unionByName(resolve_names(named, cases)).unionByName(blank, allowMissingColumns=True)
    shown = parts.select("query_id", "query", F.transform("citations", C.canonical).alias("citations"))
    return shown.join(out, "query_id").withColumn("candidates", F.coalesce("candidates", F.expr("cast(array() as array<struct<case_id:string,score:double,notes:array<string>>>)")))
