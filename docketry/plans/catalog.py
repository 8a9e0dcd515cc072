"""The named queries of the engine and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T
from docketry.operators import citator, constraints, entities, evals, grounding, layout, profiles, segment, similarity
from docketry.plans import literals
from docketry.session import shared_folder, ship, table
from docketry.sources.tables import json_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = dt.date(2026, 1, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_NORM = r"trim(regexp_replace(replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = f"list_filter(string_split({_NORM}, ' '), lambda t: t <> '')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TELLING = f"list_filter({_TOKENS}, lambda t: length(t) > 2 and not regexp_full_match(t, '[0-9]+') and t not in ({_STOP}))"
_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_JACCARD = "(len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))"
_SKELETON_1 = "translate(replace({0}, 'w', 'v'), 'aeiouyh', '')"
_SKELETON = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: i = 1 or c <> substr({0}, i - 1, 1)), '')".format(_SKELETON_1)
_LINES = "select doc_id, source, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents"
_CONTENT = r"trim(regexp_replace(raw, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


# Text scalars


@query(f"select doc_id, {_NORM.format('text')} as normalized from documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query(f"select doc_id, len(w)::int as n_tokens, array_to_string(w, ' ') as words from (select doc_id, {_TELLING.format('text')} as w from documents)")
def distinctive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.distinctive_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("words"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct()


_NAME_GRAMS = f"select p_name, list_distinct(flatten(list_transform({_TOKENS.format('p_name')}, lambda w: {_GRAMS.format('w')}))) as g from (select distinct p_name from part)"


@query(f"select p_name, len(g)::int as n_trigrams, array_to_string(list_sort(g), '|') as trigrams from ({_NAME_GRAMS})")
def trigram_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir).withColumn("g", T.trigrams(F.col("p_name")))
    return rows.select("p_name", F.size("g").alias("n_trigrams"), F.array_join(F.array_sort("g"), "|").alias("trigrams"))


@query(f"""with g as ({_NAME_GRAMS}), p as (
  select a.p_name as left_key, b.p_name as right_key, len(list_intersect(a.g, b.g)) as shared, len(a.g) as na, len(b.g) as nb from g a, g b)
select left_key, right_key, shared::bigint as shared, shared / (na + nb - shared) as similarity from p where shared > 0""")
def trigram_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    return similarity.trigram_join(names, names, "p_name", "p_name")


_WORDS = f"select distinct unnest({_TOKENS.format('p_name')}) as word from part"


@query(f"select skeleton, count(*) as n_words, string_agg(word, ',' order by word) as words from (select word, {_SKELETON.format('word')} as skeleton from ({_WORDS})) group by skeleton")
def skeleton_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _names(spark, sf_dir).select(F.explode(T.tokens(F.col("p_name"))).alias("word")).distinct()
    return words.groupBy(T.skeleton(F.col("word")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))


_WORD_SCORES = f"""w as ({_WORDS}), s as (select word, {_GRAMS.format('word')} as g, {_SKELETON.format('word')} as k from w),
pairs as (select a.word as left_word, b.word as right_word, {_JACCARD.format('a.g', 'b.g')} as plain, a.k = b.k and length(a.k) >= 3 as alike from s a, s b),
scores as (select left_word, right_word, case when plain < 0.6 and alike then 0.6 else plain end as score from pairs)"""


@query(f"with {_WORD_SCORES} select * from scores where score >= 0.45")
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _names(spark, sf_dir).select(F.explode(T.tokens(F.col("p_name"))).alias("word")).distinct()
    return similarity.word_join(words, words)


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' part names as somebody might type them: the first vowel of each name is left out."""
    names = _names(spark, sf_dir)
    return names.select("p_name", F.regexp_replace("p_name", "^([^aeiou]*)[aeiou]", "$1").alias("typed"))


_COVER = f"""with n as (select distinct p_name, {_TELLING.format('p_name')} as w from part),
t as (select p_name as q, {_TELLING.format("regexp_replace(p_name, '^([^aeiou]*)[aeiou]', chr(92) || '1')")} as w from (select distinct p_name from part)),
src as (select q, unnest(w) as s, generate_subscripts(w, 1) as pos, len(w) as n from t),
pool as (select p_name, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) as t from n),
sw as (select distinct s as word from src), tw as (select distinct t as word from pool),
sg as (select word, {_GRAMS.format('word')} as g, {_SKELETON.format('word')} as k from sw), tg as (select word, {_GRAMS.format('word')} as g, {_SKELETON.format('word')} as k from tw),
pairs as (select a.word as s, b.word as t, {_JACCARD.format('a.g', 'b.g')} as plain, a.k = b.k and length(a.k) >= 3 as alike from sg a, tg b),
sc as (select s, t, case when plain < 0.6 and alike then 0.6 else plain end as score from pairs),
best as (select q, p_name, pos, max(score) as m, any_value(src.n) as n from src, pool, sc where src.s = sc.s and pool.t = sc.t group by q, p_name, pos)"""


@query(_COVER + " select q as typed_of, p_name, sum(case when m >= 0.45 then 1 else 0 end)::int as hits, sum(case when m >= 0.45 then 1 else 0 end) / max(n) as coverage from best group by q, p_name")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed_names(spark, sf_dir).select(F.col("p_name").alias("typed_of"), T.distinctive_tokens(F.col("typed")).alias("q")).where(F.size("q") > 0)
    names = _names(spark, sf_dir).withColumn("w", T.distinctive_tokens(F.col("p_name")))
    pairs = typed.join(F.broadcast(names))  # both sides are the part names' vocabulary, a few dozen rows at any scale
    scores = pairs.withColumn("hits", F.size(F.filter(T.best_token_scores(F.col("q"), F.col("w")), lambda s: s >= T.TOKEN_MATCH)))
    return scores.select("typed_of", "p_name", "hits", (F.col("hits") / F.size("q")).alias("coverage"))


@query(_COVER + """, c as (select q as typed_of, p_name, sum(case when m >= 0.45 then 1 else 0 end) / max(n) as coverage from best group by q, p_name)
select typed_of, p_name from c where coverage >= 0.8""")
def titles_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed_names(spark, sf_dir).select(F.col("p_name").alias("typed_of"), "typed")
    return typed.join(F.broadcast(_names(spark, sf_dir)), T.titles_match(F.col("typed"), F.col("p_name"))).select("typed_of", "p_name")


# Entities


def _part_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("case_ord"), F.count(F.lit(1)).cast("int").alias("cited_by_count"))
    return rows.select("case_ord", F.col("p_name").alias("id"), F.col("p_name").alias("title"), F.lit(2000).alias("year"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("array<string>").alias("citations"), "cited_by_count")


def _part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed_names(spark, sf_dir)
    rows = typed.select(F.col("p_name").alias("query_id"), F.col("typed").alias("query"))
    first = typed.select(F.concat(F.lit("1:"), F.split("p_name", " ")[0]).alias("query_id"), F.split("p_name", " ")[0].alias("query")).distinct()
    return rows.unionByName(first)


_RESOLVE = f"""with c as (select p_name as id, min(p_partkey) as ord, count(*) as cited, any_value({_TELLING.format('p_name')}) as w from part group by p_name),
q0 as (select p_name as query_id, regexp_replace(p_name, '^([^aeiou]*)[aeiou]', chr(92) || '1') as query from (select distinct p_name from part)
  union all select distinct '1:' || string_split(p_name, ' ')[1], string_split(p_name, ' ')[1] from part),
q as (select query_id, {_TELLING.format('query')} as w from q0),
qw as (select query_id, unnest(w) as s, generate_subscripts(w, 1) as pos, len(w) as n from q),
cw as (select id, unnest(w) as t, generate_subscripts(w, 1) as pos, len(w) as n from c),
cp as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) as t from c),
qp as (select query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) as t from q),
words as (select distinct s as word from qw union select t from cp union select t from qp union select t from cw),
g as (select word, {_GRAMS.format('word')} as g, {_SKELETON.format('word')} as k from words),
p as (select a.word as s, b.word as t, {_JACCARD.format('a.g', 'b.g')} as plain, a.k = b.k and length(a.k) >= 3 as alike from g a, g b),
sc as (select s, t, case when plain < 0.6 and alike then 0.6 else plain end as score from p),
fw as (select query_id, id, pos, max(score) as m, any_value(n) as n from qw join sc on qw.s = sc.s join cp on cp.t = sc.t group by query_id, id, pos),
f as (select query_id, id, list_sum(list(m order by pos)) / max(n) as query_cov, bool_and(m >= 0.45) as all_words from fw group by query_id, id),
bw as (select query_id, id, pos, max(score) as m, any_value(n) as n from cw join sc on cw.t = sc.s join qp on qp.t = sc.t group by query_id, id, pos),
b as (select query_id, id, sum(case when m >= 0.45 then 1 else 0 end) / max(n) as name_cov from bw group by query_id, id),
m as (select f.query_id, f.id, c.ord, c.cited, 0.7::double * query_cov + 0.3::double * name_cov as score, all_words and name_cov >= 0.5 as firm
  from f join b on f.query_id = b.query_id and f.id = b.id join c on c.id = f.id),
k as (select * from m where score >= 0.4),
r as (select *, row_number() over (partition by query_id order by score desc, cited desc, ord) as rank,
  row_number() over (partition by query_id, firm order by score desc, cited desc, ord) as firm_rank, count(case when firm then 1 end) over (partition by query_id) as n_firm from k),
s as (select *, max(case when firm and firm_rank = 1 then score end) over (partition by query_id) as top, max(case when firm and firm_rank = 2 then score end) over (partition by query_id) as second from r),
d as (select *, case when n_firm = 0 then 'suggestions' when n_firm = 1 or top - second >= 0.1 then 'resolved' else 'ambiguous' end as status from s),
shown as (select * from d where case status when 'resolved' then firm and firm_rank = 1 when 'ambiguous' then firm and top - score < 0.1 else rank <= 5 end)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve_names(entities.decompose(_part_queries(spark, sf_dir)).cache(), _part_cases(spark, sf_dir))


@query(_RESOLVE + " select q.query_id, coalesce(any_value(status), 'not_found') as status, coalesce(string_agg(id, '|' order by rank), '') as candidates from q left join shown on q.query_id = shown.query_id group by q.query_id")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("query_id", "status", F.coalesce(F.array_join(F.transform("candidates", lambda c: c["case_id"]), "|"), F.lit("")).alias("candidates"))


@query(_RESOLVE + " select query_id, id, rank::int as rank, round(score, 6) as score from r where rank <= 5")
def resolve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cases = _part_cases(spark, sf_dir)
    scored = entities.score_names(entities.decompose(_part_queries(spark, sf_dir)).cache(), cases).where(F.col("score") >= entities.LEAST_SCORE).join(cases.select("case_ord", F.col("cited_by_count").alias("cited")), "case_ord")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("cited"), "case_ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= entities.SUGGESTED).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(_RESOLVE + " select status, count(*) as n_queries from (select q.query_id, coalesce(any_value(status), 'not_found') as status from q left join shown on q.query_id = shown.query_id group by q.query_id) group by status")
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n_queries"))


def _cited_as(key: str, reporter: str) -> Column:
    """A citation that no other key below 10^14 has: a page has five digits at most, so the court tells the rest."""
    k = F.col(key).cast("long")
    court = F.concat(F.lit("X"), F.translate(F.floor(k / 99999).cast("string"), "0123456789", "abcdefghij"))
    return F.format_string(f"{reporter} %d %s %d", F.lit(1960) + k % 50, court, k % 99999 + 1)


def _cited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the parts as cases, each with a citation that its key makes."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").withColumn("year", (1960 + F.col("p_partkey") % 50).cast("int"))
    none = F.lit(None)
    return rows.select(F.col("p_partkey").alias("case_ord"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), "year", none.cast("array<string>").alias("aliases"), F.array(_cited_as("p_partkey", "AIR")).alias("citations"), F.lit(0).alias("cited_by_count"))


def _citing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, a query that cites the parts of its first two lines, in another spelling."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_partkey > 0")
    lines = lines.select(F.col("l_orderkey").cast("string").alias("query_id"), F.struct("l_linenumber", "l_partkey", _cited_as("l_partkey", "A.I.R. ").alias("c")).alias("s"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["c"]), "; ").alias("query"))


@query("""with l as (select l_orderkey::varchar as query_id, l_linenumber as line, l_partkey as k from lineitem where l_linenumber <= 2 and l_partkey > 0),
c as (select l.*, p_partkey as id from l left join part on p_partkey = k and p_partkey % 3 <> 0),
i as (select query_id, id, row_number() over (partition by query_id order by min(line), id) as pos from c where id is not null group by query_id, id),
n as (select query_id, count(*) as n, string_agg(id::varchar, ',' order by pos) as ids from i group by query_id),
u as (select query_id, bool_or(id is null) as unknown from c group by query_id)
select u.query_id, case when n is null then 'not_found' when n > 1 then 'ambiguous' when unknown then 'suggestions' else 'resolved' end as status, coalesce(ids, '') as found from u left join n on u.query_id = n.query_id""")
def citation_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that hold citations, scanned, canonicalised and looked up, decided per query in order of rules."""
    out = entities.resolve(entities.accepted(_citing_orders(spark, sf_dir)), _cited_parts(spark, sf_dir), TODAY)
    return out.select("query_id", "status", F.array_join(F.transform("candidates", lambda c: c["case_id"]), ",").alias("found"))


@query(literals.values_sql(literals.CITATIONS, ["text", "canonical", "reporter_key", "issues"]))
def citation_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c[0],) for c in literals.CITATIONS], "text string").withColumn("c", C.parse_citation(F.col("text")))
    c = F.col("c")
    issues = F.when(c.isNotNull(), F.array_join(C.plausibility_issues(c, TODAY), "; "))
    return rows.select("text", C.canonical(c).alias("canonical"), C.reporter_key(c).alias("reporter_key"), issues.alias("issues"))


@query(literals.values_sql(literals.FOUND, ["text", "found"]))
def citation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c[0],) for c in literals.FOUND], "text string")
    return rows.select("text", F.array_join(F.transform(C.find_citations(F.col("text")), C.canonical), " | ").alias("found"))


@query()
def citations_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each pattern of the grammar holds its reporter's name, so this leaves out no citation.
    rows = table(spark, sf_dir, "documents").where(C.prepare(F.col("text")).rlike("(?i)" + "|".join(C.REPORTERS)))
    return rows.select("doc_id", F.size(C.find_citations(F.col("text"))).alias("n_citations")).where("n_citations > 0")


# Several sources


_COPIES = "select md5(text) as text_key, doc_id, source, lang, n_chars from documents"


def _witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source", "lang", "n_chars")


@query(f"""select text_key, count(*) as n_records, count(distinct source) as n_origins, bool_or(source = 'src0') as has_official,
case when count(distinct source) < 2 then 'fewer than two independent sources' when not bool_or(source = 'src0') then 'no official source' else '' end as reason
from ({_COPIES}) group by text_key""")
def origin_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.identity_gate(_witnesses(spark, sf_dir), "text_key", "source", F.col("source") == "src0")


@query(f"""with l as (select text_key, source, arg_max(lang, doc_id) as value from ({_COPIES}) where lang is not null group by text_key, source)
select text_key, count(*) as n_sources, count(distinct value) as n_values, string_agg(source || '=' || value, ',' order by source || '=' || value) as values_by_source, count(distinct value) = 1 as agrees from l group by text_key""")
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.field_agreement(_witnesses(spark, sf_dir), "text_key", "source", "lang", "doc_id")


@query("""with r as (select l_orderkey::varchar as case_id, l_suppkey % 3 as origin, date_trunc('year', l_shipdate)::date as d from lineitem where l_linenumber <= 3),
g as (select case_id, count(distinct origin) as origins, bool_or(origin = 0) as official, count(distinct d) as days, bool_and(year(d) <> 1998) as off_year from r group by case_id),
o as (select o_orderkey::varchar as case_id from orders)
select o.case_id, case when origins is null or origins < 2 or not official then 'could_not_verify' when days > 1 or off_year then 'partly_verified' else 'verified' end as status,
case when origins is null then 'no source has this case' when origins < 2 then 'fewer than two independent sources' when not official then 'no official source'
  else concat_ws('; ', case when days > 1 then 'sources differ on decision_date' end, case when off_year then 'sources differ on year' end) end as reasons,
case when origins >= 2 and official then 'title,decision_date' else '' end as checked from o left join g on o.case_id = g.case_id""")
def verify_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of 1998, and their first lines as what several sources say of them."""
    from docketry.operators import consensus

    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    strings = F.lit(None).cast("array<string>")
    cases = orders.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit("Harbour Works").alias("title"), strings.alias("aliases"), F.lit(1998).alias("year"), F.lit(None).cast("int").alias("bench_strength"), strings.alias("citations"))
    origin = F.col("l_suppkey") % 3
    records = lines.select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("rec_ord"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("source"), origin.cast("string").alias("origin"), (origin == 0).alias("official"), F.lit("HARBOUR WORKS LTD.").alias("title"), F.trunc("l_shipdate", "year").alias("decision_date"), strings.alias("judges"), strings.alias("citations"))
    out = consensus.verify(cases, records)
    return out.select("case_id", "status", F.array_join("reasons", "; ").alias("reasons"), F.array_join("checked", ",").alias("checked"))


@query(literals.values_sql([(c, s, r) for c, s, r in literals.VERIFIED], ["case_id", "status", "reasons"]))
def source_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.operators import consensus

    out = consensus.verify(literals.cases(spark), literals.records(spark))
    return out.select("case_id", "status", F.array_join("reasons", "; ").alias("reasons"))


# Layout: the documents of a source are the pages of one long document


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


_EDGES = f"""l as (select source as doc_id, doc_id as page_no, line_no, raw, {_CONTENT} as line from ({_LINES})),
e as (select *, row_number() over (partition by doc_id, page_no order by line_no) as from_top, row_number() over (partition by doc_id, page_no order by line_no desc) as from_bottom from l where line <> ''),
n as (select doc_id, count(distinct page_no) as pages from l group by doc_id),
run as (select e.doc_id, line, count(distinct page_no) as pages from e where from_top <= 2 or from_bottom <= 3 group by e.doc_id, line),
running as (select run.doc_id, line, run.pages from run join n on run.doc_id = n.doc_id where run.pages >= 3 and run.pages >= n.pages * {{share}})"""
_SHARE = 0.05


@query(f"with {_EDGES.format(share=_SHARE)} select doc_id, line, pages from running")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.running_lines(_lines(spark, sf_dir), least_share=_SHARE)


@query(f"""with {_EDGES.format(share=_SHARE)},
f as (select e.*, regexp_matches(e.line, '^[^\\w\\s]{{0,2}}\\s*\\d{{1,4}}\\s*[^\\w\\s]{{0,2}}$') or regexp_matches(e.line, '(?i)\\bPage\\s+\\d+(?:\\s+of\\s+\\d+)?\\s*$') or running.line is not null as f
  from e left join running on e.doc_id = running.doc_id and e.line = running.line),
r as (select *, min(case when f and from_top <= 3 then 1 else 0 end) over (partition by doc_id, page_no order by from_top) as t, min(case when f and from_bottom <= 4 then 1 else 0 end) over (partition by doc_id, page_no order by from_bottom) as b from f)
select doc_id, page_no, line_no::int as line_no, line from r where t = 0 and b = 0""")
def edge_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.strip_edges(lines, layout.running_lines(lines, least_share=_SHARE)).select("doc_id", "page_no", "line_no", "line")


@query(f"""with l as (select source as doc_id, doc_id as page_no, line_no, {_CONTENT} as line from ({_LINES})), k as (select * from l where line <> ''),
b as (select *, lag(line_no) over w as p, line_no - coalesce(lag(line_no) over w, 0) - 1 as blanks from k window w as (partition by doc_id, page_no order by line_no))
select doc_id, page_no, line_no::int as line_no, blanks::int as blanks, sum(case when blanks > 0 or p is null then 1 else 0 end) over (partition by doc_id, page_no order by line_no rows unbounded preceding)::bigint as island from b""")
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.blank_islands(_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", F.col("blanks").cast("int").alias("blanks"), "island")


@query(f"""with l as (select doc_id, list_sort(list(length(raw))) as v from ({_LINES}) group by doc_id)
select doc_id, v[least(len(v) - 1, floor(len(v) * 0.1::double)::int) + 1]::int as low, v[least(len(v) - 1, floor(len(v) * 0.9::double)::int) + 1]::int as high from l""")
def percentile_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy(F.col("page_no").alias("doc_id")).agg(F.collect_list(F.length("raw")).alias("v"))
    return rows.select("doc_id", layout.nearest_rank(F.col("v"), 0.1).alias("low"), layout.nearest_rank(F.col("v"), 0.9).alias("high"))


@query(rf"""with l as (select source as doc_id, doc_id as page_no, line_no, {_CONTENT} as line from ({_LINES})), k as (select * from l where line <> ''),
b as (select *, lag(line) over w as prev, line_no - coalesce(lag(line_no) over w, 0) - 1 as blanks from k window w as (partition by doc_id, page_no order by line_no)),
e as (select *, regexp_replace(prev, '["”’'')\]]+$', '') as bare from b where prev is not null),
r as (select * from e where not (regexp_matches(bare, '[.?!:;]$') and not regexp_matches(bare, '{layout.ABBREVIATION_END}'))),
p1 as (select doc_id, page_no, blanks, count(*) as n, min(line_no) as first from r group by all),
p2 as (select *, sum(n) over (partition by doc_id, page_no) as total, row_number() over (partition by doc_id, page_no order by n desc, first) as k from p1),
d1 as (select doc_id, blanks, count(*) as n, min(page_no * 100000000::bigint + line_no) as first from r group by all),
d2 as (select *, row_number() over (partition by doc_id order by n desc, first) as k from d1)
select v.doc_id, v.page_no, coalesce(p2.blanks, d2.blanks, 0)::int as spacing from (select distinct doc_id, page_no from l) v
left join p2 on p2.doc_id = v.doc_id and p2.page_no = v.page_no and p2.k = 1 and p2.total >= 4 left join d2 on d2.doc_id = v.doc_id and d2.k = 1""")
def modal_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.modal_spacing(_lines(spark, sf_dir))
    return out.select("doc_id", "page_no", F.col("spacing").cast("int").alias("spacing"))


_EDGE_PUNCTUATION = r"""[.,;:!?"''“”‘’()\[\]{}*]+"""


@query(rf"""with t as (select doc_id, list_filter(regexp_split_to_array(raw, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from ({_LINES})),
u as (select doc_id, unnest(case when len(w) > 0 and w[-1] like '%-' then w[:-2] else w end) as token from t),
v as (select doc_id, lower(regexp_replace(regexp_replace(token, '^{_EDGE_PUNCTUATION}', ''), '{_EDGE_PUNCTUATION}$', '')) as word from u)
select doc_id, word, count(*) as n from v where word <> '' group by doc_id, word""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    return layout.vocabulary(rows)


@query(rf"""with t as (select doc_id, list_filter(regexp_split_to_array(raw, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') as w from ({_LINES})),
u as (select doc_id, lower(regexp_replace(regexp_replace(unnest(w), '^{_EDGE_PUNCTUATION}', ''), '{_EDGE_PUNCTUATION}$', '')) as word from t),
v as (select word, count(*) as n, count(distinct doc_id) as n_docs from u where word <> '' group by word),
h as (select doc_id, word, string_split(word, '-')[1] as head, string_split(word, '-')[2] as tail from (select distinct doc_id, word from u) where regexp_full_match(word, '[^-]+-[^-]+'))
select h.doc_id, h.word, coalesce(j.n, 0)::bigint as n_joined, coalesce(a.n, 0)::bigint as n_head, coalesce(b.n, 0)::bigint as n_tail
from h left join v j on j.word = head || tail left join v a on a.word = head left join v b on b.word = tail""")
def hyphen_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hyphenated word, how often its joined form and its halves occur in the corpus."""
    edge = "[.,;:!?\"'“”‘’()\\[\\]{}*]+"
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\\s+")).alias("t")).select("doc_id", F.lower(F.regexp_replace("t", f"^{edge}|{edge}$", "")).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    split = words.where(F.col("word").rlike("^[^-]+-[^-]+$")).distinct().withColumn("parts", F.split("word", "-"))
    split = split.select("doc_id", "word", F.concat(F.col("parts")[0], F.col("parts")[1]).alias("joined"), F.col("parts")[0].alias("head"), F.col("parts")[1].alias("tail"))
    for part in ("joined", "head", "tail"):
        split = split.join(counts.select(F.col("word").alias(part), F.col("n").alias(f"n_{part}")), part, "left")
    return split.select("doc_id", "word", *(F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}") for p in ("joined", "head", "tail")))


_CAPS, _LETTERED = (p.pattern.replace("'", "''") for p in (segment.CAPS, segment.LETTERED))


@query(f"""with b as (select doc_id, line_no, trim(substr(regexp_replace({_CONTENT}, '[.,;:]+|[^ -~]+', '', 'g'), 1, 70)) as line from ({_LINES})),
l as (select doc_id, line_no, case when line_no % 3 = 0 then upper(line) when line_no % 3 = 1 then '(' || chr((97 + line_no % 26)::int) || ') ' || line else line end as line from b)
select doc_id, line_no::int as line_no, line from l where (length(line) <= 80 and regexp_full_match(line, '{_CAPS}')) or regexp_full_match(line, '{_LETTERED}')""")
def caps_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of the documents' lines, a third in capitals and a third lettered: those that are headings."""
    line, number = F.trim(F.substring(F.regexp_replace(layout.content(F.col("raw")), "[.,;:]+|[^ -~]+", ""), 1, 70)), F.col("line_no")
    made = F.when(number % 3 == 0, F.upper(line)).when(number % 3 == 1, F.concat(F.lit("("), F.chr(97 + number % 26), F.lit(") "), line)).otherwise(line)
    rows = _lines(spark, sf_dir).select(F.col("page_no").alias("doc_id"), "line_no", made.alias("line"))
    return rows.where(segment.heading(F.col("line")))


@query(f"""with l as (select doc_id, line_no, {_CONTENT} as line from ({_LINES}))
select doc_id, line_no::int as line_no, coalesce(lead(nullif(line, '') ignore nulls) over (partition by doc_id order by line_no), '') as following from l""")
def next_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)
    return layout.next_content(rows).select("doc_id", "line_no", "following")


@query()
def paragraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return layout.paragraphs(layout.page_lines(docs))


def _cleaned_sql(text: str) -> str:
    for old, new in (layout.LIGATURES | layout.DASH_ESCAPES).items():
        text = f"replace({text}, '{old}', '{new}')"
    return f"regexp_replace({text}, '{layout.CONTROL}', '', 'g')"


@query(f"""with t as (select doc_id, string_split({_cleaned_sql("replace(replace(replace(text, '. ', '.' || chr(12)), chr(13) || chr(10), chr(10)), chr(13), chr(10))")}, chr(12)) as pages from documents),
p as (select doc_id, unnest(pages) as page, generate_subscripts(pages, 1) as page_no from t),
l as (select doc_id, page_no, string_split(page, chr(10)) as lines from p)
select doc_id, page_no::int as page_no, generate_subscripts(lines, 1)::int as line_no, unnest(lines) as raw from l""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as if a form feed stood behind each sentence."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(". "), F.lit(".\f")))
    return layout.page_lines(docs)


# Grounding


_QUOTED = r"regexp_extract_all(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '“', '\"'), '”', '\"'), '‘', ''''), '’', ''''), '–', '-'), '—', '-'), chr(173), ''), '…', '...'), '[ \t\n\x0B\f\r]+', ' ', 'g')), '\"([^\"]+)\"', 1)".replace('\\"', '"')


@query(f"select doc_id, unnest({_QUOTED}) as quote from documents")
def quote_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.quotations(F.col("text"))).alias("quote"))


@query("""select b.item_id, d.doc_id, instr(d.text, b.text)::int as at, (length(substr(d.text, 1, instr(d.text, b.text) - 1)) - length(replace(substr(d.text, 1, instr(d.text, b.text) - 1), chr(10), '')) + 1)::int as line_no
from benchmark b join documents d on contains(d.text, b.text)""")
def passage_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand in documents, with the line that they begin on."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = grounding.contained(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), docs)
    before = F.substring(F.col("text"), F.lit(1), F.col("at") - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return found.join(docs, found["text_id"] == docs["id"]).select(F.col("passage_id").alias("item_id"), F.col("text_id").alias("doc_id"), "at", line.alias("line_no"))


@query("""select b.item_id, count(d.doc_id) as n_docs from benchmark b left join documents d on contains(d.text, b.text) group by b.item_id""")
def quote_in_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    found = grounding.contained(items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    counts = found.groupBy(F.col("passage_id").alias("id")).agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("id").join(counts, "id", "left").select(F.col("id").alias("item_id"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("select d.doc_id, case when d.text is null or trim(d.text) = '' then 'the claim is empty' else 'no such paragraph: ' || d.doc_id end as problem from documents d where trim(coalesce(d.text, '')) = '' or d.doc_id not in (select doc_id from labels where doc_id is not null)")
def claim_missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims, each citing the paragraph of its own number; labels are the paragraphs there are."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.lit(1).alias("doc_id"), F.lit("facts").alias("section"), F.when(F.trim("text") != "", "said so").alias("text"), F.array("doc_id").alias("paragraphs"))
    paragraphs = labels.select(F.lit(1).alias("doc_id"), F.col("doc_id").alias("ordinal"), F.lit("").alias("text")).distinct()
    out = grounding.check_claims(claims, paragraphs).where(~F.col("kept"))
    return out.select(F.col("claim_id").alias("doc_id"), F.array_join("problems", "; ").alias("problem"))


_CHECKED_TURNS = "select case role when 'user' then 'facts' when 'assistant' then 'holding' else role end as section, length(text) > 60 as kept, turn % 2 = 1 as flagged from conversations"
_SECTIONS = ", ".join(f"('{s}', {i})" for i, s in enumerate(grounding.SECTIONS))
_SECTION_COUNTS = f"""with c as (select section, count(case when kept then 1 end) as kept, count(case when not kept then 1 end) as dropped, count(case when flagged then 1 end) as flagged from ({_CHECKED_TURNS}) group by section)
select coalesce(s.section, c.section) as section, coalesce(s.i, {len(grounding.SECTIONS)})::int as section_ord, coalesce(kept, 0)::bigint as kept, coalesce(dropped, 0)::bigint as dropped, coalesce(flagged, 0)::bigint as flagged, coalesce(kept, 0) = 0 as empty
from (values {_SECTIONS}) s(section, i) full join c on c.section = s.section"""


def _checked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("role") == "user", "facts").when(F.col("role") == "assistant", "holding").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(section.alias("section"), (F.length("text") > 60).alias("kept"), F.when(F.col("turn") % 2 == 1, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("flags"))


@query(_SECTION_COUNTS)
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.section_counts(_checked_turns(spark, sf_dir))


@query(f"select section from ({_SECTION_COUNTS}) where empty")
def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.section_counts(_checked_turns(spark, sf_dir)).where("empty").select("section")


@query(literals.values_sql(literals.CHECKED, ["claim_id", "problems", "flags", "kept"]))
def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = grounding.check_claims(literals.claims(spark), literals.paragraphs(spark), literals.subject(spark), literals.known_names(spark))
    return out.select("claim_id", F.array_join("problems", "; ").alias("problems"), F.array_join("flags", "; ").alias("flags"), "kept")


@query(literals.values_sql(literals.NAMES, ["text", "names"]))
def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.createDataFrame([(t,) for t, _ in literals.NAMES], "text string")
    return rows.select("text", F.array_join(grounding.case_names(F.col("text")), " | ").alias("names"))


# Constraints


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all having count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return constraints.orphans(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query("select event_id, event_type from events where event_type not in ('click', 'view')")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.domain_violations(table(spark, sf_dir, "events"), "event_type", ["click", "view"]).select("event_id", "event_type")


@query("select l_orderkey, l_linenumber, l_discount from lineitem where not l_discount between 0 and 0.08")
def range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.range_violations(table(spark, sf_dir, "lineitem"), "l_discount", 0, 0.08).select("l_orderkey", "l_linenumber", "l_discount")


@query("""with c as (select p_name as slug, p_size - 5 as strength, p_size % 3 = 0 as verified, p_size % 2 = 0 as timed, p_size % 7 as judges from part),
e as (select n_nationkey as a, (n_nationkey * 7 + 3) % 25 as b, n_nationkey / 20.0 as confidence, n_nationkey % 4 = 0 as reviewed, n_nationkey % 8 = 0 as signed from nation),
v as (select 'cases' as "table", 'unique(slug)' as rule, count(*) as n from (select slug from c group by slug having count(*) > 1)
union all select 'cases', 'bench_strength_positive', count(*) from c where strength <= 0 union all select 'cases', 'verified_has_time', count(*) from c where verified and not timed
union all select 'cases', 'judges_fit_bench', count(*) from c where judges <> strength union all select 'citing_edges', 'no_self_loop', count(*) from e where a = b
union all select 'citing_edges', 'confidence_range', count(*) from e where confidence not between 0 and 1 union all select 'citing_edges', 'reviewed_has_reviewer', count(*) from e where reviewed and not signed)
select "table", rule, n from v where n > 0""")
def cardinality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persistent model's rules, over parts as cases and nations as edges."""
    size = F.col("p_size")
    cases = table(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), (size - 5).alias("bench_strength"), F.when(size % 3 == 0, "verified").otherwise("seed").alias("verification_status"), F.when(size % 2 == 0, F.lit("2024-01-01")).alias("verified_at"), F.array_repeat(F.lit("a"), size % 7).alias("judges"))
    n = F.col("n_nationkey")
    edges = table(spark, sf_dir, "nation").select(n.alias("citing_case_id"), ((n * 7 + 3) % 25).alias("cited_case_id"), (n / 20.0).alias("confidence"), F.when(n % 4 == 0, "reviewed").otherwise("new").alias("review_status"), F.when(n % 8 == 0, F.lit("x")).alias("reviewed_by"))
    return constraints.violations({"cases": cases, "citing_edges": edges})


@query("select c_custkey, case when c_nationkey % 5 = 0 then null else c_nationkey end::int as c_nationkey from customer")
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0")
    return constraints.set_null(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", gone, "n_nationkey")


# Evaluation, graph, vectors


@query("""with p as (select p_partkey, p_size % 4 = 0 as trap, p_size > 20 as resolved, p_retailprice > 1000 as verified from part),
m as (select count(case when trap and verified then 1 end)::double as a, count(case when trap and resolved then 1 end)::double as b,
  case when count(case when not trap then 1 end) > 0 then round(count(case when not trap and resolved then 1 end) / count(case when not trap then 1 end), 4) else 0 end as c from p)
select * from (select 'fake_marked_verified' as metric, '==' as op, 0.0::double as target, a as value, a = 0 as passed from m
union all select 'traps_resolved', '==', 0.0, b, b = 0 from m union all select 'correct_case_rate', '>=', 0.95, c, c >= 0.95 from m)""")
def eval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates over a labelled set made of parts: some sizes are traps, larger ones count as resolved."""
    part = table(spark, sf_dir, "part")
    expected = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.when(F.col("p_size") % 4 == 0, "trap_fake").otherwise("popular").alias("kind"), F.array("p_name").alias("expect"))
    found = F.when(F.col("p_size") > 20, F.array(F.struct(F.col("p_name").alias("case_id")))).otherwise(F.expr("cast(array() as array<struct<case_id:string>>)"))
    results = part.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") > 20, "resolved").otherwise("not_found").alias("status"), found.alias("candidates"), F.when(F.col("p_retailprice") > 1000, "verified").otherwise("could_not_verify").alias("verification"))
    return evals.gates(evals.metrics(evals.judged(expected, results)))


@query("""with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 100 = 0), e as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select query_id, id, list_cosine_similarity(q, v) as similarity from q join e on id <> query_id), r as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s)
select query_id, id, rank::int as rank, round(similarity, 6) as similarity from r where rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = citator.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)
    return out.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("""with recursive e as (select n_nationkey::varchar as a, ((n_nationkey * 7 + 3) % 25)::varchar as b from nation), r(src, dst, hops) as (select a, b, 1 from e union all select r.src, e.b, r.hops + 1 from r join e on r.dst = e.a where r.hops < 40)
select src, dst, min(hops)::int as hops from r where src <> dst group by src, dst""")
def edge_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    return citator.reachable(edges, "a", "b")


# Profiles and sinks


@query(r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_words, (length(coalesce(text, '')) // 4)::bigint as n_tokens from documents")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.size_estimate(table(spark, sf_dir, "documents"))


@query("select sha256(text) as sha, count(*) as n_copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def copy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.copies(table(spark, sf_dir, "documents"))


@query("""with w as (select doc_id as id, list_sort(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as lines from documents where text is not null),
m as (select id, lines, min(id) over (partition by lines) as class from w where len(lines) > 0),
l as (select id, line, count(*) as n from (select id, unnest(lines) as line from m where id = class) group by id, line),
t as (select id, sum(n) as total from l group by id),
s as (select x.id as a, y.id as b, sum(least(x.n, y.n)) as shared from l x join l y on x.line = y.line and x.id < y.id group by x.id, y.id)
select a, b, shared::bigint as shared, 2 * shared / (u.total + v.total) as similarity from s join t u on u.id = a join t v on v.id = b where shared >= 2
union all select class, id, len(lines)::bigint, 1.0::double from m where id > class and len(lines) >= 2""")
def copy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return profiles.line_overlap(table(spark, sf_dir, "documents"))


@query("""select n_nationkey, '{"nation":"' || n_name || '","region":"' || r_name || '"}' as json from nation join region on n_regionkey = r_regionkey""")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return json_rows(rows.select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")), "n_nationkey")


# Segmentation and page furniture of literal documents


@query(literals.values_sql(literals.SPLIT, ["doc_id", "ordinal", "opinion", "court_number", "text"]))
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.operators import segment

    ship(spark)
    return segment.paragraphs(segment.split_documents(literals.documents(spark)))


@query()
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table as one opinion with numbered paragraphs."""
    from docketry.operators import segment

    ship(spark)
    return segment.paragraphs(segment.split_documents(table(spark, sf_dir, "documents")))


@query(literals.values_sql(literals.UNSTAMPED, ["line_no", "raw"]))
def stamp_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("s", 1, i + 1, r) for i, r in enumerate(literals.STAMPED)], "doc_id string, page_no int, line_no int, raw string")
    return layout.strip_stamps(rows).select("line_no", F.trim("raw").alias("raw"))


@query("""select distinct sha256(text) as sha from documents""")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the table read as a stream of files, each once."""
    import uuid

    from docketry.streaming import documents

    path = f"{shared_folder(spark)}/docketry-stream-{uuid.uuid4().hex[:12]}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    stream = stream.withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    documents.run_once(documents.once(stream, "text", "at").select("sha"), f"{path}/out", f"{path}/state")
    return spark.read.schema("sha string").parquet(f"{path}/out")


def _cleaned(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "body", "trailer", F.array_join("footnotes", "|").alias("footnotes"), F.array_join("warnings", "|").alias("warnings"))


_CLEANED = ["doc_id", "body", "trailer", "footnotes", "warnings"]


@query(literals.values_sql(literals.CLEANED_REPORT, _CLEANED))
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.operators import cleaning

    ship(spark)
    return _cleaned(cleaning.clean_report(spark.createDataFrame([("r", literals.REPORT_PAGES)], "doc_id string, text string")))


@query(literals.values_sql(literals.CLEANED, _CLEANED))
def clean_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.operators import cleaning

    ship(spark)
    docs = spark.createDataFrame([("a", literals.ARCHIVE), ("s", literals.SIGNED)], "doc_id string, text string")
    return _cleaned(cleaning.clean_site(docs))
