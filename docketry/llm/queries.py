"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.session import ship, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.token_counts import count_tokens

    ship(spark)
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def mix_levels() -> list:
    """The tree of the queries: sources make four domains; weights are whole numbers."""
    from pyspark.sql import functions as F

    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)"), F.lit(0))
    domain = F.concat(F.lit("domain"), (number % 4).cast("string"))
    lang = F.when(F.col("lang") == "en", 4).when(F.col("lang").isin("de", "fr"), 3).otherwise(2)
    return [("domain", domain, 5 - number % 4), ("lang", F.col("lang"), lang), ("source", F.col("source"), 1 + number % 3)]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.mixing import mix

    ship(spark)
    return mix(table(spark, sf_dir, "documents"), mix_levels())


def _share_sql(name: str, nodes: str, parent: str, key: str) -> str:
    """SQL for the split of each parent's budget among the rows (cap, w, budget) of `nodes`."""
    by = f"partition by {parent} " if parent else ""
    run = f"({by}order by cap::double / w, {key} rows unbounded preceding)"
    return f"""
{name}_1 as (select *, sum(cap) over {run} - cap as c, sum(w) over {run} - w as v, sum(w) over ({by}) as t from {nodes}),
{name}_2 as (select *, min(case when cap::hugeint * (t - v)::hugeint <= (budget - c)::hugeint * w then 1 else 0 end) over {run} = 1 as f from {name}_1),
{name}_3 as (select *, budget - sum(case when f then cap else 0 end) over ({by}) as rest, sum(case when f then 0 else w end) over ({by}) as free,
  sum(case when f then 0 else w end) over {run} as cum from {name}_2),
{name} as (select *, case when f then cap when free > 0 then (rest::hugeint * cum::hugeint) // free::hugeint - (rest::hugeint * (cum - w)::hugeint) // free::hugeint else 0 end as alloc from {name}_3)"""


OP1_SQL = rf"""
with d as (
  select doc_id, lang, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) as n,
         coalesce(try_cast(regexp_extract(source, '[0-9]+') as int), 0) as s from documents
), r as (
  select doc_id, 'domain' || (s % 4) as domain, lang, source, n, 5 - s % 4 as w0,
         case when lang = 'en' then 4 when lang in ('de', 'fr') then 3 else 2 end as w1, 1 + s % 3 as w2,
         coalesce('=' || lang, 'null') as k1, coalesce('=' || source, 'null') as k2 from d
), leaves as (select domain, k1, k2, sum(n) as supply, sum(n) * 3 as cap, max(w0) as w0, max(w1) as w1, max(w2) as w2 from r group by all having sum(n) > 0),
n0 as (select domain, sum(cap) as cap, max(w0) as w, (select least(sum(supply), sum(cap)) from leaves) as budget from leaves group by domain),
{_share_sql("a0", "n0", "", "domain")},
n1 as (select l.domain, k1, sum(l.cap) as cap, max(w1) as w, any_value(alloc) as budget from leaves l join a0 on l.domain = a0.domain group by l.domain, k1),
{_share_sql("a1", "n1", "domain", "k1")},
n2 as (select l.domain, l.k1, k2, l.cap, w2 as w, alloc as budget, supply from leaves l join a1 on l.domain = a1.domain and l.k1 = a1.k1),
{_share_sql("a2", "n2", "domain, k1", "k2")},
plan as (select domain, k1, k2, alloc // supply as epochs, alloc % supply as rest from a2 where alloc > 0),
j as (select r.*, epochs, rest, md5('mix-1:' || epochs::bigint || ':' || coalesce(doc_id::varchar, 'null')) as h from r join plan using (domain, k1, k2)),
o as (select *, sum(n) over (partition by domain, k1, k2 order by h rows unbounded preceding) - n as before from j),
e as (select *, unnest(range(0, epochs::bigint + 1)) as epoch from o)
select doc_id, domain, lang, source, epoch::int as epoch, n::bigint as n_tokens,
       (case when epoch < epochs then n else least(n, rest - before) end)::bigint as take_tokens
from e where epoch < epochs or before < rest
"""


def op2_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.embedding_dedup import near_duplicates

    ship(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.langid import identify

    ship(spark)
    return identify(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.packing import Encoder, pack

    ship(spark)
    return pack(table(spark, sf_dir, "documents"), byte_bpe_encoder(Encoder))


def byte_bpe_encoder(kind):  # noqa: ANN001, ANN201
    """Makes the encoder where it is used: the vocabulary files are read on each worker."""

    def make():  # noqa: ANN202
        import public_tokenizers

        return kind(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    return make


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.neardup import near_duplicates

    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.toxicity import classify

    ship(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from docketry.llm.topk import top_k

    ship(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
with x as (
  select vec_id, list_transform(embedding, lambda v: floor(256 * v::double)::hugeint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from x q join x c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.quality import classify

    ship(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm.archives import archive_pages
    from docketry.llm.common import new_path

    ship(spark)
    return archive_pages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


OP10_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), d as (select page_id, n, sha256(html) as digest from p),
g as (select *, min(page_id) over (partition by digest) as first_id from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
       case when n >= 100 and (page_id is null or page_id > first_id) and first_id is not null then 'revisit' else 'response' end as record_type,
       case when n >= 100 and (page_id is null or page_id > first_id) then first_id end as refers_to
from g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_embedding_duplicates": op2_embedding_duplicates,
        "op3_language": op3_language,
        "op4_packing": op4_packing,
        "op5_token_counts": op5_token_counts,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_toxicity": op7_toxicity,
        "op8_top_k": op8_top_k,
        "op9_quality": op9_quality,
        "op10_archives": op10_archives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op8_top_k": OP8_SQL, "op10_archives": OP10_SQL}
