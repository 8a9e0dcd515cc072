"""Claims checked against the passages that they cite.

Claims: claim_id, doc_id, section, text, paragraphs (array of ordinals). Paragraphs: doc_id, ordinal, text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T

# A brief's sections; words of and before parties' names; abbreviations with a full stop.
SECTIONS = ["facts", "issues", "arguments", "holding", "ratio", "obiter", "opinions"]
CONNECTORS = {"of", "and", "&", "the", "for"}
LEAD_WORDS = set("in see the as following per cf also while unlike like after before under this that and of for".split())
ABBREVIATIONS = set("ltd anr ors co pvt retd dr mr mrs smt bros mohd jt st".split())
PARTY_WORDS = 10
NAME_MATCH, NAME_COVERAGE = T.SKELETON_MATCH, 0.8


def _window_key(hashes: Column, at: Column, n: int) -> Column:
    """Hash of n neighbouring word hashes from a place on; missing ones are null, which the hash passes over."""
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(n)))


def _window_keys(n: int) -> Callable[[Column], Column]:
    """All different window keys of an array of word hashes."""
    return lambda hashes: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: _window_key(hashes, i, n)))


def contained(passages: DataFrame, texts: DataFrame, words: int = 8) -> DataFrame:
    """(passage_id, text_id, at) where the passage (id, text) stands in the text (id, text), case and blanks included.

    A passage's inner words (all but the first and last, which the text may run on with) must stand in a row in the
    text. Passages are keyed by the first `words` of them, hashed; the texts' word windows meet these keys in a
    semi-join-sized equi-join, and only meeting pairs are compared. Passages with fewer inner words are keyed by
    what they have, in one pass over the texts for each length that occurs.
    """
    blank = "[\\x20\\x09-\\x0D]+"
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    p = passages.select(F.col("id").alias("passage_id"), F.col("text").alias("passage")).where("passage <> ''")
    p = p.withColumn("w", F.filter(F.split("passage", blank), lambda x: x != "")).withColumn("inner", F.slice(inner, 1, words))
    hashed = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    p = p.withColumn("size", F.size("inner")).withColumn("key", T.let(hashed(F.col("inner")), lambda h: _window_key(h, F.lit(0), words)))
    keys = p.select("passage_id", "passage", "size", "key")
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # at most words + 1 numbers
    t = texts.select(F.col("id").alias("text_id"), F.col("text").alias("whole")).withColumn("w", F.filter(F.split("whole", blank), lambda x: x != ""))
    out = None
    for n in sizes:
        some = keys.where(F.col("size") == n)
        if n == 0:
            # One or two words: nothing is sure to stand between blanks.
            met = t.select("text_id", "whole").join(some, F.col("whole").contains(F.col("passage")))
        else:
            cut = t.where(F.size("w") >= n).select("text_id", F.explode(T.let(hashed(F.col("w")), _window_keys(n))).alias("key"))
            met = cut.join(some, "key").join(t.select("text_id", "whole"), "text_id")
        part = met.withColumn("at", F.instr("whole", F.col("passage"))).where("at > 0").select("passage_id", "text_id", "at")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else keys.select("passage_id", F.lit(None).alias("text_id"), F.lit(0).alias("at")).where("false")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "^[,;:()\\[\\]\"']+|[,;:()\\[\\]\"']+$", "")


def _abbreviated(word: Column) -> Column:
    """Whether the full stop at a word's end belongs to it: initials, and the fixed abbreviations."""
    return word.rlike(r"^(?:\p{L}\.)+$") | (F.endswith(word, F.lit(".")) & F.lower(F.rtrim(word, F.lit("."))).isin(sorted(ABBREVIATIONS)))


def _first(flags: Column) -> Column:
    """Place, from 0, of the first true flag; the array's size without one."""
    return T.let(F.array_position(flags, F.lit(True)).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(flags)))


def _run(words: Column, leftward: bool) -> Column:
    """The words of a name in the order of reading, from words that go away from the versus."""
    near = F.slice(words, 1, PARTY_WORDS)
    inner = lambda w: ~T.let(_bare(w), lambda x: x.rlike(r"^\p{Lu}") | F.lower(x).isin(sorted(CONNECTORS)))
    if leftward:
        # A clause ends in front of the name.
        size = _first(F.transform(near, lambda w, i: inner(w) | ((i > 0) & w.rlike("[,;:]$"))))
        name = T.let(near, lambda ws: F.reverse(F.transform(F.slice(ws, 1, size), _bare)))
        return T.let(name, lambda n: T.let(_first(F.transform(n, lambda w: ~F.lower(w).isin(sorted(LEAD_WORDS)))), lambda at: F.slice(n, at + 1, F.size(n))))
    ends = F.transform(near, lambda w: w.rlike("[,;:)]$") | (F.endswith(w, F.lit(".")) & ~_abbreviated(_bare(w))))
    size = F.least(_first(F.transform(near, inner)), _first(ends) + 1)
    return F.transform(F.slice(near, 1, size), _bare)


def party(words: Column, leftward: bool) -> Column:
    """The party's name that words, in the order away from the versus, begin with; empty without one."""
    named = lambda w: ~F.lower(w).isin(sorted(CONNECTORS))
    cut = lambda n: F.slice(n, 1, F.size(n) - _first(F.transform(F.reverse(n), named)))
    text = lambda n: F.array_join(n, " ")
    last = lambda n: F.coalesce(F.get(n, F.size(n) - 1), F.lit(""))
    stopped = lambda n: F.endswith(last(n), F.lit(".")) & ~_abbreviated(last(n))
    return T.let(_run(words, leftward), lambda run: T.let(cut(run), lambda n: F.when(stopped(n), F.regexp_replace(text(n), r"\.$", "")).otherwise(text(n))))


def case_names(text: Column) -> Column:
    """Names written as X v. Y. Each part between two versus ends one name and begins the next."""
    words = lambda t: F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+(?:v|vs|versus)\.?\s+"), words)
    pairs = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.struct(party(F.reverse(a), True).alias("a"), party(b, False).alias("b")))
    both = lambda x: (x["a"] != "") & (x["b"] != "")
    return T.let(parts, lambda p: F.transform(F.filter(pairs(p), both), lambda x: F.concat(x["a"], F.lit(" v. "), x["b"])))


def check_claims(claims: DataFrame, paragraphs: DataFrame, subject: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(claim_id, problems, flags, kept): what is wrong with each claim, in the order of the checks.

    subject: doc_id, names, citations of the case a document decides, which claims may always name. known: names
    (column name) that an entity table knows; grounded names outside of it are flagged.
    """
    paras = paragraphs.select("doc_id", "ordinal", T.normalize_for_quotes(F.col("text")).alias("passage"))
    refs = claims.select("claim_id", "doc_id", F.explode(F.array_distinct("paragraphs")).alias("ordinal"))
    cited = refs.join(paras, ["doc_id", "ordinal"], "left")
    per = cited.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("passage").isNull(), F.col("ordinal")))).alias("missing"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("passage").isNotNull(), F.struct("ordinal", "passage")))), lambda x: x["passage"]).alias("passages"),
    )
    base = claims.join(per, "claim_id", "left").withColumn("joined", F.concat(F.array(F.array_join("passages", " ")), "passages"))
    gate = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "the claim is empty")
        .when(F.coalesce(F.size("paragraphs"), F.lit(0)) <= 0, "the claim cites no paragraph")
        .when(F.size("missing") > 0, F.concat(F.lit("no such paragraph: "), F.array_join("missing", ", ")))
    )
    base = base.withColumn("gate", gate)
    live = base.where("gate is null")

    quotes = live.select("claim_id", "doc_id", "joined", F.posexplode(T.quotations(F.col("text"))).alias("pos", "quote"))
    lost = quotes.where(~F.exists("joined", lambda p: T.quote_in(F.col("quote"), p)))
    elsewhere = lost.join(paras, "doc_id").where(T.quote_in(F.col("quote"), F.col("passage"))).groupBy("claim_id", "pos").agg(F.array_join(F.array_sort(F.collect_set("ordinal")), ", ").alias("other"))
    said = F.when(F.col("other").isNull(), F.lit("quotation not found")).otherwise(F.concat(F.lit("quotation is in paragraph "), F.col("other")))
    p1 = lost.join(elsewhere, ["claim_id", "pos"], "left").select("claim_id", F.lit(1).alias("check"), "pos", F.concat(said, F.lit(": "), F.col("quote")).alias("problem"))

    claimed = live.select("claim_id", "doc_id", F.posexplode(C.find_citations(F.col("text"))).alias("pos", "c")).select("claim_id", "doc_id", "pos", C.canonical(F.col("c")).alias("canonical"))
    there = live.select("claim_id", F.explode("passages").alias("passage")).select("claim_id", F.explode(C.find_citations(F.col("passage"))).alias("c")).select("claim_id", C.canonical(F.col("c")).alias("canonical")).distinct()
    if subject is not None:
        own = subject.select("doc_id", F.explode("citations").alias("t")).select("doc_id", C.canonical(C.parse_citation(F.col("t"))).alias("canonical")).where("canonical is not null").distinct()
        claimed = claimed.join(own, ["doc_id", "canonical"], "left_anti")
    p2 = claimed.join(there, ["claim_id", "canonical"], "left_anti").select("claim_id", F.lit(2).alias("check"), "pos", F.concat(F.lit("citation not in the cited paragraphs: "), F.col("canonical")).alias("problem"))

    named = live.select("claim_id", "doc_id", F.array_join("passages", " ").alias("all"), case_names(T.normalize_for_quotes(F.col("text"))).alias("n")).select("claim_id", "doc_id", "all", F.posexplode("n").alias("pos", "name"))
    if subject is not None:
        named = named.join(subject.select("doc_id", F.col("names").alias("own_names")), "doc_id", "left").where(~F.coalesce(F.exists("own_names", lambda n: T.titles_match(n, F.col("name"))), F.lit(False))).drop("own_names")
    grounded = T.coverage(T.distinctive_tokens(F.col("name")), T.distinctive_tokens(F.col("all")), NAME_MATCH) >= NAME_COVERAGE
    named = named.withColumn("grounded", grounded)
    p3 = named.where(~F.col("grounded")).select("claim_id", F.lit(3).alias("check"), "pos", F.concat(F.lit("case not named in the cited paragraphs: "), F.col("name")).alias("problem"))

    problems = p1.unionByName(p2).unionByName(p3).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("check", "pos", "problem"))), lambda x: x["problem"]).alias("found"))
    out = base.select("claim_id", "section", "gate").join(problems, "claim_id", "left")
    flags = named.where("grounded").select("claim_id", "pos", "name")
    if known is not None:
        words = known.select(F.explode(F.array_distinct(T.distinctive_tokens(F.col("name")))).alias("w"), F.col("name").alias("known_name"))
        met = flags.select("claim_id", "pos", "name", F.explode(T.distinctive_tokens(F.col("name"))).alias("w")).join(words, "w").where(T.titles_match(F.col("name"), F.col("known_name"))).select("claim_id", "pos").distinct()
        flags = flags.join(met, ["claim_id", "pos"], "left_anti")
    else:
        flags = flags.where("false")
    flagged = flags.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: F.concat(F.lit("case not in the table: "), x["name"])).alias("flags"))
    none = F.array().cast("array<string>")
    out = out.join(flagged, "claim_id", "left").withColumn("problems", F.when(F.col("gate").isNotNull(), F.array("gate")).otherwise(F.coalesce("found", none)))
    return out.select("claim_id", "section", "problems", F.coalesce("flags", none).alias("flags"), (F.size("problems") == 0).alias("kept"))


def section_counts(checked: DataFrame) -> DataFrame:
    """Kept, dropped and flagged claims by section, the fixed sections first; sections without kept claims are empty."""
    order = checked.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SECTIONS)], "section string, section_ord int")
    counts = checked.groupBy("section").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.size("flags") > 0).alias("flagged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return order.join(counts, "section", "full").select("section", F.coalesce("section_ord", F.lit(len(SECTIONS))).alias("section_ord"), zero("kept"), zero("dropped"), zero("flagged"), (F.coalesce("kept", F.lit(0)) == 0).alias("empty"))
