"""Operators against plain loops and small literal cases."""

import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T
from docketry.operators import constraints, consensus, entities, evals, grounding, layout, profiles, segment
from docketry.plans import literals

TODAY = dt.date(2026, 1, 1)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_normalize_and_similarity(spark):
    rows = column(spark, ["Fuß & Café–Bar", "ﬁne", "A.B. 12", None]).select("i", T.normalize(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == ["fu and cafebar", "fine", "a b 12", None]
    pair = spark.createDataFrame([("word", "words")], "a string, b string")
    assert abs(pair.select(T.trigram_similarity(F.col("a"), F.col("b"))).first()[0] - 0.5714286) < 1e-6
    assert pair.select(T.trigram_similarity(F.lit(""), F.col("b"))).first()[0] == 0
    assert pair.select(T.word_similarity(F.lit("menaka"), F.lit("manika"))).first()[0] == 0.6
    assert pair.select(T.titles_match(F.lit("Golak Nath v. State"), F.lit("GOLAKNATH and others"))).first()[0]


def test_exact_folding_agrees_with_the_native_one_on_latin_text(spark):
    rows = column(spark, ["Ça été à l'œuvre", "naïve ½ ﬂow", "ＡＢＣ"])
    assert all(r[0] == r[1] for r in rows.select(T.fold_ascii(F.col("x")), T.fold_ascii_exact(F.col("x"))).collect())


def test_quotes(spark):
    cases = [("a b ... c", "x a b yy c", True), ("c ... a b", "x a b yy c", False), ("...", "x", True), ("A b", "a b", False)]
    rows = spark.createDataFrame(cases, "q string, p string, want boolean")
    assert all(r[0] == r.want for r in rows.select(T.quote_in(F.col("q"), F.col("p")), "want").collect())


def test_canonical_citations_parse_to_themselves(spark):
    forms = [c[1] for c in literals.CITATIONS if c[1]]
    rows = column(spark, forms).select("x", C.canonical(C.parse_citation(F.col("x"))).alias("y")).collect()
    assert all(r.x == r.y for r in rows)


def cases_of(spark, rows):
    return spark.createDataFrame(rows, "case_ord int, id string, title string, year int, aliases array<string>, citations array<string>, cited_by_count int")


CASES = [
    (0, "keshav", "Keshavlal Bharati v. State of Hills", 1973, ["Fundamental Plan Case"], ["(1973) 4 SCC 25", "AIR 1973 SC 1400"], 900),
    (1, "menaka", "Menaka Gandhi v. Union of Hills", 1978, [], ["(1978) 1 SCC 248"], 500),
    (2, "rao1", "Narsimha Rao v. State of Hills", 1998, [], ["(1998) 4 SCC 6"], 10),
    (3, "rao2", "Narsimha Rao v. Union of Valleys", 2001, [], [], 5),
]
QUERIES = [
    ("keshavlal bharti", "resolved", ["keshav"]), ("maneka gandhi", "resolved", ["menaka"]), ("narsimha rao", "ambiguous", ["rao1", "rao2"]),
    ("(1978) 1 S.C.C. 248", "resolved", ["menaka"]), ("(2088) 1 SCC 5", "invalid_citation", []), ("(1990) 1 SCC 9", "not_found", []),
    ("(1978) 1 SCC 248 and (1973) 4 SCC 25", "ambiguous", ["menaka", "keshav"]), ("Narsimha Rao (1978) 1 SCC 248", "suggestions", ["menaka"]),
    ("menaka gandhi 1950", "suggestions", ["menaka"]), ("state of", "not_found", []), ("zzyx qqq", "not_found", []),
]


def test_resolution(spark):
    queries = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(QUERIES)], "query_id int, query string")
    got = {r.query_id: r for r in entities.resolve(queries, cases_of(spark, CASES), TODAY).collect()}
    for i, (q, status, ids) in enumerate(QUERIES):
        assert got[i].status == status, (q, got[i])
        assert [c.case_id for c in got[i].candidates][: len(ids)] == ids, (q, got[i])


def test_entity_rules(spark):
    assert entities.case_violations(cases_of(spark, CASES), TODAY).count() == 0
    bad = [*CASES, (4, "menaka", "Twice", 1990, [], ["(1973) 4 SCC 25", "nonsense", "(1990) 1 SCC 0", "(1990) 2 SCC 1"], 0)]
    rules = {r.rule for r in entities.case_violations(cases_of(spark, bad), TODAY).collect()}
    assert rules == {"unique_id", "citation_readable", "citation_plausible", "citation_of_one_case", "one_citation_per_reporter"}


def test_same_bench(spark):
    pairs = [(["A. Rao", "B. Sen"], ["Justice Sen", "Justice Rao"], True), (["A. Rao"], ["A. Rao", "B. Sen"], False), (["A. Rao", "A. Rao"], ["A. Rao", "B. Sen"], False), ([], [], True)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>, want boolean")
    assert all(r[0] == r.want for r in rows.select(consensus.same_bench(F.col("a"), F.col("b")), "want").collect())


def test_lookup(spark):
    found = spark.createDataFrame([(1, "resolved", [("a",)]), (2, "not_found", [])], "query_id int, status string, candidates array<struct<case_id:string>>")
    out = {r.query_id: r.verification for r in consensus.lookup(found, consensus.verify(literals.cases(spark), literals.records(spark))).collect()}
    assert out == {1: "verified", 2: "could_not_verify"}


def test_citations_of_large_keys_are_looked_up(spark, tmp_path):
    """A page has five digits at most; keys with more are cited all the same, as the SQL has them."""
    import duckdb

    from docketry.plans import catalog

    keys = [1, 2, 3, 99_998, 99_999, 100_000, 100_001, 199_999, 5_000_002, 3_000_000_001]
    spark.createDataFrame([(k, f"almond azure part {k % 7}") for k in keys], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n + 1, (k + n * o) % 4_000_000_000) for o, k in enumerate(keys * 3) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.queries()["citation_lookup_join"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["citation_lookup_join"]).fetchall()
    assert sorted((r.query_id, r.status, r.found) for r in rows) == sorted(want) and len({r.status for r in rows}) == 4


def test_contained_passages_equal_brute_force(spark):
    r = random.Random(1)
    words = "ab cd ef gh".split()
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(40)]
    passages = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(30)] + [(98, "f g"), (99, "")]
    df = lambda rows: spark.createDataFrame(rows, "id int, text string")
    got = {(x.passage_id, x.text_id) for x in grounding.contained(df(passages), df(texts), words=3).collect()}
    assert got == {(p, t) for p, a in passages for t, b in texts if a and a in b}


def loop_strip(pages, furniture):
    out = []
    for page in pages:
        lines = [x for x in page if x.strip()]
        top = 0
        while top < min(3, len(lines)) and furniture(lines[top]):
            top += 1
        end = len(lines)
        while end > max(top, len(lines) - 4) and furniture(lines[end - 1]):
            end -= 1
        out.append(lines[top:end])
    return out


def test_edge_stripping_equals_a_loop(spark):
    r = random.Random(2)
    pages = [[r.choice(["12", "- 3 -", "Page 2 of 9", "HEAD", "some text", "other text", ""]) for _ in range(r.randint(1, 9))] for _ in range(30)]
    lines = spark.createDataFrame([("d", p, i + 1, x) for p, page in enumerate(pages) for i, x in enumerate(page)], "doc_id string, page_no int, line_no int, raw string")
    running = spark.createDataFrame([("d", "HEAD")], "doc_id string, line string")
    got = {}
    for x in layout.strip_edges(lines, running).orderBy("page_no", "line_no").collect():
        got.setdefault(x.page_no, []).append(x.line)
    furniture = lambda s: s in ("12", "- 3 -", "Page 2 of 9", "HEAD")
    want = loop_strip(pages, furniture)
    assert all(got.get(p, []) == w for p, w in enumerate(want))


def test_layout_pieces(spark):
    lines = spark.createDataFrame([("d", 1, 1, "     left    middle text"), ("d", 1, 2, "")], "doc_id string, page_no int, line_no int, raw string")
    found = lines.select(layout.segments(F.col("raw")).alias("s")).first().s
    assert [(x.start, x.end, x.text) for x in found] == [(5, 9, "left"), (13, 24, "middle text")]
    ends = column(spark, ["It ends.", "by Dr.", "“It ends.”", "no end", "see (a)"]).select(layout.ends_sentence(F.col("x")).alias("e")).collect()
    assert [x.e for x in ends] == [True, False, True, False, False]
    book = ["INDEX", "One ...... 1", "Two ...... 2", "Three ..... 3", "Text", "a", "b", "c", "d", "e", "f", "Lone ..... 9"]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(book)], "doc_id string, page_no int, line_no int, raw string")
    assert sorted(x.line_no for x in layout.contents_lines(rows).collect()) == [0, 1, 2, 3]


def test_cut_tails_are_merged(spark):
    book = ["      this is a long line of text that was cut at the ha", "ve", "      and it should have been a whole line once more on", "to", "      the page where all the lines are long and indented"]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(book)], "doc_id string, page_no int, line_no int, raw string")
    got = [x.raw.strip() for x in layout.merge_tails(rows).orderBy("line_no").collect()]
    assert got[0].endswith("at the have") and got[1].endswith("on to") and len(got) == 3


def test_report_heads_and_margins(spark):
    page = ["SUPREME COURT REPORTS    [1978] 3 S.C.R.", "Lal v. Rao  964", "The text begins here and goes on for a while.", "It ends."]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(page)], "doc_id string, page_no int, line_no int, raw string")
    assert [x.line_no for x in layout.strip_heads(rows).orderBy("line_no").collect()] == [2, 3]
    body = [f"    line number {i} of the text column is here" for i in range(6)] + ["A    line with a letter at the left of it all now"]
    rows = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(body)], "doc_id string, page_no int, line_no int, raw string")
    assert layout.strip_margins(rows).where("line_no = 6").first().raw.strip() == "line with a letter at the left of it all now"


def test_segmentation():
    s = segment.split_text("ORDER\n\n1. One.\n\n2. Two, with a list:\n\n18. Quoted rule.\n\n3. Three.\n\n23.1 Not a part.\n\n3.1 A part.")
    assert [p[2] for p in s.paragraphs] == ["1", "2", "3", "3.1"]
    s = segment.split_text("ORDER\n\n2. Two.\n\n4. Four.")
    assert [p[2] for p in s.paragraphs] == ["2", "4"] and len(s.warnings) == 2
    assert segment.split_text(None).paragraphs == [] and segment.split_text("1.\n\nText").paragraphs[0][2] == "1"


def test_hyphens():
    words = segment.vocabulary(["the government and non-agricultural land", "self subject matter", "mat-"])
    assert segment.join_hyphens("Govern- ment non-agri- cultural subject- matter contri- buted Munsif- Magistrate", words) == "Government non-agricultural subject-matter contributed Munsif-Magistrate"


def test_labels(spark):
    rows = spark.createDataFrame([(3, None, "RAO", 2), (4, "7", "RAO", 2), (4, "7", "RAO", 1)], "o int, c string, a string, n int")
    got = [r[0] for r in rows.select(segment.label(F.col("o"), F.col("c"), F.col("a"), F.col("n"))).collect()]
    assert got == ["[3]", "Rao J., para 7", "para 7"]


def test_constraints(spark):
    edges = spark.createDataFrame([(1, 1, 0.5, "open", None), (1, 2, 1.5, "reviewed", None), (1, 3, None, "reviewed", "x")], "citing_case_id int, cited_case_id int, confidence double, review_status string, reviewed_by string")
    found = {r.rule: r.n for r in constraints.violations({"citing_edges": edges}).collect()}
    assert found == {"no_self_loop": 1, "confidence_range": 1, "reviewed_has_reviewer": 1}
    gone = spark.createDataFrame([(1,)], "id int")
    assert constraints.cascade(edges, "cited_case_id", gone, "id").count() == 2


def test_gates(spark):
    expected = spark.createDataFrame([(1, "q", "popular", ["a"]), (2, "t", "trap_fake", []), (3, "m", "ambiguous", ["a", "b"])], "query_id int, query string, kind string, expect array<string>")
    results = spark.createDataFrame([(1, "resolved", [("a",)], "verified"), (2, "resolved", [("z",)], "verified"), (3, "ambiguous", [("b",), ("a",)], "x")], "query_id int, status string, candidates array<struct<case_id:string>>, verification string")
    text, code = evals.report(expected, results)
    assert code == 1 and "FAIL traps_resolved 1" in text and "pass correct_case_rate 1" in text
    assert evals.failures(evals.judged(expected, results)).count() == 1


def test_seed_and_pages(spark, tmp_path):
    from docketry.sources import tables

    yaml = pytest.importorskip("yaml")
    seed = yaml.safe_dump([{"id": "a", "title": "A v. B", "year": 1980, "citations": ["(1980) 1 SCC 1"]}, {"id": "b", "title": "C v. D", "year": 1981}])
    assert tables.cases_from_yaml(spark, seed, TODAY).count() == 2
    with pytest.raises(tables.InvalidSeed):
        tables.cases_from_yaml(spark, seed.replace("(1980) 1 SCC 1", "nonsense"), TODAY)
    assert tables.expected_from_yaml(spark, "- {query: x, kind: popular, expect: a}").first().expect == ["a"]
    (tmp_path / "x.txt").write_text("one\ntwo\fthree")
    rows = tables.pages_from_files(spark, str(tmp_path)).orderBy("page_no", "line_no").collect()
    assert [(r.page_no, r.line_no, r.raw) for r in rows] == [(1, 1, "one"), (1, 2, "two"), (2, 1, "three")]
    assert tables.NoRecords().records(spark.createDataFrame([("a",)], "id string")).count() == 0


def test_html_lines(spark):
    page = spark.createDataFrame([(1, "<head><title>t</title></head><body><p>One &amp; two<br>three</p><script>x()</script></body>")], "page_id int, html string")
    assert [r.line for r in profiles.html_lines(page).orderBy("line_no").collect()] == ["One & two", "three"]


def test_stream_counts(spark, tmp_path):
    from docketry.streaming import documents

    spark.range(10).selectExpr("id", "timestamp_seconds(id * 1200) as at", "id % 2 as k").write.parquet(str(tmp_path / "in"))
    stream = documents.stream_tables(spark, str(tmp_path / "in"), "id long, at timestamp, k long")
    documents.run_once(documents.windowed_counts(stream, "at", ["k"], delay="0 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] >= 6


def test_line_overlap_of_frequent_lines_equals_brute_force(spark, monkeypatch):
    """130 documents share the same two lines, some of them whole; small parts deal the lines out."""
    from collections import Counter

    from docketry.operators import profiles

    monkeypatch.setattr(profiles, "PART", 20)
    texts = {i: "licence\nnotice\nnotice\n" + ("same" if i % 3 else f"own {i}") for i in range(130)} | {200: "licence", 201: "notice\n\nnotice", 202: None, 203: ""}
    counts = {i: Counter(x for x in (t or "").split("\n") if x) for i, t in texts.items()}
    want = set()
    for a in texts:
        for b in texts:
            n = (counts[a] & counts[b]).total()
            if a < b and n >= 2:
                want.add((a, b, n, 2 * n / (counts[a].total() + counts[b].total())))
    rows = profiles.line_overlap(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    # Rows are of classes of equal lines, and of a class's first document with its others: all pairs follow from them.
    first = {}
    for i in sorted(texts):
        first.setdefault(frozenset(counts[i].items()), i)
    of = {i: first[frozenset(counts[i].items())] for i in texts}
    by = {(r.a, r.b): (r.shared, r.similarity) for r in rows}
    assert len(by) == len(rows) and all(of[a] == a for a, _ in by)
    own = {a: (n, 1.0) for (a, b), (n, _) in by.items() if of[b] == a}
    pairs = {(a, b): own.get(of[a]) if of[a] == of[b] else by.get((min(of[a], of[b]), max(of[a], of[b]))) for a in texts for b in texts if a < b}
    assert {(a, b, *x) for (a, b), x in pairs.items() if x} == want


@pytest.mark.parametrize("part", [12, 40, 10_000])
def test_line_overlap_in_blocks_equals_brute_force(spark, monkeypatch, part):
    """Lines of all documents, of some and of two, in blocks of several sizes; ids are strings."""
    r = random.Random(part)
    monkeypatch.setattr(profiles, "PART", part)
    texts = {f"d{i}": ["everywhere", *(f"often {r.randint(0, 9)}" for _ in range(r.choice([0, 0, 0, 1, 3]))), f"own {i}", f"two {i // 2}"] for i in range(150)}
    texts |= {f"e{i}": ["everywhere", "everywhere", "", f"own {i // 9} e"] for i in range(30)} | {"n": [], "m": ["everywhere"]}
    rows = profiles.line_overlap(spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id string, text string")).collect()
    counted = {k: Counter(x for x in v if x) for k, v in texts.items()}
    first = {k: min(x for x in counted if counted[x] == counted[k]) == k for k in counted}
    want = {}
    for a, b in itertools.combinations(sorted(counted), 2):
        shared = (counted[a] & counted[b]).total()
        if shared >= 2 and first[a] and (first[b] or counted[a] == counted[b]):
            want[a, b] = (shared, 2 * shared / (counted[a].total() + counted[b].total()))
    assert {(x.a, x.b): (x.shared, x.similarity) for x in rows} == want and len(rows) == len(want)


def test_line_overlap_writes_no_pairs_under_two_lines(spark):
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = spark.range(1500).selectExpr("id as doc_id", "concat('everywhere\n', if(id < 60, 'often\n', ''), 'own ', id) as text")
    assert profiles.line_overlap(rows).count() == 60 * 59 // 2
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 30_000  # there are 1,124,250 pairs


def test_citations_in_documents_finds_all_written_forms(spark, tmp_path):
    from docketry.functions.citations import find_citations
    from docketry.plans import catalog

    texts = ["see [1950] S.C.R. 605.", "[1976] Supp. SCR 44", "1976 Supp. SCR 44", "J.T. 1990 (2) S.C. 5", "(1978) 1 SCC 248", "A.I.R. 1950 S.C. 27", "2024 INSC 5", "(1999) 2 scale 7", "no citation", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id: r.n for r in docs.select("doc_id", F.size(find_citations(F.col("text"))).alias("n")).collect() if (r.n or 0) > 0}
    got = {r.doc_id: r.n_citations for r in catalog.citations_in_documents(spark, str(tmp_path)).collect()}
    assert got == want == {i: 1 for i in range(8)}


def test_reachable_has_no_longest_way(spark):
    from docketry.operators import citator

    edges = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(3, 0), (20, 20)], "a int, b int")
    got = {(int(r.src), int(r.dst)): r.hops for r in citator.reachable(edges, "a", "b").collect()}
    assert got[0, 14] == 14 and got[2, 0] == 2 and (20, 20) not in got and (5, 4) not in got


def test_scalars_by_name(spark):
    from docketry.functions import registry

    rows = spark.createDataFrame([("Ram Lal v. State of Bihar, 1950 SCR 605",)], "t string")
    for name in ("case_names", "find_citations", "normalize_title"):
        rows = registry.with_scalar(rows, name, "t", alias=name)
    r = rows.first()
    assert r.case_names == ["Ram Lal v. State of Bihar"] and [c.canonical for c in r.find_citations] and r.normalize_title.startswith("ram lal")


def test_a_citation_that_begins_inside_another_is_left(spark):
    from docketry.functions import citations

    rows = spark.createDataFrame([("AIR 1973 SC 1461 5 SCC 2250 3 SCC 7",), ("AIR 1973 SC 1461 and (1973) 4 SCC 225",)], "t string")
    got = [[c.raw for c in r.c] for r in rows.select(citations.find_citations(F.col("t")).alias("c")).collect()]
    assert got == [["AIR 1973 SC 1461"], ["AIR 1973 SC 1461", "(1973) 4 SCC 225"]]
