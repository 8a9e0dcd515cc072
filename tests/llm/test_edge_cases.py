"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("docketry.llm.queries")

from docketry.llm import archives, embedding_dedup, langid, mixing, neardup, packing, quality, token_counts, topk, toxicity  # noqa: E402
from docketry.llm.queries import byte_bpe_encoder, mix_levels, tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, h string, score double, rep long, fp string, __id long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n ", prose(1, 30), prose(1, 30), prose(2, 20_000), "\U0001f600 ▁ \x00 <s> <|endoftext|>", "two words", prose(3, 40)]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"src{i % 3}") for i, t in enumerate(texts)]
    rows += [(3, prose(1, 30), "de", "src0"), (3, prose(1, 30), "de", "src0"), (None, prose(4, 25), "fr", "src1")]
    return spark.createDataFrame([(*r, 1, 7, 7, "h", 0.5, 3, "fp", 9) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (1, 0, None), (3, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, 0), (8, 1, 5)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_token_counts(spark, docs):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = token_counts.count_tokens(docs, model).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(encoder.encode(r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert [r.over_limit for r in rows] == [r.n_tokens > 4096 for r in rows]
    assert token_counts.count_tokens(docs.limit(0), model).count() == 0


def test_pre_tokens_are_exact_on_odd_texts():
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    encoder, counter, r = sentencepiece.SentencePieceProcessor(model_file=model), token_counts.PieceCounter(model), random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("ab  \n\t▁é　\x00<s>ﬁ½#ß \xa0.") for _ in range(r.randint(0, 14)))
        assert counter.count(text) == len(encoder.encode(text)), repr(text)


def test_packing_is_an_exact_round_trip(docs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(docs.repartition(2, "doc_id"), byte_bpe_encoder(packing.Encoder), with_ids=True).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    want = {}
    for d in docs.collect():
        want.setdefault(d.doc_id, []).append(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[key]))
        if len(want[key]) == 1:
            ids = [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids]
            assert ids == want[key][0] and {p.doc_tokens for p in pieces} == {len(ids)}
    assert packing.pack(docs.limit(0), byte_bpe_encoder(packing.Encoder)).count() == 0


def test_packing_of_very_long_texts(spark):
    """A million blanks, one long run of letters and several MB of prose: the ids of the library, piece by piece."""
    import numpy as np
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "a" * 300_000, (prose(5, 3000) + "\n\n it's  9 ") * 200, "\n" * 9000 + "x" * 9000 + " end", None, "short"]
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert len(texts[2]) > 3 * packing.PART and len(want[2]) > 10 * packing.BUFFER
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), byte_bpe_encoder(packing.Encoder), with_ids=True).collect()
    size = {}
    for i, ids in enumerate(want):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert np.array_equal(np.concatenate([r.ids for r in mine]), ids) and {r.doc_tokens for r in mine} == {len(ids)}
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
    for r in rows:
        assert r.offset + r.length <= 1024
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in size.values()) <= 0.03 * sum(size.values())


def test_sentences_that_fit_are_not_cut():
    import numpy as np

    ending = np.array([False, True])
    ids = np.zeros(5000, np.int64)
    ids[[99, 900, 1500, 4200]] = 1
    places, costs = packing.cut_places(ids, np.array([5000]), ending, 1024)
    assert {100, 901, 1501, 4201, 5000} <= set(places.tolist())
    inside = [p for p, c in zip(places, costs, strict=True) if c == packing.TOKEN_CUT]
    assert inside and all(1501 < p < 4201 for p in inside)


def test_windows_are_the_cheapest():
    import itertools

    import numpy as np

    r = random.Random(5)
    for _ in range(60):
        places = np.array(sorted(r.sample(range(1, 40), 8)))
        places = places[np.concatenate(([True], np.diff(places) <= 16))]
        if places[0] > 16 or (np.diff(places) > 16).any():
            continue
        costs = np.array([float(r.choice([0, 2, 5])) for _ in places])
        cost = dict(zip(places.tolist(), costs, strict=True))

        def total(ends, cost=cost):
            at, out = 0, 0
            for e in ends:
                if e - at > 16:
                    return float("inf")
                out += packing.padding(e - at, 16) + cost[e] + packing.WINDOW
                at = e
            return out

        inner = places[:-1].tolist()
        best = min(total([*c, int(places[-1])]) for k in range(len(inner) + 1) for c in itertools.combinations(inner, k))
        assert total(packing.cut_windows(places, costs, 16)) == best


def test_near_duplicates(docs):
    rows = neardup.near_duplicates(docs).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id, r.kept) for r in rows)
    assert len(rows) == docs.count()
    by = {r[0]: r for r in got}
    assert by[0][1:] == (0, 0, True) and by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True)
    assert by[4][2:] == (3, False) and by[3][2:] == (3, True)
    assert by[-1][2:] == (None, True) and by[7][1:] == (1, 7, True)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix(docs, mix_levels())
    assert out.columns == ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens"]
    rows = out.collect()
    assert all(0 <= r.take_tokens <= r.n_tokens and 0 <= r.epoch < 3 for r in rows)
    assert mixing.mix(docs.limit(0), mix_levels()).count() == 0
    whole = mixing.mix_documents(docs, mix_levels())
    assert whole.columns == docs.columns and whole.count() == len(rows)
    # a cut document has just the words left, so the texts' words are the budget
    key = lambda i: -1 if i is None else i
    want = sorted((key(r.doc_id), r.take_tokens) for r in rows)
    assert sorted((key(r.doc_id), len((r.text or "").split())) for r in whole.collect()) == want


def test_mixing_of_a_hot_leaf_with_equal_hashes(spark):
    """One leaf of 5000 rows, half of them with one id: equal places in the order, and the cut may fall on them."""
    rows = [(7 if i % 2 else i, f"w{i} b c", "en", "src1") for i in range(5000)] + [(9001, "x y", "en", "src2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = [("lang", F.col("lang"), F.lit(1)), ("source", F.col("source"), F.lit(1))]
    for share in ((1, 3), (1, 1), (3, 2)):
        out = mixing.mix(docs, levels, share=share).collect()
        budget = (5000 * 3 + 2) * share[0] // share[1]
        full = {r.take_tokens for r in out if r.n_tokens == r.take_tokens}
        cut = [r for r in out if r.take_tokens < r.n_tokens]
        tied = {r.doc_id for r in cut} <= {7}
        assert full and (sum(r.take_tokens for r in out) == budget or tied) and len({(r.source, r.epoch) for r in cut}) <= 2
    assert mixing.mix(docs, levels, max_epochs=1, share=(9, 1)).count() == 5001


def test_first_words(spark):
    texts = [("a b  c d", 2, "a b"), ("  a\tb c", 1, "  a"), ("a b", 5, "a b"), ("a b ", 2, "a b"), ("a", 1, "a"), ("a\nb c " * 9000, 26_000, None)]
    got = spark.createDataFrame(texts, "t string, n long, w string").select(mixing.first_words(F.col("t"), F.col("n")).alias("x"), "w", "t", "n").collect()
    assert all(r.x == r.w if r.w is not None else len(r.x.split()) == r.n and r.t.startswith(r.x) for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, docs, labels, tmp_path, empty):
    """Nulls, repeats, clashing names and empty tables through all stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs.limit(0) if empty else docs
    for name, stage in pipeline.STAGES:
        before, rows = rows, stage(spark, rows, str(tmp_path))
        assert name == "packing" or rows.columns == before.columns
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        assert (rows.count() == 0) if empty else (rows.count() > 0 or name == "quality classifier")


def test_classifiers(spark, docs, labels):
    for module in (toxicity, quality):
        rows = module.classify(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
        assert module.classify(docs.limit(0), labels).count() == 0
        assert module.classify(docs, labels.limit(0)).count() == docs.count()


def test_classifiers_fit_in_the_driver():
    """Samples as large as a table's: the driver's Python holds bits, and half the counts at a time."""
    import tracemalloc

    import numpy as np

    def peak(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    r = np.random.default_rng(5)
    labels = r.integers(0, 2, 4000)
    present = (r.random((4000, 5000), np.float32) < 0.02).astype(np.uint8)
    present[:, 4000] = labels
    number = np.arange(5000)
    assert peak(lambda: toxicity.fit(number, present, labels, number == 4000, number < toxicity.PAIR_TERMS)) < 70  # before: 235
    counts = [(np.unique(r.integers(0, 2 * quality.BUCKETS, 200)), np.ones(200)) for _ in range(2000)]
    counts = [(k, v[: len(k)]) for k, v in counts]
    assert peak(lambda: quality.fit(counts, labels[:2000])) < 2 * len(counts) * quality.BUCKETS * 4 / 1e6 + 20


def test_language(docs):
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_archives(spark, tmp_path):
    long = "x" * 150
    rows = [(1, "http://a b/", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (None, "u", long), (5, "u", None), (6, "u", "WARC/1.0\r\n\r\n" * 20), (1, "again", long), (7, "é", "é" * 80)]
    pages = spark.createDataFrame([(*r, "n", "d", 1) for r in rows], "page_id long, url string, html string, n string, digest string, id int")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to) for r in archives.archive_pages(pages, str(tmp_path / "w")).collect())
    assert got == [(-1, 150, "revisit", 1), (1, 150, "response", None), (1, 150, "response", None), (2, 150, "revisit", 1), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 240, "response", None), (7, 160, "response", None)]
    assert archives.archive_pages(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_arc_round_trip_and_faults():
    records = [archives.ArcRecord("http://a/1", "1.2.3.4", "19990102030405", "text/html", b"a\nb" * 5), archives.ArcRecord("x y", "0.0.0.0", "2001", "text/plain", b"")]
    for version in (1, 2):
        data = archives.write_arc(records, version)
        back = list(archives.read_arc(data))
        assert [(r.url, r.date, r.body) for r in back] == [("http://a/1", "19990102030405", b"a\nb" * 5), ("x%20y", "2001", b"")]
        with pytest.raises(archives.ArchiveError):
            list(archives.read_arc(data[:-12]))
    with pytest.raises(archives.ArchiveError):
        list(archives.read_arc(b"http://a 1 2 3 4\n"))
    assert archives.iso_date("19990102030405") == "1999-01-02T03:04:05Z"


def test_foreign_arc_files(spark, tmp_path):
    """Content types and addresses with blanks, blank lines between records, CRLF, bytes that are no text, gzip, faults."""
    import gzip

    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\xfe\x00bytes\n"
    about = b"1 0 someone\nURL IP-address Archive-date Content-type Archive-length\n"
    start = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain %d\n" % len(about) + about
    one = b"\nhttp://a/ 1.2.3.4 19990102030405 text/html; charset=utf-8 %d\n" % len(body) + body
    two = b"\n\n\nhttp://a/b c 1.2.3.4 19990102030406 no-type %d\r\n" % len(body) + body
    bad = b"\nhttp://broken header\nmore of it\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.arc").write_bytes(start + one + two + bad + one)
    (tmp_path / "a" / "y.arc.gz").write_bytes(b"".join(gzip.compress(p) for p in (start, one, two)))
    (tmp_path / "a" / "z.arc").write_bytes(b"nothing of the kind\n")
    rows = archives.read_arc_files(spark, str(tmp_path / "a")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.place)):
        by.setdefault(r.file.rsplit("/", 1)[1], []).append((r.url, r.content_type, None if r.body is None else bytes(r.body), r.error is None))
    first, second = ("http://a/", "text/html; charset=utf-8", body, True), ("http://a/b c", "no-type", body, True)
    assert by["x.arc"] == [first, second, (None, None, None, False), first] and by["y.arc.gz"] == [first, second]
    assert by["z.arc"] == [(None, None, None, False)]
    two = b"2 0 someone\nURL\n"
    v2 = b"filedesc://x 0.0.0.0 19990101000000 text/plain 200 - - 0 x %d\n" % len(two) + two + b"\nhttp://a b/ 1.2.3.4 19990102030405 text/html; q=1 404 abc - 77 x.arc 3\nabc"
    (r,) = archives.read_arc(v2)
    assert (r.url, r.content_type, r.body, r.extra["Result-code"], r.extra["Offset"]) == ("http://a b/", "text/html; q=1", b"abc", "404", "77")
    records = archives.convert_arc(archives.read_arc_files(spark, str(tmp_path / "a")).repartition(1))
    archives.write_warc(records, str(tmp_path / "w"), file_bytes=1500)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") for f in files)
    back = archives.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == 5 and {(r.record_type, r.payload_bytes) for r in back} == {("response", len(body) - body.index(b"\r\n\r\n") - 4)}


VECTORS = [(0, [1.0, 0.0], 1), (1, [2.0, 0.01], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [1.0, 0.02], None), (None, [1.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.03], 1), (10, [1.0, 0.03], 1), (50, [0.5, -0.25], 1), (100, [float("inf"), 1.0], 1)]


def test_embedding_duplicates(spark):
    for kind in ("float", "double"):
        rows = spark.createDataFrame([(*r, 5, "l") for r in VECTORS], f"vec_id long, embedding array<{kind}>, label int, id int, v string")
        out = embedding_dedup.near_duplicates(rows).collect()
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
        assert len(out) == len(VECTORS)
        assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[10] == (2, 0, False)
        assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 50, 100)) and got[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_top_k(spark):
    rows = spark.createDataFrame([(*r, 5, "l") for r in VECTORS], "vec_id long, embedding array<double>, label int, id int, side string")
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") % 50 == 0).collect())
    q0 = [x for x in out if x[0] == 0]
    # floor(256 * x): 2.0 is 512, 0.01 is 2; the repeated row is there twice; ties go to the smaller id
    assert [x[2] for x in q0] == [1, 2, 8, 10, 10] and q0[0][3] == 256 * 512
    assert {x[0] for x in out} == {0, 50}
    assert topk.top_k(rows.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark):
    """Components of 4096 and more, scores beyond doubles' and longs' integers, and scaled values beyond doubles."""
    import math

    r = random.Random(8)
    rows = [(i, [r.choice([1, -1]) * r.random() * 10.0 ** r.choice([0, 3, 5, 7] if i % 4 else [9, 20]) for _ in range(6)]) for i in range(120)]
    rows += [(120, [1e306, -1.5, 2.0, 0.0, 0.0, 3.0]), (121, [-1e307, 1.0, 1.0, 1.0, 0.0, 0.0]), (150, [5000.0] * 6), (151, [5000.0] * 5 + [5000.00390625])]
    ints = {i: [math.floor(x * 256) if math.isfinite(x * 256) else int(x) * 256 for x in v] for i, v in rows}
    want = {}
    for q in ints:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
            want |= {(q, n): (i, -s if -(1 << 63) <= -s < 1 << 63 else None) for n, (s, i) in enumerate(best, 1)}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == want and {q for q, _ in want} == {0, 50, 100, 150}


def test_top_k_over_many_chunks(spark, monkeypatch):
    """Clusters, copies of one vector as a third of all rows, several lengths: many chunks and groups, most of them pruned."""
    import numpy as np

    monkeypatch.setattr(topk, "CHUNK", 400)
    monkeypatch.setattr(topk, "GROUP", 100)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    x = [centres[i % 12] + rng.normal(scale=0.05, size=8) if i % 3 else centres[0] for i in range(1500)]
    x += [rng.normal(size=4) for _ in range(200)]
    ints = [np.floor(np.asarray(v) * 256).astype(int) for v in x]
    want = set()
    for q in range(0, len(x), 50):
        scores = sorted((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q and len(v) == len(ints[q]))[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == want


def test_dual_search_equals_brute_force_and_prunes():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 6)) * 900
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(scale=30, size=(3000, 6)))
    q = x[::60]
    found = topk.DualSearch(topk.CoverTree.build(q, np.arange(0, 3000, 60), 4, 1), topk.CoverTree.build(x, np.arange(3000)), 5).run()
    for i, ids, scores in zip(found.q.ids, found.found, found.scores, strict=True):
        near = sorted((-int(x[i] @ x[j]), j) for j in range(3000) if j != i)[:5]
        assert [(-int(s), j) for s, j in zip(scores, ids, strict=True)] == near
    assert found.compared < 0.5 * len(q) * len(x)


def test_stages_bound_the_bytes_of_a_batch_and_no_piece_changes(spark):
    import pyarrow as pa

    from docketry import session
    from docketry.llm import stages

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["bytes", "rows"])

    texts = spark.range(0, 3000, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" alpha beta. gamma"), 400)).alias("text"))
    spark.conf.unset(session._BATCH)
    before = packing.pack(texts, byte_bpe_encoder(packing.Encoder)).collect()
    try:
        packed = stages.packing_stage(spark, texts, "").collect()
        seen = texts.mapInArrow(sizes, "bytes long, rows long").collect()
        assert max(r.bytes for r in seen) < 1.5 * session.BATCH_BYTES and sum(r.rows for r in seen) == 3000
        assert packed == before
        spark.conf.set(session._BATCH, "123456")
        session.bound_batches(spark)
        assert spark.conf.get(session._BATCH) == "123456"
    finally:
        spark.conf.unset(session._BATCH)


def test_workers_give_freed_memory_back():
    import re
    from pathlib import Path

    import numpy as np

    from docketry.llm.common import frugal

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pins = []

    def work(batches):
        parts = [np.ones(2000) for _ in range(8000)]  # 128 MB of small blocks, and one behind them that stays
        pins.append(np.ones(2000))
        del parts
        yield from batches

    start = held()
    assert list(frugal(work)(iter([1, 2]))) == [1, 2]
    assert held() - start < 30
