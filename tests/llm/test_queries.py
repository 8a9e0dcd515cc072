"""The registered queries against SQL, brute force, exact round trips and held-out accuracy."""

from collections import Counter, defaultdict

import numpy as np
import pytest

queries = pytest.importorskip("docketry.llm.queries")

from tests.oracle import DATA, available, compare  # noqa: E402

pytestmark = pytest.mark.skipif(not available(), reason="no test data")
LARGER = DATA.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def shingles(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else zip(*(words[i:] for i in range(size)), strict=False))


def brute_components(rows, least=80, size=4):
    """(size, smallest reachable id) by comparing all documents that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    where = defaultdict(list)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in where[s]).items():
            if 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    want = brute_components([(r.doc_id, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_near_duplicates(spark, LARGER).collect()}
    assert got == want


def test_chains_of_near_copies_are_one_component(spark):
    """Each text differs a little from the next; the first and the last share next to nothing."""
    from docketry.llm import neardup

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i * 8 : i * 8 + 100]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(list(enumerate(texts)))
    rows = neardup.near_duplicates(docs, size=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and {c for _, c in want.values()} == {0}
    assert {r.audit_recall for r in rows} == {1.0}


def test_duplicates_go_where_the_rows_lie(spark, tmp_path):
    """The same rows stay whether the marks are broadcast at once or, past their limit, in slices of the files."""
    from docketry.llm import common, neardup

    spark.read.parquet(f"{DATA}/documents.parquet").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, c) in brute_components(rows, size=5).items() if i == c}
    at_once, in_slices = neardup.without_duplicates(docs), neardup.without_duplicates(docs, most_marks=2 * common.MARK_BYTES)
    assert "SortMergeJoin" not in at_once._jdf.queryExecution().toString()
    for kept in (at_once, in_slices, neardup.without_duplicates(docs.repartition(3))):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert len(in_slices.inputFiles()) > 1


def test_marks_are_rows_of_files(spark, tmp_path):
    """Blocks of 32,768 rows, several files, filters pushed into the scan."""
    from docketry.llm import common

    spark.range(100_000).selectExpr("id", "id % 7 as m", "'x' as text").repartition(2).write.parquet(str(tmp_path / "r"))
    rows = common.positioned(spark.read.parquet(str(tmp_path / "r")).where("m <> 3"))
    marked = common.marks(rows.where("id % 5 = 1").select("__file", "__row"))
    want = sorted(i for i in range(100_000) if i % 7 != 3 and i % 5 == 1)
    for most in (None, common.MARK_BYTES):
        assert sorted(r.id for r in common.marked_rows(rows, marked, "t", most=most).collect()) == want


def test_sets_that_link_to_equal_sets_only():
    from docketry.llm import neardup

    assert [neardup.small(p) for p in (50, 80, 90)] == [0, 3, 8] and neardup.small(100) > 1 << 60
    for p in (70, 80, 95):
        n = neardup.small(p)
        assert 100 * n < p * (n + 1) and 100 * (n + 1) >= p * (n + 2)


def test_estimates_follow_similarity():
    from docketry.llm.setsketch import Sketcher, likely, merge

    rng, sketcher = np.random.default_rng(1), Sketcher(384)
    for share, good in ((0.9, True), (0.5, False)):
        c = round(1000 * 2 * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2000 - c, dtype=np.uint64)
        a, b = x[:1000], x[1000 - c :]
        pair = [sketcher(a)[None], sketcher(b)[None]]
        assert likely(*pair, np.array([1000.0]), np.array([1000.0]), 0.74)[0] == good
        assert (merge(pair[0][0], pair[1][0]) == sketcher(np.union1d(a, b))).all()


def test_embedding_links_equal_brute_force(spark):
    from docketry.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(n, 16)) for c, n, s in zip(centres, [60, 40] + [3] * 28, [0.1, 0.2] + [0.15] * 28, strict=True)])
    labels = rng.integers(0, 2, len(x))
    rows = [(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    assert all(got[i].n_links == link[i].sum() for i in range(len(x)))
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.minimum(part, np.where(link, part[None, :], len(x)).min(1))
    assert all(got[i].component_id == part[i] for i in range(len(x)))


def linked_groups(groups, copies, angle, noise, seed=5):
    """Unit vectors of `groups` pairs of dense groups: the two of a pair lie `angle` apart (cosine)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= (b @ a) * a
        b = angle * a + np.sqrt(1 - angle * angle) * b / np.linalg.norm(b)
        out += [c + rng.normal(scale=noise, size=32) for c in [a] * copies + [b] * copies]
    return np.array(out)


def brute_links(x, least=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= least) & ~np.eye(len(x), dtype=bool)
    part = np.arange(len(x))
    for _ in range(len(x)):
        part = np.minimum(part, np.where(link, part[None, :], len(x)).min(1))
    return link.sum(1).tolist(), part.tolist()


@pytest.mark.parametrize(("noise", "enough"), [(0.0, 0.98), (1e-4, 0.98), (1e-4, 2.0)])
def test_links_between_groups_that_fill_each_others_lists(spark, monkeypatch, noise, enough):
    """20 copies of A and 20 of B, exact or nearly so, with cos(A, B) = 0.95; the last case only passes by the exact way."""
    from docketry.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "ENOUGH", enough)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    x = linked_groups(6, 20, 0.95, noise)
    rows = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept, r.audit_recall) for r in embedding_dedup.near_duplicates(rows).collect())
    want = [(i, n, c, i == c, 1.0) for i, (n, c) in enumerate(zip(*brute_links(x), strict=True))]
    assert got == want and {n for _, n, *_ in want} == {39}


def test_classifiers_on_held_out_rows(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    for query, column, least in ((queries.op7_toxicity, "toxic", 0.9), (queries.op9_quality, "quality", 0.9)):
        rows = [r for r in query(spark, LARGER).collect() if r.held_out and r.doc_id in labels]
        right = sum(r.predicted == labels[r.doc_id][column] for r in rows)
        assert right / len(rows) >= least, (column, right, len(rows))


def pair_texts(kind, n=1600, seed=4):
    """Texts whose label the words zork and quux decide together only; each alone tells nothing (xor) or little."""
    import random

    r = random.Random(seed)
    words = [f"{a}{b}{c}ar" for a in "bcdfglm" for b in "aeiou" for c in "npqrstvz"]
    rows = []
    for i in range(n):
        chosen = r.sample(words, 40)
        a, b = r.random() < 0.4, r.random() < 0.4
        rows.append((i, " ".join(chosen + ["zork"] * a + ["quux"] * b), int(a != b if kind == "xor" else a and b)))
    return rows


@pytest.mark.parametrize("kind", ["xor", "and"])
def test_toxicity_learns_pairs_that_tell_nothing_alone(spark, kind):
    from docketry.llm import toxicity

    rows = pair_texts(kind)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.classify(table.select("doc_id", "text"), table.select("doc_id", "toxic"), threshold=0.5).collect()
    want = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.93 * len(held) and len(held) > 400


def test_the_machines_scores_are_the_sums_over_pairs():
    """Scores, and the gradient that training uses, against plain loops and differences."""
    from docketry.llm import toxicity

    rng = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(np.arange(9, dtype=np.uint32), -0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    parts = [np.flatnonzero(rng.random(9) < 0.5) for _ in range(20)] + [np.zeros(0, int)]
    for part, got in zip(parts, model.rows(parts), strict=True):
        y = model.bias + sum(model.weights[i] for i in part)
        y += sum(float(model.vectors[i] @ model.vectors[j]) for n, i in enumerate(part) for j in part[n + 1 :])
        assert abs(got - 1 / (1 + np.exp(-y))) < 1e-9
    present = (rng.random((64, 9)) < 0.5).astype(np.uint8)
    labels = (present[:, 0] & present[:, 1]).astype(int)
    bias, params = toxicity.descend(present, labels, rank=3, epochs=200, decay=0.0, spread=0.1)
    fitted = toxicity.FactorizationMachine(np.arange(9), bias, params[:, 0], params[:, 1:])
    assert ((fitted.rows([np.flatnonzero(p) for p in present]) >= 0.5) == labels).all()


def test_language_on_held_out_rows(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_language(spark, LARGER).collect() if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in rows) / len(rows) >= 0.9


def test_token_counts_are_the_librarys(spark):
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.n_tokens == len(encoder.encode(texts[r.doc_id])) for r in queries.op5_token_counts(spark, DATA).collect())


def test_frequent_pre_tokens_are_merged_in_a_tree(spark):
    from docketry.llm import token_counts

    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = Counter(u for t in texts for u in token_counts.pre_tokens(t or "") if t and len(u) <= token_counts.LONGEST)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    got = token_counts.frequent_pre_tokens(docs, most=300, fan=2)
    assert len(got) == 300 and min(want[u] for u in got[:100]) >= sorted(want.values())[-110]


def test_the_byte_networks_scores_are_those_of_plain_loops(spark):
    """Forward pass and gradient against loops and differences; texts are the mean of all their windows."""
    from docketry.llm import langid

    rng = np.random.default_rng(6)
    net = langid.ByteNet.new(["a", "b", "c"])
    for p in (*net.biases, net.shift):
        p += rng.normal(size=p.shape).astype(np.float32)

    def plain(window):
        pooled = []
        for width, f, b in zip(langid.WIDTHS, net.filters, net.biases, strict=True):
            for k in range(langid.FILTERS):
                best = max(sum(float(net.embedding[window[i + o]] @ f[o * langid.EMBEDDING : (o + 1) * langid.EMBEDDING, k]) for o in range(width)) for i in range(len(window) - width + 1))
                pooled.append(max(0.0, best + float(b[k])))
        z = np.array(pooled) @ net.dense + net.shift
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    texts = ["Ein kurzer Text.", "und " * 200, "é" * 300]
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for r, text in zip(sorted(rows), texts, strict=True):
        windows = langid.windows_of(text.encode())
        letters = [sum(b > 127 or chr(b).isalpha() for b in w.tolist()) for w in windows]
        want = sum(plain(w) * n for w, n in zip(windows, letters, strict=True)) / sum(letters)
        assert r.lang_pred == net.classes[int(want.argmax())] and abs(r.score - want.max()) < 1e-4
    windows = rng.integers(1, 255, (8, langid.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 3, 8)
    before = -np.log(net(windows)[np.arange(8), labels]).mean()
    net.fit(windows, labels, epochs=30)
    assert -np.log(net(windows)[np.arange(8), labels]).mean() < 0.2 * before


def test_every_language_is_learned_from_whole_texts(spark):
    """300 languages; and a text whose last windows alone are in another language than its first."""
    from docketry.llm import langid

    rows = [(i, " ".join(chr(0x4E00 + i) * 3 for _ in range(30)), f"l{i:03d}") for i in range(300)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.classes) == 300
    mixed = [(i, "1 2 3 " * 400 + ("uno due tre " if i % 2 else "eins zwei drei ") * 300, "it" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string")
    assert all(r.lang_pred == ("it" if r.doc_id % 2 else "de") for r in langid.identify(docs).collect())


def test_votes_equal_plain_loops():
    from docketry.llm import quality

    counts = quality.Counts()
    good = [f"a plain sentence about thing {i} and its kind." for i in range(40)]
    poor = [f"BUY|{i}| now!!! $$$ {i}" for i in range(40)] + ["", None]
    model = quality.fit([counts(t) for t in good + poor], np.array([1] * 40 + [0] * 42))
    texts = [*good[:3], *poor[:3], "", None, "  \n", "zzz", "x" * 5000, "語" * 300]
    x = model.embed([counts(t) for t in texts])
    for row, got in zip(x, model([counts(t) for t in texts]), strict=True):
        near = [round(float(row @ v), 9) for v in model.vectors]
        last = sorted(near)[-quality.NEIGHBOURS]
        votes = [(max(s, 1e-6) ** 4, y) for s, y in zip(near, model.labels, strict=True) if s >= last]
        assert abs(got - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 1e-6
    assert model([counts(None)])[0] < 0.3 and (model([counts(t) for t in good]) > 0.7).all()
    assert quality.shape("x" * 100 + "9") == "a9"


def test_words_alone_can_tell_quality():
    from docketry.llm import quality

    import random

    r, counts = random.Random(1), quality.Counts()
    text = lambda words: " ".join(r.choice(words) for _ in range(60))
    kinds = ["river stone cloud meadow lantern copper walnut harbor".split(), "deal offer click cheap winner bonus casino credit".split()]
    train = [(text(kinds[y]), 1 - y) for y in (0, 1) for _ in range(60)]
    model = quality.fit([counts(t) for t, _ in train], np.array([y for _, y in train]))
    assert all((model([counts(text(kinds[y]))])[0] >= 0.5) == (y == 0) for y in (0, 1) for _ in range(20))


def test_packing_pads_little(spark):
    rows = queries.op4_packing(spark, LARGER).collect()
    size = defaultdict(int)
    for r in rows:
        size[r.sequence_id] += r.length
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in size.values())
    assert max(size.values()) <= 1024 and pad <= 0.03 * sum(size.values())


def test_fast_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    from docketry.llm.packing import Encoder

    encode = queries.byte_bpe_encoder(Encoder)()
    plain, r = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), random.Random(9)
    for _ in range(2000):
        text = "".join(r.choice("ab'st 1²½\n\t  é　ß‘’x\x00\x1c\x85\xa0!?😀") for _ in range(r.randint(0, 16)))
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pipeline_stages(spark):
    """Filters take out what the operators reject, one of each group stays, and all that is left is packed."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from docketry.llm import mixing, neardup, quality, toxicity
    from docketry.llm.common import crc_of_id, stored

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA), "test")
        if name != "packing":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.train(before, labels.where(crc_of_id("doc_id") % 3 != 1))
            scores = {r.doc_id: r.score for r in toxicity.score(before, model).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
        if name == "quality classifier":
            model = quality.train(before, labels.where(crc_of_id("doc_id") % 5 != 0))
            scores = {r.doc_id: r.score for r in quality.score(before, model).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
        if name == "MinHash near-dedup":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()], size=5)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
            assert neardup.ROWS * neardup.BANDS <= neardup.REGISTERS
        if name == "mixing":
            want = Counter(r.doc_id for r in mixing.mix(before, queries.mix_levels()).collect())
            assert Counter(r.doc_id for r in docs.collect()) == want
            kept = want
        if name == "packing":
            ends = Counter(r.doc_id for r in docs.collect() if r.start + r.length == r.doc_tokens)
            assert ends == kept
    assert pipeline.ORACLE_SQL is None
