"""The Jaccard join, components, piece segmentation and the pipeline against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dupstrata.llm import ngram_join, piece_codec, queries, secret_scan
from dupstrata.llm.common import table
from dupstrata.llm.components import components

MODEL = queries.PIECE_MODEL


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def joined(df, n, num, den):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n, num, den).collect()}


def test_all_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_ngram_join(spark, sf).collect()}
    assert got == classes(rows, 3, 9, 10)


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_chains_and_near_misses(spark, n, num, den):
    """Texts that drift away from each other in small steps, short ones, and ones that share a passage."""
    rng = random.Random(n)
    word = lambda: "w" + str(rng.randint(0, 400))
    passage = [word() for _ in range(40)]
    texts = []
    for size in (4, 7, 12, 25, 60, 150):
        body = [word() for _ in range(size)]
        for _ in range(22):
            texts.append(" ".join(body))
            body = list(body)
            for _ in range(max(1, rng.randint(0, size // 25))):
                k = rng.randrange(len(body))
                body[k : k + 1] = rng.choice([[word()], [], [body[k], word()]])
            body = body or [word()]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 60))]) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert joined(df, n, num, den) == classes(list(enumerate(texts)), n, num, den)


@pytest.mark.parametrize("cell, stream, leaf", [(2000, 7, 2), (6000, 2048, 4), (16 << 20, 2048, 3)])
def test_recursion(spark, monkeypatch, cell, stream, leaf):
    """With small limits: Voronoi regions over tasks, far regions, blocks, and the recursion in memory."""
    monkeypatch.setattr(ngram_join, "CELL_BYTES", cell)
    monkeypatch.setattr(ngram_join, "STREAM", stream)
    monkeypatch.setattr(ngram_join, "LEAF", leaf)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    rng = random.Random(9)
    texts = []
    for group in range(4):
        common = [f"c{group}x{i}" for i in range(70)]
        for _ in range(25):
            body = list(common)
            for _ in range(rng.choice((0, 1, 3, 6))):
                body[rng.randrange(len(body))] = f"x{rng.randint(0, 10**6)}"
            texts.append(" ".join(body + [f"x{rng.randint(0, 10**6)}" for _ in range(rng.choice((0, 2, 9, 30)))]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, num, den in ((3, 9, 10), (2, 4, 5)):
        assert joined(df, n, num, den) == classes(list(enumerate(texts)), n, num, den)


def test_cell_in_memory():
    """The join of one cell alone, of points in clusters, chains and far from all, whatever the size of its leaves."""
    import numpy as np

    rng = np.random.default_rng(3)
    for num, den, leaf in ((9, 10, 2), (4, 5, 4), (1, 2, 8)):
        g, sets = ngram_join.Geometry(num, den), []
        for _ in range(12):
            h = rng.integers(0, 2**62, 60).astype(np.uint64)
            for _ in range(int(rng.integers(1, 18))):
                sets.append(np.unique(h))
                h = h.copy()
                h[rng.integers(0, 60, int(rng.integers(1, 9)))] = rng.integers(0, 2**62)
        old, ngram_join.LEAF = ngram_join.LEAF, leaf
        try:
            cell = ngram_join.Cell(list(range(len(sets))), list(range(len(sets))), sets, g)
            cell.join(np.arange(len(sets)))
        finally:
            ngram_join.LEAF = old
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:  # noqa: B023
                x = parent[x]  # noqa: B023
            return x

        for i in range(len(sets)):
            for j in range(i):
                if ngram_join.links(sets[i], sets[j], num, den):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
        groups = lambda of: sorted(sorted(k for k in range(len(sets)) if of(k) == x) for x in {of(k) for k in range(len(sets))})  # noqa: B023, E731
        assert groups(lambda k: int(cell.lab[k])) == groups(find)  # noqa: B023
        assert all(ngram_join.links(sets[a], sets[b], num, den) for a, b in cell.links)


def test_region_bounds():
    """Linking sets of any sizes share a region."""
    import numpy as np

    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        g = ngram_join.Geometry(num, den)
        for size in [*range(2, 60), 100, 333, 1000]:
            for _ in range(6):
                a = rng.integers(0, 2**63, size, np.uint64)
                drop = rng.integers(0, size - int(np.ceil(size * num / den)) + 1)
                b = a[drop:]
                room = len(b) * den // num - size
                b = np.unique(np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, max(1, room + 1)), np.uint64)]))
                a = np.unique(a)
                if len(a) != len(b) or (a != b).any():
                    if ngram_join.links(a, b, num, den):
                        assert len(np.intersect1d(ngram_join.region_keys(a, g), ngram_join.region_keys(b, g))), (num, den, size)


def test_join_edges(spark):
    texts = [None, "", " \n", "one", "One", "two words", "two  WORDS", "É é é", "é é é", "long " * 40_000, "a b c d e f g h i j", "a b c d e f g h i j"]
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int, key string, node int")
    assert joined(df, 3, 9, 10) == classes(list(enumerate(texts)), 3, 9, 10)
    assert ngram_join.join(df.where("false")).count() == 0
    got = ngram_join.join(df.unionAll(df).unionAll(df.withColumn("doc_id", F.lit(None).cast("long"))), 3, 9, 10).collect()
    assert len(got) == 3 * len(texts) and all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 180)]
    some = [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    links = chain + star + some + chain[:3]
    rng.shuffle(links)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel.read(MODEL)


def every_path(model, unit):
    out = []

    def go(at, score, path):
        if at == len(unit):
            out.append((score, model.spell(unit, path)))
            return
        for end, s, i in model.edges(unit, at):
            go(end, score + s, [*path, (at, i)])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_as_all_paths(model):
    """Scores of the n best, and that each list of ids is another path of just that score."""
    rng = random.Random(1)
    encoder = piece_codec.Encoder(model, 4)
    for _ in range(150):
        t = "".join(rng.choice(["the", "ing", "ß", "一", "é", "\n", "x", "ab", "▁", "  ", "😀", "s"]) for _ in range(rng.randint(1, 5)))
        unit = piece_codec.MARK + t.replace(piece_codec.MARK, piece_codec.OWN_MARK).replace(" ", piece_codec.MARK)
        want = every_path(model, unit)
        (got,) = encoder.encode([t])
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in want[:4]]
        assert len({ids for _, ids in got}) == len(got)
        for score, ids in got:
            assert list(memoryview(ids).cast("i")) in [p for s, p in want if abs(s - score) < 1e-6] and encoder.decode(ids) == t
        alone = model.n_best(unit, 4)
        assert [round(s, 3) for s, _ in alone] == [round(s, 3) for s, _ in want[:4]] and len({tuple(p) for _, p in alone}) == len(alone)


def test_n_best_across_words(model):
    rng = random.Random(4)
    encoder = piece_codec.Encoder(model, 3)
    for _ in range(30):
        t = " ".join(rng.choice(["ab", "the", "s", "é", "xx"]) for _ in range(rng.randint(2, 4)))
        units = encoder.split(t)
        every = [(0.0, [])]
        for u in units:
            every = [(s + r, [*p, *q]) for s, p in every for r, q in every_path(model, u)]
        every.sort(key=lambda x: -x[0])
        (got,) = encoder.encode([t])
        assert [round(s, 3) for s, _ in got] == [round(s, 3) for s, _ in every[:3]] and len({ids for _, ids in got}) == len(got)
        for score, ids in got:
            assert list(memoryview(ids).cast("i")) in [p for s, p in every if abs(s - score) < 1e-6] and encoder.decode(ids) == t


def test_words_alone_as_together(model, monkeypatch):
    """Words over LONG take another way to the same paths, ties included."""
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdeinst一é") for _ in range(rng.randint(1, 40))) for _ in range(300)} | {"x" * k for k in range(1, 45)})
    both = []
    for limit in (48, 0):
        monkeypatch.setattr(piece_codec, "LONG", limit)
        both.append(piece_codec.Encoder(model, 3).encode(words))
    assert [[(round(s, 6), ids) for s, ids in x] for x in both[0]] == [[(round(s, 6), ids) for s, ids in x] for x in both[1]]


def test_memory(model):
    encoder = piece_codec.Encoder(model, 2)
    encoder.memory = 50
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(20)] + ["x" * 3000, "né" * 200]
    for t, ((score, ids), (second, other)) in zip(texts, encoder.encode(texts), strict=True):
        assert encoder.decode(ids) == encoder.decode(other) == t and ids != other and score >= second


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "x", "一二三国人", "абвге", "การ"])
def test_long_texts_without_a_blank(model, alphabet):
    """200,000 characters in one word; the process' memory may grow by 600 MB at most."""
    import resource

    rng = random.Random(6)
    text = "".join(rng.choice(alphabet) for _ in range(200_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    encoder = piece_codec.Encoder(model, 3)
    (got,) = encoder.encode([text])
    scores, ids = [s for s, _ in got], [x for _, x in got]
    assert scores == sorted(scores, reverse=True) and len(set(ids)) == len(ids) and all(encoder.decode(x) == text for x in ids)
    assert len(got) == 3 or not any(len(p) > 1 and set(p) <= set(alphabet) for p in model.ids)  # one way only
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_merges_as_the_models_own_encoder(model, spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = sorted({w for r in table(spark, sf, "documents").collect() for w in (r["text"] or "").split()})
    same = best = 0
    for w in words:
        own = model.merge(piece_codec.MARK + w)
        same += own == sp.encode(w)
        best += own == model.n_best(piece_codec.MARK + w, 1)[0][1]
    assert same >= 0.999 * len(words)
    print("words", len(words), "own encoder", same, "best path", best)


def test_pieces_of_all_documents(spark, sf):
    got = queries.op2_piece_codec(spark, sf).collect()
    assert len(got) == table(spark, sf, "documents").count() and all(r["round_trip"] and r["best_score"] >= r["second_score"] >= r["third_score"] for r in got)


def test_piece_edges(spark):
    texts = [None, "", " ", "  two", "▁", "a\x00b", "line\nline", "long " * 50_000, "same", "same"]
    df = spark.createDataFrame([(i, t, b"x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, ids binary, scores double")
    coded = piece_codec.encode(df, MODEL, 3)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert got[0]["ids"] is None and got[0]["round_trip"] is None and bytes(got[1]["ids"]) == b"" and all(got[i]["round_trip"] for i in range(1, len(texts)))
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(coded, MODEL).collect()}
    assert back == dict(enumerate(texts))
    assert piece_codec.encode(df.where("false"), MODEL).count() == 0


def test_pipeline_as_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    state, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf).cache()
        seen.append(state)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert state.columns == list(corpus_pipeline.COLUMNS)
    said, single, clean, mixed, coded = ([r["doc_id"] for r in s.collect()] for s in seen)
    assert len(said) == len(set(said)) >= 0.98 * len(rows)
    groups = classes([(i, rows[i]["text"]) for i in said], 5, 4, 5)
    assert sorted(single) == sorted(i for i, (_, c) in groups.items() if c == i)
    assert sorted(clean) == sorted(i for i in single if not secret_scan.find(rows[i]["text"]))
    assert set(mixed) <= set(clean) and max(map(mixed.count, set(mixed))) <= 2
    words = {i: len((rows[i]["text"] or "").split()) for i in clean}
    assert abs(sum(words[i] for i in mixed) - 1.5 * sum(words.values())) < 0.05 * sum(words.values())
    assert sorted(coded) == sorted(mixed) and all(r["round_trip"] for r in seen[-1].collect())
    assert corpus_pipeline.run(spark, sf).count() == len(coded)


def test_pipeline_edges(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, "plain words of text " * 20, "en", "a", 9), (4, "plain words of text " * 20, "en", "a", 9), (5, "der Text " * 30, "de", None, 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, blob string, size int")
    for state in (df, df.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            state = stage(spark, state, sf)
        assert all(r["round_trip"] for r in state.collect())


def test_pipeline_drops_every_kind_of_secret(spark, sf):
    secrets = ["password=abcdef1", "AKIA" + "Z9" * 8, "0a" * 12, "-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghij.abcdefghij.abcdefghij", "ftp://me:hidden1@host"]
    assert [{k for _, k, _ in secret_scan.find(t)} for t in secrets] == [{k} for k in range(6)]
    rows = [(i, f"plain words and {t} within", "en", "a", 9) for i, t in enumerate([*secrets, "none"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_secrets(spark, df, sf).collect()] == [len(secrets)]


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    """With ids that are repeated, null or stand for two texts."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(1, a, "x"), (1, a, "w"), (2, a, "x"), (2, b, "x"), (None, c, "y"), (None, c, "y"), (None, c + " end", "y"), (7, d, None), (None, d, None), (5, None, None), (5, None, None)]
    df = spark.createDataFrame([(i, t, "en", s, 9) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()]
    assert len(got) == 6 and [r for r in got if r[1] and r[1].startswith("c")][0][0] is None
    assert {r for r in got if not r[1] or not r[1].startswith("c")} == {(1, a, "w"), (2, b, "x"), (7, d, None), (5, None, None)}
    assert corpus_pipeline.drop_near_duplicates(spark, df.where("false"), sf).count() == 0
