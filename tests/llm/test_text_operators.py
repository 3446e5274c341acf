"""Secrets, quality rules, language ID and toxicity against plain models, and their edge cases."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from dupstrata.llm import language_id, quality_rules, queries, secret_scan, toxicity, transducers
from dupstrata.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, key string"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), None, None, 0.5, "x", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "x", "é" * 50_000, "word " * 60_000, "!!! 123 ***", "\x0b\x0c\r", "a\x00b", "same text here", "same text here"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, "extra") for i in range(5)], "doc_id long, quality int, toxic int, text string")


def plain_spans(text):
    found = []
    for k, pattern, least, group in ((0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (1, r"AKIA[A-Z0-9]+", 20, 0), (2, r"[0-9a-f]+", 24, 0)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets_of_all_documents(spark):
    sf, want = "/root/testdata/sf0.01", {}
    for r in table(spark, sf, "documents").collect():
        base = plain_spans(r["text"] or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        want[r["doc_id"]] = (*[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(said.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries.op5_secret_scan(spark, sf).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_secret_spans():
    for t in ("é token: 'abcdef' AKIA" + "Z9" * 8, "ſecret=abcdefgh toKen=abcdefgh", "password=abc secret=abcdef1", "token: secret=abcdef", "AKIAAKIA" + "A" * 11, "AKIA" + "A" * 15, "f" * 23 + " " + "0" * 24 + "g", 'api_key":"x.y-z+1', "APIKEY = = abcdefg"):
        assert [s for s in secret_scan.find(t) if s[1] < 3] == plain_spans(t), t
    kinds = {k for _, k, _ in secret_scan.find("-----BEGIN RSA PRIVATE KEY----- eyJabcdefghij.abcdefghij.abcdefghij ftp://me:secret1@host")}
    assert kinds >= {3, 4, 5}


def test_secrets_as_sql(spark):
    """Pieces of patterns in any order, by the SQL and by the scan."""
    rng = random.Random(8)
    pieces = ["password", "PassWD", "ſecret", "secret", "api_key", "APIKEY", "token", "=", ":", " ", "  ", "'", '"', "abcdef", "x9/_.", "AKIA", "Z9" * 5, "Z9" * 8, "0f" * 11, "0f" * 12, "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "PRIVATE KEY", "eyJabcdefghi", ".abcdefghi_", "ftp://me:hidden1@host", "://", "@", ""]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate([*texts, None])))
    got = {r[0]: r[1:] for r in con.execute(f"select doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob from ({secret_scan.ORACLE})").fetchall()}
    for i, t in enumerate([*texts, ""]):
        d = secret_scan.digest(secret_scan.find(t))
        assert got[i] == (d["n_assign"], d["n_access"], d["n_hex"], d["base_sha256"], d["spans"], hashlib.sha256(t.encode()).hexdigest()), t


def test_secret_edges(spark, tmp_path):
    d = docs(spark, ODD)
    got = secret_scan.scan_with_ledger(spark, d, f"{tmp_path}/a").collect()
    assert len(got) == len(ODD) and {r["n_assign"] for r in got} == {0}
    assert secret_scan.scan_with_ledger(spark, d.where("false"), f"{tmp_path}/b").count() == 0
    assert secret_scan.scan_with_ledger(spark, d.unionAll(d), f"{tmp_path}/c").count() == 2 * len(ODD)


def test_ledger_scans_only_what_it_lacks(spark, tmp_path, monkeypatch):
    """Also after a run that was repeated, with the missing addresses joined instead of sent, and under other rules."""
    path = f"{tmp_path}/ledger"
    first = docs(spark, ["token=abcdef", "clean", "clean"])
    assert secret_scan.scan_with_ledger(spark, first, path).count() == 3
    assert secret_scan.entries(spark, path).count() == 2 and secret_scan.extend(spark, first, path) == 0
    spark.read.parquet(f"{path}/rules={secret_scan.RULES_VERSION}").write.mode("append").parquet(f"{path}/rules={secret_scan.RULES_VERSION}")  # what a repeated run leaves
    more = docs(spark, ["token=abcdef", "clean", "secret: 1234567", "token=abcdef"])
    monkeypatch.setattr(secret_scan, "BROADCAST_BLOBS", 0)
    assert secret_scan.extend(spark, more, path) == 1
    got = {r["doc_id"]: r["n_assign"] for r in secret_scan.scan_with_ledger(spark, more, path).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 1} and secret_scan.entries(spark, path).count() == 3
    assert secret_scan.scan_with_ledger(spark, first, path).count() == 3
    monkeypatch.setattr(secret_scan, "RULES_VERSION", "other")
    assert secret_scan.extend(spark, more, path) == -1 and secret_scan.entries(spark, path).count() == 3


def test_query_finds_its_ledger_complete(spark, sf):
    got = queries.op5_secret_scan(spark, sf).collect()
    docs_, ledger = table(spark, sf, "documents"), secret_scan.ledger_of(spark, f"{sf}/documents")
    assert secret_scan.extend(spark, docs_, ledger) == 0
    assert sorted(queries.op5_secret_scan(spark, sf).collect()) == sorted(got)


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_of_all_documents(spark, sf):
    got = {r["doc_id"]: (*[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],) for r in queries.op8_quality_rules(spark, sf).collect()}
    assert got == {r["doc_id"]: plain_quality(r["text"]) for r in table(spark, sf, "documents").collect()}


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality_rules(spark, d).join(table(spark, d, "labels"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    poor = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.98 and sum(poor) / len(poor) < 0.5


def test_quality_edges(spark, labels):
    for t in [*ODD, "a b a b a b a b", "x\nx\n\nx", "\x85\u2003"]:
        assert quality_rules.statistics(None if t is None else t.encode())[:5] == plain_quality(t)[:5]
    got = quality_rules.judge(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.judge(docs(spark, ODD).where("false"), labels).count() == 0
    assert quality_rules.judge(docs(spark, ODD), labels.where("false")).count() == len(ODD)


def test_isolation_forest_finds_the_odd_one():
    import numpy as np

    rows = np.random.default_rng(0).normal(size=(500, 9))
    forest = quality_rules.IsolationForest(rows)
    scores = forest.scores(np.vstack([rows, np.full((1, 9), 9.0)]))
    assert scores.argmax() == 500 and (forest.scores(rows) == quality_rules.IsolationForest(rows).scores(rows)).all()
    assert quality_rules.IsolationForest(np.ones((3, 9))).scores(np.ones((2, 9))).tolist() == [pytest.approx(0.5, abs=0.5)] * 2


def test_language_accuracy_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 250 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    langs = {i: ("en", "de", "fr", "xx", None)[i % 5] for i in range(11)}
    got = {r["doc_id"]: r for r in language_id.identify(docs(spark, ODD, langs)).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2, 6, 7}
    assert got[0]["score"] == 0 and set(r["lang_pred"] for r in got.values()) <= {"und", "en", "de", "fr", "xx"}
    assert language_id.identify(docs(spark, ODD).where("false")).count() == 0
    unlabelled = docs(spark, ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}
    one = docs(spark, ["hello there", "good day", "well then"] * 3)
    assert {r["lang_pred"] for r in language_id.identify(one).collect()} == {"en"}


def test_language_never_reads_labels_when_predicting(spark, sf):
    d = table(spark, sf, "documents")
    model = language_id.fit(d, F.lit(True))
    moved = d.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", -F.col("doc_id"))
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.classify(d, model).collect()}
    assert a == {-r["doc_id"]: r["lang_pred"] for r in language_id.classify(moved, model).collect()}


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").collect()
    bad, fine = [r["score"] for r in got if r["toxic"] == 1], [r["score"] for r in got if r["toxic"] == 0]
    assert sum(a > b for a in bad for b in fine) / len(bad) / len(fine) > 0.95
    assert sum(s < 0.5 for s in fine) / len(fine) > 0.98 and sum(s >= 0.5 for s in bad) / len(bad) > 0.85


def chain():
    g = toxicity.Grammar(insult={})
    return [toxicity.insult(), toxicity.threat(), *(toxicity.context(f) for f in toxicity.FLAGS), toxicity.weigh(g.negated, g.reported, g.aimed)]


def best_by_enumeration(parts, string):
    """Every path of the first, every path of the second over what that wrote, and so on."""
    some = [(tuple(string), 0.0)]
    for t in parts:
        some = [(out, w + more) for said, w in some for out, more in t.paths(said)]
    return max((w for _, w in some), default=None)


def test_composition_as_enumeration():
    """Random transducers with several starts, readings and dead ends."""
    rng = random.Random(3)
    for _ in range(40):
        parts = []
        for _ in range(3):
            t = transducers.Transducer({0, rng.randint(0, 2)}, {rng.randint(0, 2), rng.randint(0, 2)})
            for _ in range(rng.randint(3, 14)):
                t.add(rng.randint(0, 2), rng.choice("ab"), rng.choice("ab"), rng.randint(-4, 4), rng.randint(0, 2))
            parts.append(t)
        whole = transducers.compose(transducers.compose(parts[0], parts[1]), parts[2])
        small = transducers.trimmed(whole)
        for n in range(5):
            for string in itertools.product("ab", repeat=n):
                want = best_by_enumeration(parts, string)
                assert whole.best(string) == small.best(string) == want, string


def test_grammar_as_enumeration():
    """All clauses of up to 3 symbols and random longer ones."""
    g = toxicity.Grammar(insult={})
    whole, parts = toxicity.machine(g.negated, g.reported, g.aimed), chain()
    few = [(0, "other"), (0, "threat"), (0, "target"), (0, "negation"), (0, "reported"), (3, "other"), (8, "target"), (12, "threat")]
    rng = random.Random(6)
    clauses = [c for n in range(4) for c in itertools.product(few, repeat=n)] + [[rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(4, 7))] for _ in range(60)]
    for c in clauses:
        assert whole.best(c) == pytest.approx(best_by_enumeration(parts, c)), c


def plain_clause(words, g):
    """The score by the grammar's meaning: each word that is an insult or a threat, and also something else, is taken as either."""
    readings = []
    for w in words:
        level, other = g.symbol(w)
        readings.append([other] + [level] * (level > 0))
    best = None
    for taken in itertools.product(*readings):
        has = {f for f in toxicity.FLAGS if f in taken}
        factor = (g.negated if "negation" in has else 1) * (g.reported if "reported" in has else 1) * (g.aimed if "target" in has else 1)
        threat = toxicity.THREAT_WEIGHT * (1 if "target" in has else toxicity.UNAIMED)
        score = factor * sum(threat if x == "threat" else x * toxicity.UNIT if isinstance(x, int) else 0 for x in taken)
        best = score if best is None else max(best, score)
    return best


def test_clauses():
    g = toxicity.Grammar(insult={b"fool": 1.0, b"she": 0.5}, stems={b"idio": 0.75})
    reader = toxicity.Reader(g)
    rng = random.Random(2)
    words = ["fool", "she", "idiotic", "kill", "you", "not", "said", "the", "never", "cat"]
    for _ in range(400):
        clause = [rng.choice(words).encode() for _ in range(rng.randint(0, 7))]
        want = plain_clause(clause, g)
        assert reader.measure(b" ".join(clause))[1] == pytest.approx(want), clause
    score = lambda t: reader.measure(t.encode())[1]
    assert score("you fool") > score("a fool") > score("not a fool") and score("a fool you are not") < score("a fool you are") and score("a fool she said") < score("a fool")
    assert score("kill you") > score("kill it") > 0 == score("not said you")


def test_toxicity_edges(spark, labels):
    d = docs(spark, ODD)
    got = toxicity.rate(d, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.rate(d.where("false"), labels).count() == 0
    assert toxicity.rate(d, labels.where("false")).count() == len(ODD)
    assert toxicity.rate(d.unionAll(d), labels.unionAll(labels)).count() == 2 * len(ODD)
