"""The registered queries: against their SQL, against plain versions on the
whole small tables, and on groups made to be hard."""

import itertools
import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, decontam, license_rules, license_scan, minhash, suffix_dedup
from sluice.llm.queries import ORACLE, QUERIES
from sluice.session import TABLES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def _norm(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    df = QUERIES[name](spark, sf)
    assert df.columns == [d[0] for d in cur.description]
    assert _norm(df.collect()) == _norm(cur.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_licenses(spark, sf, docs):
    for r in QUERIES["op1_license_scan"](spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(docs[r.doc_id].text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def expansions(tree):
    """Texts a rule's parsed regex matches: all branches and options, \0 for
    a class of many characters, repetitions none, once and as often as three."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            some = [chr(v) for _, v in arg]
        elif op in ("IN", "NOT_LITERAL"):
            some = ["\0"]
        elif op == "SUBPATTERN":
            some = expansions(arg[3])
        elif op == "BRANCH":
            some = [x for b in arg[1] for x in expansions(b)]
        else:
            assert op == "MAX_REPEAT", op
            low, high, part = arg
            some = ["".join(x) for k in {low, min(low + 1, high), min(high, 3)} for x in itertools.product(expansions(part), repeat=k)]
        out = [o + x for o in out for x in some]
    return set(out)


def test_rules_pass_their_own_gate():
    from re import _parser

    for line in license_rules.RULES.strip().splitlines():
        label, _, keywords, regex = line.split(" | ")
        if regex != "published by the free software foundation version 2":
            for text in expansions(_parser.parse(regex)):
                assert any(k in text for k in keywords.split("; ")), (label, text)


def test_license_spellings():
    for text, label in (("GNU General Public Licence version 3", "gpl-3"), ("Apache Licence 2.0", "apache-2"), ("released under the MIT Licence", "mit"),
                        ("European Union Public License 1.2", "eupl-1.2"), ("bsd style license", "bsd"), ("zlib/libpng license", "zlib"),
                        ("PNG Reference Library License", "libpng"), ("FreeType License", "freetype")):
        assert label in {d[2] for d in license_scan.detect(text)[1]}, text


def test_secrets(spark, sf, docs):
    for r in QUERIES["op2_secret_scan"](spark, sf).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secret_base(docs[r.doc_id].text)


def test_randomness_tells_keys_from_words(spark):
    from sluice.llm import secret_scan

    rng = random.Random(1)
    key = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    rows = [(i, key(40, "0123456789abcdef")) for i in range(60)] + [(100 + i, key(44, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")) for i in range(60)]
    rows += [(200 + i, "a" * 15 + "0" * 15 + "B" * (10 + i)) for i in range(60)] + [(300 + i, "www/example/com/some/long/path/to/page" + str(i)) for i in range(60)]
    got = {r.doc_id: any(s.rank == 3 for s in r.spans) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 52 and sum(got[i] for i in range(100, 160)) >= 52
    assert not any(got[i] for i in (*range(200, 260), *range(300, 360)))


def test_repeats(spark, sf, docs):
    ids = sorted(docs)
    want = dict(zip(ids, brute.repeats([docs[i].text for i in ids])))
    for r in QUERIES["op6_suffix_dedup"](spark, sf).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_loser_tree_merges_as_sorting_does():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    for k in (1, 2, 3, 7):
        runs = [sorted(words[i::k]) for i in range(k)]
        coded = [[(key, h, key) for key, h in suffix_dedup.unfold(*suffix_dedup.front_code(r))] for r in runs]
        out = list(suffix_dedup.loser_tree([iter(r) for r in coded]))
        assert [k_ for k_, _, _ in out] == sorted(words) and all(key == v for key, _, v in out)
        assert all(h == suffix_dedup.common(a, b) for (a, _, _), (b, h, _) in zip(out, out[1:]))


def test_held_out_languages(spark, sf, docs):
    rows = QUERIES["op7_language_id"](spark, sf).where("held_out").collect()
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows]) >= 0.97


def test_leaks(spark, sf, docs):
    items = {r.item_id: " ".join(brute.LETTER_WORD.findall(r.text.translate(brute.TO_LOWER))) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    text = {i: " " + " ".join(brute.LETTER_WORD.findall((r.text or "").translate(brute.TO_LOWER))) + " " for i, r in docs.items()}
    whole = {i for i, t in text.items() if any(f" {x} " in t for x in items.values())}
    got = {r.doc_id for r in QUERIES["op8_decontaminate"](spark, sf).collect()}
    assert whole <= got and len(got) <= 1.2 * len(whole) + 2


def test_edited_leaks_score_high(spark):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(500)]
    item = [rng.choice(vocab) for _ in range(40)]
    rows, hard = [], 0
    for i in range(40):
        w = list(item)
        for _ in range(i % 8):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
        rows.append((i, " ".join(rng.choices(vocab, k=100) + w + rng.choices(vocab, k=100)).upper().replace(" ", ", ")))
    rows += [(100 + i, " ".join(rng.choices(vocab, k=200))) for i in range(40)]
    rows += [(200, " ".join(rng.choices(vocab, k=50) + item[:9] + rng.choices(vocab, k=50)))]
    got = {r.doc_id: r for r in decontam.judge(spark.createDataFrame(rows, "doc_id bigint, text string"),
                                               spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()}
    assert sum(got[i].contaminated for i in range(40)) >= 39 and got[0].score == 1.0
    assert not any(got[i].contaminated for i in (*range(100, 140), 200))


@pytest.mark.parametrize("size,edits", [(20, 3), (30, 4), (40, 5), (60, 8)])
def test_single_edited_copy_is_found(spark, size, edits):
    """The only copy of an item in the corpus, with spread edits, and half a copy."""
    item = [f"item{i}" for i in range(size)]
    changed = list(item)
    for k in range(edits):
        changed[(2 * k + 1) * size // (2 * edits)] = "other"
    for copy in (changed, item[: (size + 1) // 2]):
        rows = [(1, " ".join(["before"] * 30 + copy + ["after"] * 30)), (2, "before " * 60)]
        got = decontam.judge(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).where("contaminated").collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 9))
        h = np.zeros((len(b) + 1, len(a) + 1))
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontam.align(a, b) == h.max() / (2 * len(b))


@pytest.mark.parametrize("turns", [0, 2])
def test_dense_group_of_near_copies(spark, turns):
    """Copies at 0.5 to 1 of each other, and short texts around one passage:
    most pairs share buckets and few link."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base, passage = rng.choices(vocab, k=100), rng.choices(vocab, k=30)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(rng.choices(vocab, k=rng.randrange(2, 40)) + passage)) for i in range(150, 250)]
    got = sorted((r.id, r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), turns=turns).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, brute.near_classes(rows)))


def test_pairs_at_the_pipelines_threshold_are_found(spark):
    """Groups of two at a similarity of exactly 0.8, by sets of 90 shingles."""
    rows, pairs = [], 3000
    for i in range(pairs):
        both = [f"c{i}x{k}" for k in range(84)]
        rows += [(2 * i + j, " ".join(both + [f"d{i}x{j}x{k}" for k in range(10)])) for j in (0, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80)
    assert got.where("id = component and id % 2 = 1").count() <= 0.002 * pairs


def test_recall_of_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 48)) * rng.uniform(0.2, 3, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {}
    for r in ann.nearest(df, every=50).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 3000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.argsort(-s)[:20]
        hits += len(set(best.tolist()) & set(got[q]))
        assert all(abs(got[q][i] - s[i]) < 1e-9 for i in got[q])
    assert hits >= 0.999 * 60 * 20
