"""op11 to op13 against SQL on the small tables, brute force and rows of edge cases."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from kadastra.llm import audit, gnat, licenses
from kadastra.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_licenses", "op12_filter_audit", "op13_vector_codes"])
def test_queries_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


# licenses


def by_hand(text, templates, share=licenses.CONTAINMENT):
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())]
    places, base, every, score = [], set(), set(), 0.0
    for t in templates:
        phrase = licenses.words_of(t.text)
        if t.exact:  # every exact template of the tests has words
            at = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
            places += at
            if at:
                base.add(t.label)
                score = 1.0
        elif phrase:
            half = licenses.half_width(len(phrase))
            for i in range(0, len(words), half):
                got = len(set(words[i : i + 2 * half]) & set(phrase))
                if got >= math.ceil(share * len(set(phrase)) - 1e-9):
                    every.add(t.label)
                    score = max(score, got / len(set(phrase)))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | every)), score


def found(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in licenses.find_licenses(docs, **more).collect()}
    assert len(rows) == len(texts)
    return [rows[i] for i in range(len(texts))]


def test_random_texts_of_template_words(spark):
    r = random.Random(3)
    some = [licenses.Template("x", "a b c d e"), licenses.Template("y", "b b c", True), licenses.Template("z", "e e a", True), licenses.Template("x", "f g h a i j k l"), licenses.Template("one", "q", True), licenses.Template("none", "--")]
    texts = [" ".join(r.choice("abcdefghijklmnopq"[: r.choice([6, 12, 17])]) for _ in range(r.choice([0, 1, 3, 9, 40, 200]))) for _ in range(150)]
    assert found(spark, texts, templates=some) == [by_hand(t, some) for t in texts]


def test_notices_at_every_place(spark):
    r = random.Random(4)
    every = licenses.PHRASES + licenses.NOTICES
    texts = []
    for k in range(70):
        words = licenses.words_of(licenses.NOTICES[k % len(licenses.NOTICES)].text)
        for j in r.sample(range(len(words)), r.randrange(0, len(words) // 4 + 1)):
            words[j] = "other"
        texts.append(" ".join(["Filler"] * k + words + ["filler"] * r.randrange(40)))
    got = found(spark, texts)
    assert got == [by_hand(t, every) for t in texts]
    assert sum(bool(g[5]) for g in got) > 35 and any(not g[5] for g in got)


def test_all_templates_are_found_whole(spark):
    texts = [f"Noise, noise: {t.text.upper()}!" for t in licenses.PHRASES + licenses.NOTICES]
    for t, got in zip(licenses.PHRASES + licenses.NOTICES, found(spark, texts)):
        assert t.label in got[5].split(",") and got[6] == 1.0


def test_license_texts_at_the_edges(spark, edge):
    long = "mit license " * 60_000 + "x" * 3_000_000 + " cc by"
    texts = [None, "", "  ", "MIT-License\nmit license", "MİT license", "K license mit", "Apacheé License apache license", long, "cc  BY-nc", "gnu general public", "Gnu General Public LICENSE gnu"]
    every = licenses.PHRASES + licenses.NOTICES
    assert found(spark, texts) == [by_hand(t, every) for t in texts]
    rows = licenses.find_licenses(edge).collect()
    assert len(rows) == edge.count() and sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert licenses.find_licenses(edge.where("false")).count() == 0


def test_no_templates_and_too_many(spark, edge):
    assert {r["labels"] for r in licenses.find_licenses(edge, templates=[]).collect()} == {""}
    with pytest.raises(ValueError):
        licenses.find_licenses(edge, templates=[licenses.Template("big", " ".join(map(str, range(licenses.MOST_WORDS + 1))))])


def test_prefix_join_keeps_few_pairs(spark):
    """Blocks full of a template's commonest word alone never meet it."""
    t = [licenses.Template("t", "common common2 rare1 rare2 rare3")]
    texts = ["common common2 filler"] * 50 + ["common common2 rare1 rare2"] + ["rare1 common"]
    got = found(spark, texts, templates=t)
    assert [g[5] for g in got] == [""] * 50 + ["t", ""]


# filter audit


def audited_by_hand(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails = []
    for i, t, s in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((s or "", {c for c in f if f[c]}, i))
    out = []
    for part in {p for p, _, _ in fails}:
        mine = [(f, i) for p, f, i in fails if p == part]
        total = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                total[c] += len(gone)
                rows.append((part, order, k, len(left), len(gone), sum(c in f for f, _ in mine) - len(gone), sum(f == {c} for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_by_hand(spark):
    r = random.Random(5)
    words = ["ab", "Cd", "e", "f#", "gh", "IJ", "k"]
    texts = [None, "", " \x0b\n", *(" ".join(r.choice(words[:m]) for _ in range(n)) for n in (3, 150, 199, 200, 260) for m in (1, 3, 5, 7)), " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(220)) + " A B &"]
    docs = [(i if r.random() < 0.95 else None, r.choice(texts), r.choice(["s", "t", "", None])) for i in range(300)]
    docs += [docs[0], docs[0], (5, "same id, other text", "t"), (2**40, texts[4], "u")]
    labels = [(i if r.random() < 0.9 else None, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 300, 2), *range(50)]]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, part string, good int")
    told = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, e string")
    got = sorted(tuple(x) for x in audit.audit_documents(rows, told).collect())
    assert got == audited_by_hand(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_audit_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]
    assert sorted(tuple(x) for x in audit.audit_documents(edge, none).collect()) == audited_by_hand(docs, [])
    assert audit.audit_documents(edge.where("false"), none).count() == 0
    with pytest.raises(ValueError):
        audit.audit_filters(edge, part="source", failures=["x"] * 9, good="x", toxic="x", letters="ABCDEFGHI")


def test_walk_equals_sums():
    cells = np.random.default_rng(1).integers(0, 50, (7, 32, 3))
    states = audit.gray_walk(cells)
    for s in range(32):
        assert (states[:, s] == cells[:, (np.arange(32) & s) == 0].sum(axis=1)).all()


# vector codes


@pytest.mark.parametrize("top,dims,n", [(3, 4, 64), (40, 4, 64), (300, 4, 64), (300, 2, 64), (5, 1, 64), (300, 16, 256), (10, 4, 1), (10, 4, 7), (0, 4, 64), (10**15, 4, 64)])
def test_trees_find_the_nearest(top, dims, n):
    r = np.random.default_rng(2)
    entries, q = r.integers(-top, top + 1, (n, dims)), r.integers(-top, top + 1, (3000, dims))
    q[:n] = entries[: len(q)]
    search = gnat.Search(entries, gnat.build(entries))
    code, d = search.nearest(q)
    full = gnat.squared(q.astype(object), entries.astype(object))
    assert (code == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
    if (top, dims, n) in ((300, 2, 64), (10**15, 4, 64), (5, 1, 64)):
        assert search.computed < 0.7 * full.size


def test_every_entry_is_in_the_tree_once():
    entries = np.random.default_rng(3).integers(-9, 9, (200, 3))

    def ids(node):
        return [*node.splits, *(i for c in node.children for i in ids(c))] if isinstance(node, gnat.Node) else list(node)

    assert sorted(ids(gnat.build(entries))) == list(range(200))


def test_roots_are_rounded_outwards():
    d = np.array([0, 1, 2, 3, 4, 24, 25, 26, (1 << 60) - 1, 1 << 60, (1 << 60) + 1, (1 << 62) - 1])
    for x in (d, d.astype(object)):
        assert [int(v) for v in gnat._root(x, False)] == [math.isqrt(int(v)) for v in d]
        assert [int(v) for v in gnat._root(x, True)] == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in d]


def coded_by_hand(rows):
    """code, error and label_error by vec_id order, and the digest; exact, with Python's integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    kept = [x for x in kept if len(x[1]) == len(kept[0][1])]
    whole = lambda c: math.floor(c * 256) if abs(c) < 1e100 else int(c) * 256
    x = [[whole(c) for c in v] + [0] * (-len(v) % 16) for _, v, _ in kept]
    w = len(x[0]) // 16
    cut = [[tuple(v[p * w : (p + 1) * w]) for v in x] for p in range(16)]
    books = [c[:64] for c in cut]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(books[p])) for v in cut[p]] for p in range(16)]

    for _ in range(2):
        near = assign()
        for p in range(16):
            for j in range(len(books[p])):
                own = [v for v, (_, k) in zip(cut[p], near[p]) if k == j]
                if own:
                    books[p] = [*books[p][:j], tuple(sum(c) // len(own) for c in zip(*own)), *books[p][j + 1 :]]
    near = assign()
    top = (1 << 63) - 1
    errors = [min(sum(near[p][i][0] for p in range(16)), top) for i in range(len(kept))]
    by = {}
    for (_, _, lab), e in zip(kept, errors):
        by[lab] = by.get(lab, 0) + e
    out = [(kept[i][0], "".join(f"{near[p][i][1]:02x}" for p in range(16)), errors[i], min(by[kept[i][2]], top)) for i in range(len(kept))]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("kind,scale,dims,n", [("float", 1, 64, 150), ("double", 1e-3, 32, 90), ("double", 1e12, 16, 80), ("double", 1e306, 16, 70), ("float", 0.01, 20, 40), ("float", 1, 16, 1)])
def test_codes_by_hand(spark, kind, scale, dims, n):
    r = np.random.default_rng(6)
    v = r.normal(size=(n, dims)) * scale
    v = (v.astype(np.float32) if kind == "float" else v).tolist()
    rows = [(i * 3 % n + 1, x, int(r.integers(3)) or None) for i, x in enumerate(v)]
    if n > 1:
        rows += [(200, None, 1), (201, [None, *v[0][1:]], 1), (202, [float("nan"), *v[0][1:]], 1), (203, [float("inf"), *v[0][1:]], None), (204, v[0][1:], 1), (1, v[1], 1), (None, v[2], None), (205, [], 1)]
    df = spark.createDataFrame([(*x, "clash", 7) for x in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error long").repartition(5)
    got, books = gnat.compress(df)
    want, digest = coded_by_hand(rows)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want and gnat.digest(books) == digest


def test_codes_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out, books = gnat.compress(none)
    assert out.count() == 0 and books == []
    only = spark.createDataFrame([(1, None, 1), (2, [float("nan")], 2)], "vec_id long, embedding array<float>, label int")
    assert gnat.compress(only)[0].count() == 0
    hollow = spark.createDataFrame([(1, [], 1), (2, [], 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["code"], r["label_error"]) for r in gnat.compress(hollow)[0].collect()} == {("00" * 16, 0)}


def test_sums_of_hot_and_rare_labels(spark):
    rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"rare{i // 6}", i) for i in range(12_000)] + [(-1, "big", (1 << 63) - 1), (-2, "big", 5)]
    df = spark.createDataFrame(rows, "id long, label string, error long")
    want = {}
    for _, lab, e in rows:
        want[lab] = want.get(lab, 0) + e
    got = gnat.label_sums(df, "label", "error", "label_error").collect()
    assert len(got) == len(rows) and all(r["label_error"] == min(want[r["label"]], (1 << 63) - 1) for r in got)
    assert df.where(F.col("label") == "rare0").count() == 2
