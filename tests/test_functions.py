"""Column builders and operators on small rows, with the cases that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from kadastra.functions import columns as C
from kadastra.functions import scales as Z
from kadastra.operators import chunking as K
from kadastra.operators import evaluation as E
from kadastra.operators import graph as G
from kadastra.operators import retrieval as R
from kadastra.operators import survey as S
from kadastra.operators import text as X
from kadastra.operators import views as V
from kadastra.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_f1_cases(spark):
    cases = [((1.0, 1.0), 1.0), ((0.5, 0.5), 0.5), ((1.0, 0.5), 2 / 3), ((0.0, 0.0), 0.0), ((None, 0.0), None), ((0.5, 0.0), 0.0)]
    for (p, r), want in cases:
        got = one(spark, C.f1(F.lit(p).cast("double"), F.lit(r).cast("double")))[0]
        assert got is None if want is None else math.isclose(got, want)
    assert one(spark, C.f1(F.lit(0.0), F.lit(0.0), None))[0] is None


def test_ages(spark):
    got = one(spark, *(C.age_bucket(C.age_number(F.lit(t))) for t in ("plus de 70 ans", "24.0", "24 ans", None, "17")))
    assert got == ("65+", "18-24", C.UNKNOWN_AGE, C.UNKNOWN_AGE, "18-24")
    assert one(spark, C.age_number(F.lit("plus de 70 ans")))[0] == 71
    assert one(spark, C.age_filter(F.lit("les 25 à 35 ans")), C.age_filter(F.lit("tous")), C.age_filter(F.lit("Moins de 30"))) == ("25-34", None, "25-34")


def test_text_helpers(spark):
    assert one(spark, C.fold(F.lit("Été à Nîmes")), C.slug(F.lit("L'Île-Rousse !"), 8), C.camel_case(F.lit("qualité de vie")), C.snake_case(F.lit("hasSubPart"))) == ("ete a nimes", "l_ile_ro", "QualiteDeVie", "HAS_SUB_PART")
    import uuid

    assert one(spark, C.uuid5(F.lit("Bastia")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "Bastia"))
    assert one(spark, C.clean(F.lit(" nan ")), C.clean(F.lit(" x ")), C.first_known(F.lit(" "), F.lit("b"))) == (None, "x", "b")
    assert one(spark, C.factual_score(F.lit("il y a 10,2 et 3"), F.lit(10.0)), C.factual_score(F.lit("rien"), F.lit(3.0)), C.factual_score(F.lit("3"), F.lit(None).cast("double"))) == (1.0, 0.0, None)
    assert one(spark, C.contains_any(F.lit("avec lui"), ["vec"]), C.contains_any(F.lit("avec lui"), ["vec"], whole_words=True)) == (True, False)


def test_agreement(spark):
    df = spark.createDataFrame([("a", float(x), float(x)) for x in range(1, 6)] + [("b", float(x), float(y)) for x, y in zip([1, 2, 3, 4, 5], [4, 5, 1, 2, 3])] + [("b", None, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in E.with_p_values(E.agreement(df, ["g"], "x", "y")).collect()}
    assert math.isclose(got["a"]["pearson"], 1) and got["a"]["mae"] == 0 and got["a"]["exact_pct"] == 100 and got["a"]["p"] == 0
    assert got["b"]["mae"] > 1.5 and got["b"]["n"] == 5 and 0 < got["b"]["p"] < 1


def test_p_value_against_known(spark):
    p = E.with_p_values(spark.createDataFrame([(0.5, 12), (0.9, 5), (None, 9), (0.3, 2)], "pearson double, n long")).toPandas().p.tolist()
    assert math.isclose(p[0], 0.0978, abs_tol=5e-4) and math.isclose(p[1], 0.0374, abs_tol=5e-4) and math.isnan(p[2]) and math.isnan(p[3])


def test_scales(spark):
    s = lambda t: Z.asks_wellbeing(F.lit(t))
    assert one(spark, s("Qualité de vie à Bastia ?"), s("perception de la qualité de vie"), Z.asks_dimension_ranking(F.lit("Quelle dimension obtient la note la plus élevée")), Z.is_refusal(F.lit("Je ne dispose pas de cela"))) == (True, False, True, True)
    assert one(spark, Z.source_category(F.lit(None), F.lit("communes_geo"), F.lit(None)), Z.source_category(F.lit("x"), F.lit("y"), F.lit("enquete_methodology")), Z.source_category(F.lit("x"), F.lit(None), F.lit(None))) == ("equipements", "methodology_enquete", "autre")
    df = spark.createDataFrame([("Très satisfait",), ("Moyennement Impliqué",), (None,)], "label string")
    assert [r["score"] for r in S.encode_labels(df, Z.likert_table(spark, "five")).collect()] == [5, 3, None]
    assert one(spark, C.level(F.lit(3.6)), C.level(F.lit(6.0), "indicator"), C.level(F.lit(None).cast("double")), C.bias_phrase(F.lit(0.312)), C.p_text(F.lit(0.0312)), C.p_text(F.lit(0.5))) == ("moyen-fort", "élevé", None, "biais de +0.31 (l'humain note plus haut)", "p<0.05", "p=0.500")


def test_judge_notes_mean(spark):
    df = spark.createDataFrame([('{"a":{"note":4},"b":{"note":3},"c":{"note":5},"d":{"note":4}}',), ("broken",), (None,)], "js string")
    assert [r["global_note"] for r in X.judge_notes(df, "js", ["a", "b", "c", "d"]).collect()] == [4.0, None, None]


def test_packing_never_empty(spark):
    got = one(spark, K.pack_sentences(F.lit("One two three four. Five six. Seven."), 3), K.pack_sentences(F.lit(""), 3), K.windows(F.lit("abcdefghij"), 4, 1), K.windows(F.lit(""), 4, 1))
    assert got == (["One two three four.", "Five six. Seven."], [], ["abcd", "defg", "ghij"], [])


def test_all_null_column_is_not_ordinal(spark):
    df = spark.createDataFrame([(None, "oui"), (None, "non")], "a string, b string")
    assert S.ordinal_columns(df, {"yes": {"oui": 1, "non": 0}}) == {"b": "yes"}


def test_upsert_latest_wins_and_ties_go_to_the_new_side(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, version int")
    assert sorted(map(tuple, V.upsert(old, new).collect())) == [(1, "c", 1), (2, "b", 5), (3, "e", 1)]


def test_views_skip_blank_keys_and_keep_exempt(spark):
    df = spark.createDataFrame([("x", "j"), ("", "j"), (None, "k"), ("x", "nan")], "town string, job string")
    got = V.materialise(df, {"all": [], "town": ["town"], "both": ["town", "job"]}, [], 2, exempt=["all"])
    assert sorted((r["view_name"], r["dim1_value"], r["n"]) for r in got.collect()) == [("all", None, 4), ("town", "x", 2)]


def test_dense_search_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["doc_id"], r["rank"]) for r in R.dense_top_k(q, docs, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert R.dense_top_k(q.where("false"), docs, 2).count() == 0 and R.dense_top_k(q, docs.where("false"), 2).count() == 0


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    assert G.closure(e).count() == 12


def test_block_folder_round_trip(spark, tmp_path):
    (tmp_path / "w.txt").write_text("### Ajaccio\nRésumé : court\nDescription : long\ntexte\n---\n### Bastia\nDescription : seul\n")
    assert sorted(map(tuple, files.read_blocks(spark, str(tmp_path)).collect())) == [("Ajaccio", "court", "long\ntexte"), ("Bastia", None, "seul")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "entretien_Porto_Vecchio_3.txt").write_text("bonjour")
    (tmp_path / "f" / "empty_1.txt").write_text("  ")
    assert [tuple(r) for r in files.interview_names(files.read_folder(spark, str(tmp_path / "f"), "itw")).select("commune", "num", "source").collect()] == [("Porto_Vecchio", 3, "itw")]


@pytest.mark.parametrize("low,high,want", [(0.0, 10.0, 5.0), (5.0, 5.0, 5.0)])
def test_min_max(spark, low, high, want):
    assert one(spark, C.min_max(F.lit(5.0), F.lit(low), F.lit(high)))[0] == want
