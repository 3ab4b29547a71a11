"""Fixtures with answers worked out by hand, and invariants of the kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from troupe.functions import names as N
from troupe.functions import text as T
from troupe.operators import facts, kernels, lanes, matching, ngrams, tags, vectors
from troupe.sources import readers, writers
from troupe.streaming import intake


def one(spark, sql_columns, *columns):
    return spark.sql(f"select {sql_columns}").select(*columns).head()


# functions --------------------------------------------------------------------------------------------------------


def test_name_forms_differ(spark):
    df = spark.createDataFrame([("José Álvarez",), ("Joséa B",), ("Kim (the &amp; elder)",), (None,)], "x string")
    got = [tuple(r) for r in df.select(N.norm_a("x"), N.norm_b("x"), N.norm_c("x")).collect()]
    assert got == [("jos lvarez", "jos lvarez", "jos lvarez"), ("jos a b", "josa b", "josa b"), ("kim the amp elder", "kim the amp elder", "kim"), (None, None, "")]


def test_keys(spark):
    df = spark.createDataFrame([("c b a",), ("solo",), ("漢字",)], "x string")
    assert [sorted(r[0]) for r in df.select(N.keys_c("x")).collect()] == [sorted(["c b a", "a b c", "c b", "b c"]), ["solo"], []]
    assert [sorted(r[0]) for r in df.select(N.search_aliases("x", F.lit("名前"))).collect()] == [["a b c", "c b a"], ["solo"], []]


def test_values_of_json_or_text(spark):
    df = spark.createDataFrame([('{"full": "", "userPreferred": "B"}',), ("Plain",), (None,), (" ",), ("{broken",)], "x string")
    assert [r[0] for r in df.select(N.display_name("x")).collect()][:4] == ["B", "Plain", "", ""]
    got = one(spark, "0 as a, cast(null as int) as b, 1999 as c, 'https://x/anime/12/y' as u", N.first_year("a", "b", "c"), N.id_in_address("u"), N.address("p/", "a"), N.address("p/", "c"))
    assert tuple(got) == (1999, 12, "", "p/1999")


def test_normalisers(spark):
    x = r"""'<b>A</b> &amp; [link](https://a.b/c) [i]x[/i] https://q.r café\\n_e_  z'"""
    got = one(spark, f"{x} as x", T.normalize_description("x"), T.normalize_semantic("x"), T.normalize_source("x"))
    assert got[0].split() == "a & link x cafe _e_ z".split() and got[1].split()[:4] == ["a", "&", "link", "x"] and "link" not in got[2] and "&amp;" in got[2]
    assert one(spark, "cast(null as string) as x", T.normalize_description("x"), T.slug("x", "tags"))[:] == ("", "tags")


def test_evidence(spark):
    cases = [
        ("alpha beta", True), ("alpha ... gamma", True), ("gamma ... alpha", False), ("ALPHA   Beta", True), ('"beta gamma"', True), ("beta ... beta", False), ("", False), (None, False), ("abc", False), ("...", False),
    ]
    df = spark.createDataFrame([(e, w) for e, w in cases], "e string, want boolean").withColumn("d", F.lit("Alpha <i>beta</i> gamma delta"))
    assert [r[0] for r in df.select(T.evidence_supported("e", "d")).collect()] == [w for _, w in cases]


def test_phrases_and_padding(spark):
    df = spark.createDataFrame([(["A  b", "a B", " ", "one two three four", "x."], "f")], "v array<string>, f string")
    got = df.select(T.distinct_ignoring_case("v"), T.short_phrases("v", "f", 2), T.padded(F.array(F.lit("p"), F.lit("q"))), T.short_phrases(F.array(F.lit(" ")), "f", 2)).head()
    assert got[0] == ["A b", "one two three four", "x."] and got[1] == ["A b", "x"] and got[2] == ["p", "q", "q", "q"] and got[3] == ["f"]


def test_json_in_text(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('say {"k": 2} now',), ("none",), (None,)], "x string")
    assert [r[0] and r[0].k for r in df.select(T.json_object("x", "k int")).collect()] == [1, 2, None, None]
    label = '{"label": "a", "description": "d", "confidence": "HIGH", "evidence_terms": ["t", "u", "t"]}'
    df = spark.createDataFrame([(f"thought {{}} {label.replace('HIGH', 'odd')} then {label} end", ["t"]), ("none", ["t"])], "x string, terms array<string>")
    got = [r[0] for r in df.withColumn("l", T.last_label("x")).select(T.valid_label(F.col("l"), F.col("terms"))).collect()]
    assert (got[0].label, got[0].confidence, got[0].evidence_terms) == ("a", "high", ["t", "t"]) and got[1].confidence == "medium"


def test_windows(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.windows("t", 2, 3)).collect()] == [["a b", "b c", "a b c"], [], []]


# facts and lanes --------------------------------------------------------------------------------------------------


def _edge(spark, rows):
    schema = "split string, seiyuu_id bigint, seiyuu_name string, character_id bigint, character_name string, character_role string, anime_start_year int, anime_year int, anime_season_year int, anime_id bigint, anime_title string, ingested_at timestamp"
    return spark.createDataFrame(rows, schema)


def test_edge_rollup(spark):
    from datetime import datetime

    rows = [("s", 1, "V", 2, "C", "MAIN" if y == 2003 else "EXTRA", y, None, None, 10 + i, f"T{i}", datetime(2024, 1, 1 + abs(i - 2))) for i, y in enumerate([*range(2001, 2009), 0])]
    got = facts.role_pairs(_edge(spark, rows + rows[:3])).head()
    assert (got.credit_count, got.first_year, got.latest_year, got.character_role, len(got.works)) == (9, 2001, 2008, "MAIN", 8)
    assert [w.year for w in got.works] == list(range(2001, 2009))
    assert facts.role_pairs(_edge(spark, [])).count() == 0


def test_mass_prefix(spark):
    df = spark.createDataFrame([("g", "a", 5.0), ("g", "b", 3.0), ("g", "c", 2.0), ("z", "a", 0.0), ("n", "a", -1.0)], "g string, t string, w double")
    assert sorted(r.t for r in lanes.mass_prefix(df, "g", "t", "w", 0.90).collect()) == ["a", "b", "c"]
    assert sorted(r.t for r in lanes.mass_prefix(df, "g", "t", "w", 0.75).collect()) == ["a", "b"]


def test_amplitude_prefix_keeps_all_of_a_zero_vector(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, -3.0), (2, 1, 0.1)], "g int, k int, v double")
    assert sorted((r.g, r.k) for r in lanes.amplitude_prefix(df, "g", "k", "v", 0.99).collect()) == [(1, 0), (1, 1), (2, 0)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=25))
def test_shares_sum_to_one(spark, rows):
    df = spark.createDataFrame([(r, c, float(v)) for r, c, v in rows], "r int, c int, v double")
    for r in lanes.shares(df, "r", "c", "v").groupBy("r").agg(F.sum("share").alias("s")).collect():
        assert r.s == pytest.approx(1.0) or r.s == 0.0


# n-grams ----------------------------------------------------------------------------------------------------------


def _tagged(spark, *docs):
    rows = [(d, i, t, p) for d, doc in enumerate(docs) for i, (t, p) in enumerate(doc)]
    return ngrams.tagged_tokens(spark.createDataFrame(rows, "doc_id int, token_no int, token string, tag string"))


def test_windows_bridge_short_words(spark):
    got = ngrams.descriptor_ngrams(_tagged(spark, [("captain", "NN"), ("of", "IN"), ("team", "NN")]))
    assert [tuple(r) for r in got.collect()] == [(0, "captain team", 1)]


def test_adjective_phrases_suppress_without_being_emitted(spark):
    assert ngrams.descriptor_ngrams(_tagged(spark, [("brave", "JJ"), ("team", "NN"), ("captain", "NN")])).count() == 0
    got = ngrams.descriptor_ngrams(_tagged(spark, [("team", "NN"), ("team", "NN"), ("was", "VBD"), ("brave", "JJ"), ("ran", "VBD"), ("singing", "VBG"), ("contest", "NN")]))
    assert sorted(r.term for r in got.collect()) == ["brave", "singing contest"]


def test_descriptors_equal_a_plain_version(spark):
    import random

    rng = random.Random(7)
    words = [("brave", "JJ"), ("tall", "JJ"), ("team", "NN"), ("captain", "NN"), ("heroes", "NNS"), ("singing", "VBG"), ("ran", "VBD"), ("of", "IN"), ("Rome", "NNP"), ("the", "DT"), ("whole", "NN"), ("ox", "NN")]
    docs = [[rng.choice(words) for _ in range(rng.randrange(14))] for _ in range(60)]
    want = {}
    for d, doc in enumerate(docs):
        kept = [(i, t.lower(), p) for i, (t, p) in enumerate(doc) if len(t) >= 3]
        found = [(i, i, 1, t, False) for i, t, p in kept if p == "JJ"]
        for size in range(2, 7):
            for at in range(len(kept) - size + 1):
                w = kept[at : at + size]
                tags_ = [p for _, _, p in w]
                fine = all(p in ("JJ", "NN", "NNS", "VBG") and t not in T.PHRASE_STOPWORDS for _, t, p in w) and all(a[1] != b[1] for a, b in zip(w, w[1:]))
                if fine and ("VBG" not in tags_ or "NN" in tags_ or "NNS" in tags_):
                    found.append((w[0][0], w[-1][0], size, " ".join(t for _, t, _ in w), "JJ" in tags_))
        for first, last, size, term, adjective in found:
            if not adjective and not any(size < s and f <= first and last <= e for f, e, s, _, _ in found):
                want[d, term] = want.get((d, term), 0) + 1
    got = {(r.doc_id, r.term): r.occurrences for r in ngrams.descriptor_ngrams(_tagged(spark, *docs)).collect()}
    assert got == want


def test_suppressed_adjectives_count_both_sides(spark):
    docs = _tagged(spark, [("brave", "JJ"), ("hero", "NN"), ("was", "VBD"), ("brave", "JJ")], *[[("brave", "JJ"), ("hero", "NN")]] * 4)
    got = ngrams.suppressed_adjectives(docs, threshold=0.8).head()
    assert (got.adjective, got.standalone_docs, got.blocked_docs) == ("brave", 1, 5)
    assert ngrams.suppressed_adjectives(docs, threshold=0.9).count() == 0


def test_tf_idf(spark):
    counts = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 1), (3, "z", 1)], "d int, t string, n int")
    n = spark.createDataFrame([(3.0,)], "n double")
    got = {(r.d, r.t): r.value for r in ngrams.tf_idf(counts, "d", "t", "n", n, 1, 1.0).collect()}
    x, y = math.log(4 / 3) + 1, math.log(2) + 1
    assert got[1, "x"] == pytest.approx(x / math.hypot(x, y)) and got[2, "x"] == 1 and got[3, "z"] == 1
    assert {r.t for r in ngrams.tf_idf(counts, "d", "t", "n", n, 2, 1.0).collect()} == {"x"} and ngrams.tf_idf(counts, "d", "t", "n", n, 1, 0.5).where("t = 'x'").count() == 0


def test_semantic_features(spark):
    words = [("quiet", "JJ"), ("captains", "NNS")], [("soft", "JJ"), ("gentle", "JJ"), ("nature", "NN")], [("catlike", "JJ")], [("fox-like", "NN")]
    sentences = spark.createDataFrame(
        [(1, s, [(i, t, p, t.lower()) for i, (t, p) in enumerate(ws)]) for s, ws in enumerate(words)], "doc_id int, sentence_no int, tokens array<struct<at:int,token:string,tag:string,word:string>>"
    )
    senses = spark.createDataFrame(
        [("captain", "n", 1, "noun.person", "captain.n.01", "captain"), ("nature", "n", 1, "noun.attribute", "nature.n.01", "nature"), ("quiet", "a", 1, "adj.all", "quiet.a.01", "quiet")],
        "lemma string, pos string, rank int, lexname string, synset string, head_lemma string",
    )
    lemmas = spark.createDataFrame([("captains", "n", "captain")], "token string, pos string, lemma string")
    got = {(r.feature, r.kind) for r in ngrams.semantic_features(sentences, senses, lemmas).collect()}
    assert {("quiet captain", "surface_role_phrase"), ("captain", "wordnet_role_head"), ("soft gentle", "attribute_modifier"), ("gentle", "surface_modifier"), ("quiet", "surface_wordnet_phrase"), ("catlike", "surface_modifier"), ("fox", "morphological_like")} <= got


# matching and tags ------------------------------------------------------------------------------------------------


def test_trait_count_goes_before_title_overlap(spark):
    local = spark.createDataFrame([(1, "Ann Lee", "Red Blue Moon"), (2, "Solo", "Red Moon"), (3, "Solo", None)], "local_id int, name string, title string")
    cand = spark.createDataFrame([("A", ["Lee Ann"], ["Other"], 5), ("B", ["Ann Lee"], ["Red Blue Moon"], 2), ("S", ["Solo"], ["Sun"], 9)], "candidate_id string, names array<string>, titles array<string>, n_traits int")
    assert sorted((r.local_id, r.candidate_id) for r in matching.best_candidates(local, cand).collect()) == [(1, "A"), (3, "S")]


def test_trait_filter(spark):
    df = spark.sql("select array(named_struct('lie', true, 'spoiler', 0, 'sexual', false), named_struct('lie', false, 'spoiler', 2, 'sexual', false), named_struct('lie', null, 'spoiler', null, 'sexual', null), named_struct('lie', false, 'spoiler', 0, 'sexual', true)) t")
    assert df.select(F.size(matching.filter_traits(F.col("t"), 1)), F.size(matching.filter_traits(F.col("t"), 2, True))).head()[:] == (1, 3)


def test_cast_prefers_the_voice_actor(spark):
    roles = spark.createDataFrame([(1, [5, 6], ["ann lee"], ["voice x"])], "role_id int, works array<int>, keys array<string>, person_keys array<string>")
    cast = spark.createDataFrame([(5, 50, 0, ["ann lee"], ["other"]), (6, 60, 0, ["ann lee"], ["voice x"]), (7, 70, 0, ["ann lee"], ["voice x"])], "work_id int, cast_id int, place int, keys array<string>, person_keys array<string>")
    assert tuple(matching.match_cast(roles, cast).head()) == (1, 6, 60, "name+person+work", 2)


def test_merge_keeps_the_first_confidence(spark):
    schema = "item int, category string, tag string, confidence string, source string, evidence string, grp string"
    a = spark.createDataFrame([(1, "traits", "kind", "high", "llm", "e1", None)], schema)
    b = spark.createDataFrame([(1, "traits", "kind", "other", "table", None, "G"), (1, "traits", "new", "other", "table", None, "G")], schema)
    got = {r.tag: r for r in tags.merge_tags([a, b], "item").collect()}
    assert (got["kind"].confidence, got["kind"].sources, got["kind"].evidence, got["kind"].groups) == ("high", ["llm", "table"], ["e1"], ["G"]) and got["new"].confidence == "other"


def test_tag_cleaning(spark):
    schema = "item int, category string, tag string, evidence string"
    data = [(1, "traits", "Height", "Height: 160"), (1, "role", "Kind ", "x"), (1, "role", "dog's owner", "x"), (1, "role", "wears hats", "x"), (1, "role", "wears", "x"), (1, "traits", " ", "x"), (1, "traits", None, None), (2, "traits", "tall", None)]
    got = tags.clean_tags(spark.createDataFrame(data, schema), "item", spark.createDataFrame([("wears",)], "token string"))
    assert sorted(map(tuple, got.collect())) == [(1, "kind"), (1, "wears"), (2, "tall")]


def test_canonical_tags(spark):
    pos = spark.createDataFrame([("brave", "JJ"), ("hero", "NN"), ("wears", "VBZ"), ("masked", "VBN"), ("tsundere", "FW"), ("quickly", "RB")], "token string, tag string")
    lex = spark.createDataFrame([("masked", True, True), ("brave", True, False), ("hero", False, False), ("wears", False, True)], "token string, adjective boolean, verb boolean")
    data = [("Brave  HERO", "brave hero"), ("masked hero", None), ("hero masked", "hero masked"), ("tsundere", "tsundere"), ("quickly", None), ("hero 2", None), ("wears hero", None), ("brave brave brave brave hero", None), ("", None)]
    got = {r.tag: r.canonical for r in tags.canonical_tags(spark.createDataFrame([(t,) for t, _ in data], "tag string"), pos, lex).collect()}
    assert got == dict(data)


def test_validated_tags(spark):
    rows = spark.createDataFrame([(1, "role", 0, "a", '"Alpha"', "HIGH"), (1, "role", 1, "a", "beta", "low"), (1, "role", 2, "b", "gone", None), (2, "role", 0, "c", "alpha", "odd")], "item int, category string, place int, tag string, evidence string, confidence string")
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "item int, text string")
    assert sorted(map(tuple, tags.validated_tags(rows, texts.select("item", F.lower(T.normalize_source("text")).alias("normal")), "item").collect())) == [(1, "role", "a", "Alpha", "high"), (2, "role", "c", "alpha", "medium")]


def test_orphan_parents_are_dropped(spark):
    tree = spark.createDataFrame([(1, "P", None, "f1"), (2, "old", 1, "f1"), (2, "new", 1, "f2"), (3, "lost", 9, "f1")], "tag_id int, name string, parent_id int, file string")
    assert [tuple(r) for r in tags.children(tree).collect()] == [("P", "new", 2)]


# vectors and kernels ----------------------------------------------------------------------------------------------


def test_soft_distance():
    e, w = np.zeros((0, 2)), np.zeros(0)
    u = np.array([[1.0, 0.0]])
    right = np.array([[0.8, 0.6], [0.4, math.sqrt(1 - 0.16)]])
    assert vectors.soft_distance(w, e, w, e) == 0 and vectors.soft_distance(w, e, np.ones(1), u) == 1
    assert vectors.soft_distance(np.full(2, 0.5), right, np.ones(1), u) == pytest.approx(0.5 * ((0.2 + 0.6) / 2 + 0.2))
    assert vectors.soft_distance(np.ones(1), u, np.ones(1), u) == pytest.approx(0)


def test_all_pairs_are_blocked(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((90, 8))
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "k bigint, g int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    assert sorted((r.key_a, r.key_b) for r in vectors.similar_pairs(df, "k", "v", 0.3).collect()) == [(i, j) for i in range(90) for j in range(i + 1, 90) if s[i, j] >= 0.3]
    got = sorted((r.key, r.place, r.neighbour) for r in vectors.nearest(df, "k", "v", 3, ["g"]).collect())
    assert got == [(i, p + 1, j) for i in range(90) for p, j in enumerate(sorted((j for j in range(i % 2, 90, 2) if j != i), key=lambda j: (-round(s[i, j], 9), j))[:3])]


def test_weights(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, math.e - 1)], "i int, f double")
    assert [round(r.weight, 9) for r in vectors.popularity_weights(df, "f").orderBy("i").collect()] == [0, 0, 1]


def test_poles(spark):
    member = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c")], "i int, t string")
    load = spark.createDataFrame([("a", 0.6), ("b", 0.6), ("c", -0.3)], "t string, loading double")
    got = kernels.poles(member, load, "i", "t", 1).collect()
    assert len(got) == 1 and [round(got[0][c], 9) for c in ("pole", "opposing", "purity", "breadth", "score")] == [1.2, 0.3, 0.8, round(1.2 * math.sqrt(2), 9), round(0.96 * math.sqrt(2), 9)]


def test_lowdin_and_svd():
    rng = np.random.default_rng(1)
    e = rng.standard_normal((6, 4))
    g = e @ e.T
    x, kept = kernels.lowdin_basis(g)
    assert x.shape == (6, 4) and np.allclose(x.T @ g @ x, np.eye(4)) and (np.diff(kept) <= 0).all()
    b = (rng.random((5, 6)) > 0.5).astype(float)
    left, values, loadings = kernels.descriptor_svd(b, g)
    assert np.allclose(left @ np.diag(values) @ (loadings.T @ x), b @ g @ x, atol=1e-8)


def test_pivots_are_those_of_a_cholesky_factor():
    """Against the textbook: the Schur complements of the Gram matrix, one pivot after the other."""
    e = np.random.default_rng(2).standard_normal((12, 5))
    sums = kernels.shifted_sums(e)
    assert sums.min() == 0 and sums.max() == 1
    for priority in kernels.PRIORITIES:
        got, left = kernels.pivots_by_deflation(e, priority, sums)
        rest, chosen = e @ e.T, []
        for k in range(5):
            d = np.diag(rest).copy()
            score = {"residual": d, "row_sum": sums, "row_sum_first": sums if k == 0 else d, "row_sum_residual": d * sums}[priority]
            best = int(np.argmax(np.where((d > 1e-12) & ~np.isin(np.arange(12), chosen), score, -np.inf)))
            rest = rest - np.outer(rest[:, best], rest[best]) / d[best]
            chosen.append(best)
            assert got[k][0] == best and got[k][1] == pytest.approx(d[best]) and got[k][2] == pytest.approx(np.diag(rest).sum(), abs=1e-9)
        assert len(got) == 5 and np.allclose(left, 0, atol=1e-9)
    # negative row sums: raw ones would choose otherwise
    v = np.array([[3.0, 0], [-1, 0.2], [0, 2], [-1.5, 0]])
    raw = v @ v.sum(axis=0) - np.square(v).sum(axis=1)
    assert raw.min() < 0 and [x[0] for x in kernels.pivots_by_deflation(v, "row_sum_residual", kernels.shifted_sums(v))[0]] == [2, 3]
    assert [x[0] for x in kernels.pivots_by_deflation(v, "row_sum_residual", raw)[0]] == [2, 1]


def test_nearest_pivots_of_a_group_without_any(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [-1.0, 0.1]), (2, 3, [0.0, 1.0])], "g int, k bigint, v array<double>")
    pivots = spark.createDataFrame([(1, 1)], "g int, k bigint")
    got = {r.k: (r.pivot_key, round(r.cosine, 3)) for r in kernels.nearest_pivots(rows, pivots, "g", "k", "v").collect()}
    assert got == {1: (1, 1.0), 2: (1, -0.995), 3: (-1, 0.0)}


def test_spectral_ward_and_mds():
    p = np.array([[0, 0], [0.1, 0], [5, 5], [5.1, 5], [0, 9.0]])
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    assert kernels.ward_labels(p, 3).tolist() == [1, 1, 2, 2, 3] and kernels.ward_labels(p[:2], 8).tolist() == [1, 1]
    _, x = kernels.classical_mds(d)
    assert np.allclose(np.linalg.norm(x[:, None, :2] - x[None, :, :2], axis=2), d, atol=1e-6)
    a = np.exp(-d)
    np.fill_diagonal(a, 0)
    values, coords = kernels.spectral(a)
    assert abs(values[0]) < 1e-9 and coords.shape == (5, 4)


def test_coherence():
    same = np.tile([[1.0, 0.0]], (4, 1))
    assert kernels.coherence(same) == pytest.approx(1) and kernels.variant_overlap(same, same) == pytest.approx(1) and kernels.coherence(np.eye(4)) == pytest.approx(0.25)


def _plain_factors(x, h, rounds, sweeps=12, l1=0.0, l2=(0.0, 0.0)):
    """The same alternation on one matrix, entry by entry."""
    for k in range(rounds):
        gram, w = h.T @ h, np.zeros((len(x), h.shape[1]))
        for target, goal, g, a, b in ((w, x @ h, gram, l1, l2[0]),):
            for _ in range(sweeps):
                for c in range(g.shape[1]):
                    for i in range(len(target)):
                        target[i, c] = max(0.0, target[i, c] + (goal[i, c] - a - target[i] @ g[:, c] - b * target[i, c]) / (g[c, c] + b))
        if k < rounds - 1:
            goal, g, h = x.T @ w, w.T @ w, h.copy()
            for _ in range(sweeps):
                for c in range(g.shape[1]):
                    for i in range(len(h)):
                        h[i, c] = max(0.0, h[i, c] + (goal[i, c] - h[i] @ g[:, c] - l2[1] * h[i, c]) / (g[c, c] + l2[1]))
    return w, h


def test_factorisation(spark):
    rng = np.random.default_rng(3)
    x = rng.random((30, 2)) @ rng.random((2, 8))
    cells = spark.createDataFrame([(i, f"c{j}", float(x[i, j])) for i in range(30) for j in range(8)], "r int, c string, v double")
    w, h, errors = kernels.factorise(cells, "r", "c", "v", 2, rounds=20)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[-1] < 0.05
    rows = w.orderBy("r").collect()
    assert all(min(r.weights) >= 0 for r in rows) and min(map(min, h["weights"])) >= 0
    got = kernels.reconstruction_diagnostics(cells.where("r > 0"), w, h, "r", "c", "v")
    assert (got["zero_n"], got["nonzero_n"], got["density"]) == (8, 232, pytest.approx(232 / 240))
    p = np.array([r.weights for r in rows]) @ np.array(h["weights"].tolist()).T
    for q in (50, 90, 99):
        assert got[f"nonzero_q{q}"] == pytest.approx(np.quantile(p[1:], q / 100, method="lower"), rel=0.012)
    y = x.copy()
    y[0] = 0
    assert got["error"] == pytest.approx(np.linalg.norm(y - p) / np.linalg.norm(y)) and got["nonzero_most"] == pytest.approx(p[1:].max())
    assert kernels.factorise(cells.where("false"), "r", "c", "v", 2)[2] == []


@pytest.mark.parametrize("alpha", [0.0, 0.002])
def test_factorisation_equals_a_plain_version(spark, alpha):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((25, 7)) < 0.4, rng.random((25, 7)), 0)
    x[x.sum(axis=1) == 0, 2] = 0.5
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "r int, c int, v double").repartition(3)
    # where it starts: from the singular vectors of the whole matrix
    u, s, v = np.linalg.svd(x)
    start = np.zeros((7, 3))
    start[:, 0] = np.sqrt(s[0]) * np.abs(v[0])
    for c in (1, 2):
        sides = [(np.maximum(a * u[:, c], 0), np.maximum(a * v[c], 0)) for a in (1, -1)]
        left, right = max(sides, key=lambda z: np.linalg.norm(z[0]) * np.linalg.norm(z[1]))
        start[:, c] = np.sqrt(s[c] * np.linalg.norm(left) * np.linalg.norm(right)) * right / np.linalg.norm(right)
    start = np.where(start < 1e-6, x.mean(), start)
    with pytest.warns(UserWarning, match="still moved"):
        w, h, errors = kernels.factorise(cells, "r", "c", "v", 3, rounds=4, tolerance=-1.0, alpha=alpha, l1_ratio=0.0)
    want_w, want_h = _plain_factors(x, start, 4, l2=(alpha * 7, alpha * 25))
    assert np.allclose(np.array(h["weights"].tolist()), want_h, atol=1e-6) and np.allclose(np.array([r.weights for r in w.orderBy("r").collect()]), want_w, atol=1e-6)
    assert errors[-1] == pytest.approx(np.linalg.norm(x - want_w @ want_h.T) / np.linalg.norm(x))


def test_select_size(spark):
    schema = "k int, leakage double, zero_fraction double, recall double, error double"
    pick = lambda rows: kernels.select_size(spark.createDataFrame(rows, schema)).head()
    assert pick([(4, 0.0, 0.0, 0.95, 0.2), (2, 0.0, 0.0, 0.95, 0.5), (1, 1.0, 0.0, 0.99, 0.9)]).k == 2
    assert pick([(4, 0.3, 0.0, 0.95, 0.2), (2, 0.2, 0.0, 0.95, 0.5), (1, 0.1, 0.0, 0.5, 0.9)]).k == 2
    assert pick([(4, 0.3, 0.0, 0.5, 0.2), (2, 0.2, 0.0, 0.5, 0.5)]).reason == "lowest leakage overall"


# sources, sinks, streaming ----------------------------------------------------------------------------------------


def test_xml(spark):
    good = '<anime><characters><character id="7" type="main"><name> Ann </name><rating votes="3">8.5</rating><seiyuu id="1">X</seiyuu><seiyuu id="2" picture="p">Y</seiyuu></character></characters></anime>'
    df = spark.createDataFrame([(1, good), (2, "<anime><characters>"), (3, "<anime/>"), (4, None)], "k int, x string")
    got = readers.cast_of(df, "x", "k").collect()
    assert len(got) == 1 and (got[0].cast_id, got[0].name, got[0].rating, got[0].votes, [s.name for s in got[0].seiyuu]) == (7, "Ann", 8.5, 3, ["X", "Y"])


def test_html():
    page = '<table><tr><th class="field">Looks </th><td class="value"><a href="/tag/5"><span class="tagname">blue  hair</span></a><a href="/tag/5">Blue hair</a><a href="/x">no</a></td></tr><tr><th class="field">Episodes</th><td class="value"><a href="/tag/6">skip</a></td></tr></table>'
    assert readers.page_tags(page) == [("looks", 5, "blue hair")]
    assert readers.page_tags('<body><div>Personality: <a href="/tag/9">kind</a></div><div><a href="/tag/8">none</a></div></body>') [0] == ("personality", 9, "kind")
    assert readers.page_tags("") == [] and readers.page_tags("<tr><td>") == []


def test_json_descriptions_and_resume(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"characters": [{"id": 1, "description": "", "description_text": "d"}, {"id": 2}]}')
    df = spark.read.schema("characters array<struct<id:bigint,description:string,description_plain:string,description_text:string>>").option("multiLine", True).json(str(tmp_path / "a.json"))
    assert sorted(map(tuple, readers.descriptions(df, "list").collect())) == [("1", "d"), ("2", "")]
    wanted, done = spark.range(6).toDF("k"), spark.range(2).toDF("k")
    assert writers.append_pending(wanted, done, "k", str(tmp_path / "t"), 3).count() == 3
    written = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.k for r in written.collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        writers.require_complete(written, wanted, "k")


def test_staged_vectors(spark):
    have = spark.createDataFrame([("a", [3.0, 4.0])], "text string, embedding array<double>")
    assert readers.staged_vectors(have, spark.createDataFrame([("a",)], "text string")).head().vector == [0.6, 0.8]
    with pytest.raises(ValueError):
        readers.staged_vectors(have, spark.createDataFrame([("b",)], "text string"))


def test_stream_upsert(spark, tmp_path):
    from datetime import datetime

    schema = "k bigint, v string, at timestamp"
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([(1, "a", datetime(2024, 1, 1)), (2, "b", datetime(2024, 1, 1))])
    intake.upsert(intake.deliveries(spark, source, schema), target, ["k"], "at", check).awaitTermination()
    write([(1, "new", datetime(2024, 1, 2)), (2, "late", datetime(2023, 1, 1)), (1, "new", datetime(2024, 1, 2))])
    intake.upsert(intake.deliveries(spark, source, schema), target, ["k"], "at", check).awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{target}/version=1").collect()) == [(1, "new"), (2, "b")]


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    events.union(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = intake.deduplicated(intake.deliveries(spark, str(tmp_path / "in"), events.schema), ["event_id"], "ts", "3650 days")
    counts = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("seen").count() == events.count()


def test_repeated_and_empty_inputs(spark):
    empty = spark.createDataFrame([], "item int, category string, tag string")
    assert tags.tag_counts(empty, "item").count() == 0 and tags.category_values(empty, "item").count() == 0
    assert lanes.shares(spark.createDataFrame([], "r int, c int, v double"), "r", "c", "v").count() == 0
    assert vectors.similar_pairs(spark.createDataFrame([], "k bigint, v array<double>"), "k", "v", 0.5).count() == 0


def test_pivot_queries_have_no_rank_limit(spark):
    from troupe.plans import kernels as plans

    d = "/root/testdata/sf0.001"
    basis, near = plans.pivot_basis(spark, d), plans.nearest_pivots(spark, d)
    sizes = {r.label: min(r["count"], 64) for r in spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").count().collect()}
    last = basis.groupBy("label").agg(F.max("rank").alias("rank"), F.min("trace_share").alias("left")).collect()
    assert basis.count() == spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert all(r["rank"] == sizes[r["label"]] or r["left"] <= 1e-6 for r in last)
    assert near.groupBy("label").agg(F.count_distinct("pivot_key").alias("n")).agg(F.max("n")).head()[0] > 12


def test_pages_of_a_folder_with_bad_bytes(spark, tmp_path):
    import gzip

    good = '<html><table><tr><th class="field">Role</th><td class="value"><a href="/tag/7"><span class="tagname">captain</span></a></td></tr></table>'
    (tmp_path / "1.gz").write_bytes(gzip.compress(good.encode()))
    (tmp_path / "2.gz").write_bytes(gzip.compress(b"\xff\xfe" + good.replace("captain", "caf\xe9").encode("latin-1")))
    found = readers.tags_of_pages(readers.read_pages(spark, str(tmp_path)), "path", "content").orderBy("path").collect()
    assert [(r.category, r.tag_id, r.name) for r in found] == [("role", 7, "captain"), ("role", 7, "caf�")]


def test_stored_vectors_are_of_the_wanted_texts(spark):
    have = spark.createDataFrame([(0, "a", "m"), (1, "b", "m")], "place int, text string, model string")
    assert readers.same_vocabulary(have, have, "m") and not readers.same_vocabulary(have, have, "other")
    assert not readers.same_vocabulary(have, have.where("place = 0")) and not readers.same_vocabulary(have, spark.createDataFrame([(0, "b"), (1, "a")], "place int, text string"))


def test_tables_are_built_only_where_one_is_missing(spark, tmp_path):
    import shutil

    calls = []

    def build():
        calls.append(1)
        return {"x": spark.range(2), "y": spark.range(3)}

    for built in (False, True):
        tables, there = readers.cached_tables(spark, str(tmp_path), build, ["x", "y"])
        assert there is built and tables["y"].count() == 3
    shutil.rmtree(tmp_path / "x.parquet")
    assert not readers.cached_tables(spark, str(tmp_path), build, ["x", "y"])[1] and len(calls) == 2


def test_set_distances_with_empty_sets(spark):
    data = [(1, 1, [1.0], [[1.0, 0.0]]), (1, 2, [], []), (1, 3, [0.5, 0.5], [[1.0, 0.0], [0.0, 1.0]]), (1, 4, [], [])]
    df = spark.createDataFrame(data, "g int, item bigint, weights array<double>, vectors array<array<double>>")
    got = {(r.item_a, r.item_b): round(r.distance, 6) for r in vectors.set_distances(df, "item", "g").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.25, (1, 4): 1.0, (2, 3): 1.0, (2, 4): 0.0, (3, 4): 1.0}


def test_order_over_all_partitions(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(200)], "a int, b int").repartition(6)
    got = facts.in_order(df, F.desc("a"), F.asc("b")).orderBy("place").collect()
    assert [(r.a, r.b) for r in got] == sorted(((k % 7, k) for k in range(200)), key=lambda x: (-x[0], x[1])) and [r.place for r in got] == list(range(1, 201))


def test_lane_sizes_where_the_total_is_zero(spark, tmp_path):
    from datetime import datetime

    from oracle import compare

    from troupe.plans import lanes as plans

    weights = [(1, 0.0), (1, -0.0), (2, 1e-8), (3, -1e-8), (4, 0.5), (4, float("nan")), (5, None), (6, 0.374), (6, 6.026), (7, 0.374), *[(7, 0.3013)] * 20, (8, -1.0), (8, 1.0)]
    rows = [(1, topic, k, weight, datetime(2024, 1, 1)) for k, (topic, weight) in enumerate(weights)]
    spark.createDataFrame(rows, "seiyuu_id bigint, topic int, character_id bigint, topic_weight double, loaded_at timestamp").write.parquet(str(tmp_path / "lane_weights.parquet"))
    assert compare(spark, "lane_sizes", str(tmp_path), plans.lane_sizes, plans.SQL["lane_sizes"]) is None
    assert plans.lane_sizes(spark, str(tmp_path)).count() == 7
