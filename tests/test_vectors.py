import numpy as np
import pytest

from conftest import plan_of
from marketboard.operators import retrieval, vectors

VEC = "id bigint, crop string, embedding array<float>"


def unit(rng, n, dim):
    m = rng.normal(size=(n, dim))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    corpus, asked = unit(rng, 300, 8), unit(rng, 5, 8)
    corpus[200:] = corpus[0]  # a third of all vectors are copies of one
    crops = ["Onion" if i % 4 else "TOMATO" for i in range(300)]
    rows = [(i, crops[i], corpus[i].tolist()) for i in range(300)]
    asks = [(q, ["onion", "Tomato", "onion", "leek", "tomato"][q], asked[q].tolist()) for q in range(5)]
    return (
        spark.createDataFrame(asks, "query_id bigint, crop string, embedding array<float>"),
        spark.createDataFrame(rows, VEC).repartition(6),
        corpus.astype(float), asked.astype(float), crops,
    )


def by_hand(corpus, query, k, keep=None):
    scores = np.round(corpus @ query, 6)
    ids = [i for i in range(len(corpus)) if keep is None or keep(i)]
    return sorted(ids, key=lambda i: (-scores[i], i))[:k]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("kwargs", [{}, {"max_shipped": 0, "cell_rows": 70}, {"max_shipped": 0, "cell_rows": 2}])
def test_nearest_equals_brute_force(data, kwargs):
    asks, rows, corpus, asked, _ = data
    if kwargs.get("cell_rows") == 2:
        rows = rows.filter("id < 40")
        corpus = corpus[:40]
    got = ranked(vectors.nearest(asks, rows, 7, **kwargs))
    assert got == {q: by_hand(corpus, asked[q], 7) for q in range(5)}


def test_copies_tie_by_id(spark, data):
    _, rows, corpus, _, _ = data
    same = spark.createDataFrame([(1, corpus[0].tolist())], "query_id bigint, embedding array<double>")
    assert ranked(vectors.nearest(same, rows, 4)) == {1: [0, 200, 201, 202]}


def test_no_queries_and_null_vectors(spark, data):
    asks, rows, *_ = data
    assert vectors.nearest(asks.limit(0), rows, 3).count() == 0
    holes = spark.createDataFrame([(1, "x", None), (2, "x", [1.0] * 8)], VEC)
    assert {r["id"] for r in vectors.nearest(asks, holes, 3).collect()} == {2}


def test_corpus_is_not_shuffled(data):
    asks, rows, *_ = data
    plan = plan_of(vectors.nearest(asks, rows, 3)).split("Initial Plan")[0]
    below = plan[plan.index("MapInPandas"):]
    assert "WindowGroupLimit" in plan and below.count("hashpartitioning") == 0
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_postfilter_may_return_fewer_than_k(data):
    asks, rows, corpus, asked, crops = data
    got = ranked(retrieval.retrieve(asks, rows, top_k=3))
    wanted = ["onion", "tomato", "onion", "leek", "tomato"]
    for q in range(5):
        near = [i for i in by_hand(corpus, asked[q], 9) if crops[i].lower() == wanted[q]][:3]
        assert got.get(q, []) == near
    assert 3 not in got


def test_prefilter_fills_up_to_k(data):
    asks, rows, corpus, asked, crops = data
    got = ranked(retrieval.retrieve(asks, rows, top_k=3, prefilter=True))
    for q, crop in ((0, "onion"), (1, "tomato"), (4, "tomato")):
        assert got[q] == by_hand(corpus, asked[q], 3, lambda i: crops[i].lower() == crop)
    assert 3 not in got


def test_no_crop_asks_for_any(spark, data):
    asks, rows, corpus, asked, _ = data
    from pyspark.sql import functions as F

    got = ranked(retrieval.retrieve(asks.withColumn("crop", F.lit(None).cast("string")), rows, top_k=3))
    assert got == {q: by_hand(corpus, asked[q], 3) for q in range(5)}


def test_centroids_have_unit_length(data):
    _, rows, corpus, _, crops = data
    got = {r["crop"]: np.array(r["embedding"]) for r in vectors.centroids(rows, "crop").collect()}
    for crop, vector in got.items():
        mean = corpus[[i for i, c in enumerate(crops) if c == crop]].mean(axis=0)
        np.testing.assert_allclose(vector, mean / np.linalg.norm(mean), atol=1e-6)


def test_text_encoder(spark):
    texts = spark.createDataFrame(
        [(1, "onion storage humidity"), (2, "Onion  STORAGE"), (3, "rain and tomato"), (4, ""), (5, None)],
        "id bigint, text string",
    )
    filled = texts.filter("text IS NOT NULL")
    encoder = vectors.fit_encoder(filled, size=64)
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.encode(filled, encoder).collect()}
    for i in (1, 2, 3):
        assert abs(np.linalg.norm(got[i]) - 1) < 1e-6
    assert got[1] @ got[2] > got[3] @ got[2] and not got[4].any()


def test_encoder_plug_in(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id bigint, text string")

    def make():
        return lambda batch: [[len(t), 1.0] for t in batch]

    got = {r["id"]: r["embedding"] for r in vectors.encode_with(texts, make).collect()}
    assert abs(got[1][0] / got[1][1] - 2) < 1e-6 and abs(np.hypot(*got[2]) - 1) < 1e-6


@pytest.mark.parametrize("kwargs", [{}, {"max_shipped": 0, "cell_rows": 2}])
def test_vectors_that_are_not_finite_take_no_part(spark, kwargs):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [None, 1.0])]
    table = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0])], "query_id bigint, embedding array<double>")
    assert ranked(vectors.nearest(asks, table, 1, **kwargs)) == {1: [4]}
    assert ranked(vectors.nearest(asks, table, 3, **kwargs)) == {1: [4, 3, 2]}


def test_prefilter_without_a_crop_asks_for_any(spark, data):
    asks, rows, corpus, asked, _ = data
    from pyspark.sql import functions as F

    none = asks.withColumn("crop", F.when(F.col("query_id") == 0, F.col("crop")))
    got = ranked(retrieval.retrieve(none, rows, top_k=3, prefilter=True))
    assert {q: got[q] for q in range(1, 5)} == {q: by_hand(corpus, asked[q], 3) for q in range(1, 5)}


def test_plugged_encoder_gets_bounded_batches_and_is_made_once_a_worker(spark):
    rows = [(i, None if i % 5 == 0 else "w" * (i % 9)) for i in range(200)] + [(999, "v" * 500)]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(6)

    def make():
        import os
        import uuid

        made = hash((os.getpid(), uuid.uuid4().hex)) % (1 << 20)

        def encode(batch):
            assert len(batch) <= 7 and (len(batch) == 1 or sum(map(len, batch)) <= 20)
            return [[len(t), made, os.getpid()] for t in batch]

        return encode

    raw = vectors.encode_with(texts, make, batch_rows=7, batch_chars=20).collect()
    assert len(raw) == 201 and all(r["embedding"] is not None for r in raw)
    # as many encoders as processes
    made = {round(r["embedding"][1] / r["embedding"][2], 3) for r in raw}
    assert len(made) <= 6
    empty = vectors.encode_with(texts, lambda: lambda batch: [[0.0, 0.0] for _ in batch]).filter("id < 10").collect()
    assert all(r["embedding"] == [0.0, 0.0] for r in empty)


def test_passages_of_a_crop_are_searched_in_place(spark, data):
    asks, rows, corpus, asked, crops = data
    tagged = [x.withColumn("tag", x["crop"]) for x in (asks, rows)]
    plan = plan_of(vectors.nearest(*tagged, 3, tagged=True)).split("Initial Plan")[0]
    assert "CoGroup" not in plan and plan[plan.index("MapInPandas"):].count("hashpartitioning") == 0
    cells = vectors.nearest(*tagged, 3, tagged=True, max_shipped=0, cell_rows=2)
    assert ranked(vectors.nearest(*tagged, 3, tagged=True)) == ranked(cells)


def test_texts_of_passages_are_not_shuffled(data):
    asks, rows, *_ = data
    plan = plan_of(retrieval.retrieve(asks, rows, top_k=3, prefilter=True)).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "MapInPandas" not in plan
