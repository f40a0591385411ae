from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lexiloom.functions import linalg, sparse, text, vectors
from lexiloom.functions.stopwords import EXTENDED, JOURNAL, STANDARD
from lexiloom.functions.text import TokenizerBuilder, TokenizerConfig


def tokens(spark, value, config=TokenizerConfig()):
    return spark.createDataFrame([(value,)], "t string").select(text.tokenize("t", config)).first()[0]


def test_tokens(spark):
    assert tokens(spark, "Hello, world! This is a test.") == ["hello", "world", "this", "is", "test"]
    assert tokens(spark, "hello world test", TokenizerConfig(bigrams=True)) == ["hello", "world", "test", "hello_world", "world_test"]
    assert tokens(spark, "one", TokenizerConfig(bigrams=True)) == ["one"]
    numbers = "There are 42 apples and 100 oranges"
    assert {"42", "100"} <= set(tokens(spark, numbers)) and not {"42", "100"} & set(tokens(spark, numbers, TokenizerConfig(remove_numbers=True)))
    config = TokenizerBuilder().stop_words(STANDARD).more_stop_words({"dog"}).min_length(3).max_length(5).lowercase(False).build()
    assert tokens(spark, "The quick brown fox jumps over THE lazy dog", config) == ["quick", "brown", "fox", "jumps", "lazy"]
    assert tokens(spark, None) is None and tokens(spark, "...") == []
    assert STANDARD < EXTENDED < JOURNAL and "the" in STANDARD
    row = spark.createDataFrame([("A bee, a BEE  and an ant",)], "t string").select(text.unique_tokens("t").alias("u"), text.stream_tokens("t").alias("s")).first()
    assert row.u == ["bee", "and", "an", "ant"] and row.s == ["bee,", "bee", "and", "ant"]


def test_similarity_and_accessors(spark):
    assert abs(spark.range(1).select(text.trigram_similarity(F.lit("network"), F.lit("networks"))).first()[0] - 5 / 6) < 1e-9
    assert spark.range(1).select(text.trigram_similarity(F.lit("ab"), F.lit("ab"))).first()[0] == 1
    kw = spark.createDataFrame([([("x", 1.0), ("y", 0.5)],)], "k array<struct<term: string, score: double>>")
    r = kw.select(text.keyword_summary("k", 5).alias("s"), text.keyword_at("k", 1).alias("a"), text.keyword_at("k", 7).alias("b")).first()
    assert r.s == "x, y" and r.a.term == "y" and r.b is None
    assert [r[0] for r in spark.createDataFrame([(-1,), (3,)], "i int").select(text.topic_name("i")).collect()] == ["outlier", "topic_3"]
    when = dt.datetime(2020, 1, 1)
    meta = spark.createDataFrame([({"a": (None, 5, None, None, None, None), "d": (None, None, None, None, when, None)},)], f"m {text.METADATA}")
    r = meta.select(text.metadata_value("m", "a", "int").alias("a"), text.metadata_value("m", "a", "string").alias("s"), text.metadata_value("m", "d", "date").alias("d"), text.metadata_value("m", "z", "int").alias("z")).first()
    assert (r.a, r.s, r.d, r.z) == (5, None, when, None)
    flags = spark.range(1).select(text.is_outlier(F.lit(-1)), text.is_leaf(F.array()), text.is_highly_diverse(F.lit(0.95)), text.is_low_redundancy(F.lit(0.2))).first()
    assert list(flags) == [True, True, True, False]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, -3.0])], "a array<double>, z array<double>, b array<double>")
    a, z, b = F.col("a"), F.col("z"), F.col("b")
    r = df.select(vectors.l2_norm(a), vectors.cosine_similarity(a, z), vectors.cosine_similarity(a, b), vectors.distance(a, b, "manhattan"), vectors.distance(a, z, "cosine"), vectors.distance(a, z), vectors.distance(a, z, "squared_euclidean")).first()
    assert list(r) == [5, 0, 0, 8, 1, 5, 25]
    assert df.select(vectors.normalized(a), vectors.normalized(z), vectors.zeros(2)).first()[:] == ([0.6, 0.8], [0, 0], [0, 0])
    one, two = (vectors.random_vectors(spark, 5, 3, 1).repartition(n).orderBy("id").collect() for n in (1, 3))
    assert one == two and all(-1 <= x <= 1 for r in one for x in r.embedding)
    g = spark.createDataFrame([(1, [0.0, 2.0]), (1, [2.0, 4.0]), (2, [5.0, 5.0])], "g int, embedding array<double>")
    assert {r.g: r.centroid for r in vectors.centroids(g, "g").collect()} == {1: [1, 3], 2: [5, 5]}


def test_registered_functions(spark):
    vectors.register(spark)
    assert spark.sql("SELECT tokenize('Hello, a world')").first()[0] == ["hello", "world"]
    assert spark.sql("SELECT l2(array(0D, 3D), array(4D, 0D)), cosine(array(1D, 0D), array(2D, 0D))").first()[:] == (5, 1)
    assert spark.sql("SELECT centroid(v) FROM VALUES (array(1D, 2D)), (array(3D, 4D)) AS t(v)").first()[0] == [2, 3]
    assert [r.tokens for r in spark.sql("SELECT * FROM token_windows(array('a', 'b', 'a', 'c'), 3)").collect()] == [["a", "b"], ["b", "a", "c"]]


def test_sparse_matrices(spark):
    m = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (1, 2, 1.0), (0, 1, 0.25)], "row long, col long, value double")
    c = sparse.combined(m)
    assert {(r.row, r.col): r.value for r in c.collect()} == {(0, 1): 0.75, (1, 0): 0.5, (1, 2): 1.0}
    assert sparse.entry(c, 0, 1).first()[0] == 0.75 and sparse.entry(c, 2, 2).first()[0] == 0
    u = {(r.row, r.col): r.value for r in sparse.fuzzy_union(c).collect()}
    assert u == {(0, 1): 0.875, (1, 0): 0.875, (1, 2): 1.0, (2, 1): 1.0}
    lap = {(r.row, r.col): r.value for r in sparse.normalized_laplacian(sparse.fuzzy_union(c), spark.range(4).toDF("row")).collect()}
    assert lap[3, 3] == 1 and abs(lap[0, 1] + 0.875 / (0.875 * 1.875) ** 0.5) < 1e-12
    assert {r.row: r["values"] for r in sparse.dense_rows(c, 3).collect()} == {0: [0, 0.75, 0], 1: [0.5, 0, 1.0]}
    assert sparse.edge_list(sparse.fuzzy_union(c)).count() == 2
    assert {r.row: r.value for r in sparse.row_normalized(c).groupBy("row").sum("value").toDF("row", "value").collect()} == {0: 1.0, 1: 1.0}


def test_linear_algebra():
    import numpy as np

    a = np.array([[2.0, 1.0], [1.0, 3.0]])
    values, v = linalg.symmetric_eigen(a)
    assert values[0] > values[1] and np.allclose(linalg.reconstruct(values, v), a)
    assert linalg.components_for_variance(np.array([8.0, 1.0, 1.0]), 0.8) == 1 and linalg.components_for_variance(np.array([8.0, 1.0, 1.0]), 0.85) == 2
    r = linalg.RandomState(3)
    assert r.child(1).next_double() == linalg.RandomState(3).child(1).next_double() != r.child(2).next_double()
    assert sorted(r.shuffled([1, 2, 3])) == [1, 2, 3] and r.weighted_choice([0, 1, 0]) == 1 and abs(np.linalg.norm(r.unit_vector(4)) - 1) < 1e-9
