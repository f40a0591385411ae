"""Registered queries over the driver's tables, with SQL of the same result.

The corpus is documents joined with embeddings on doc_id = vec_id; the label of an embedding is the
given assignment. Only documents with an embedding have a label, a fifth of them at sf0.1: queries over
the corpus, and ``topic_model``, are about those, as a topic model is about documents with vectors. The
others (tokenize_counts, bigram_counts, stream_token_counts, stop_word_antijoin, ctfidf_by_lang) read
all documents. Numbers are rounded on both sides; ties are broken by id or term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sparse, text, vectors
from ..functions.stopwords import STANDARD
from ..operators import assignment, coherence, hdbscan, matching, neighbours, reduction, vocabulary
from ..operators.lineage import checkpointed, spread
from ..streaming import drift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            parts = _needed(sql)
            SQL[f.__name__] = "WITH RECURSIVE " + ", ".join(f"{_HEAD.get(n, n)} AS {'MATERIALIZED ' if n in _ONCE else ''}({PARTS[n]})" for n in parts) + " " + sql if parts else sql
        return f

    return add


#: Parts that are dear and read more than once, and names of columns.
_ONCE = {"near", "cores", "mat", "kw", "tri", "tsim", "cov"}
_HEAD = {"prim": "prim(step, w, b)", "mmr": "mmr(topic_id, step, chosen)", "dp": "dp(step, mask, total, chosen)"}
_STOP = ", ".join(f"'{w}'" for w in sorted(STANDARD))
#: Parts of the oracles, each of which may use those before it.
PARTS = {
    "tok": r"SELECT doc_id, lang, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda t: length(t) BETWEEN 2 AND 50) AS tokens FROM documents",
    "corpus": "SELECT tok.doc_id, tok.tokens, e.label, e.embedding FROM tok JOIN embeddings e ON e.vec_id = tok.doc_id",
    "occ": "SELECT doc_id, label, unnest(tokens) AS term FROM corpus",
    "dfs": "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM occ GROUP BY term",
    "vocab": "SELECT term, df, tf FROM dfs WHERE df <= greatest(1, floor((SELECT count(*) FROM corpus) * 0.7))",
    "ltf": "SELECT label, term, count(*) AS tf FROM occ SEMI JOIN vocab USING (term) GROUP BY label, term",
    "avgn": "SELECT sum(n) / count(*) AS a FROM (SELECT label, count(*) AS n FROM occ GROUP BY label)",
    "raws": "SELECT label, term, tf, tf * ln(1 + (SELECT a FROM avgn) / sum(tf) OVER (PARTITION BY term)) AS raw FROM ltf",
    "scores": "SELECT *, raw / max(raw) OVER (PARTITION BY label) AS score, row_number() OVER (PARTITION BY label ORDER BY round(raw, 9) DESC, term) AS \"rank\" FROM raws",
    "kw": "SELECT label AS topic_id, term, \"rank\", score, tf FROM scores WHERE \"rank\" <= 10",
    "pos": "SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings",
    "cen": "SELECT label AS topic_id, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM pos GROUP BY label, i) GROUP BY label",
    "dvec": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "dist": "SELECT vec_id, label, topic_id, sqrt(list_sum(list_transform(list_zip(v, centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM dvec CROSS JOIN cen",
    "sims": "SELECT vec_id, topic_id, list_sum(list_transform(list_zip(v, centroid), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(v, lambda x: x * x)) * list_sum(list_transform(centroid, lambda x: x * x))) AS s FROM dvec CROSS JOIN cen",
    "near": "SELECT a.vec_id AS src, b.vec_id AS dst, round(list_distance(a.v, b.v), 9) AS d FROM dvec a JOIN dvec b ON a.vec_id != b.vec_id",
    "knn": "SELECT src, dst, d, \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS \"rank\" FROM near) WHERE \"rank\" <= 5",
    "cores": "SELECT src AS id, max(d) AS core FROM knn GROUP BY src",
    "win": "SELECT doc_id, i, list_distinct(list_slice(tokens, i + 1, i + 10)) AS words FROM (SELECT doc_id, tokens, unnest(generate_series(0, greatest(len(tokens) - 10, 0))) AS i FROM corpus WHERE len(tokens) > 0)",
    "kww": "SELECT doc_id, i, term FROM (SELECT doc_id, i, unnest(words) AS term FROM win) SEMI JOIN kw USING (term)",
    "wc": "SELECT term, count(*) AS n FROM kww GROUP BY term",
    "pc": "SELECT a.term AS a, b.term AS b, count(*) AS n FROM kww a JOIN kww b ON a.doc_id = b.doc_id AND a.i = b.i AND a.term < b.term GROUP BY ALL",
    "asked": "SELECT x.topic_id, x.term AS word1, y.term AS word2 FROM kw x JOIN kw y ON x.topic_id = y.topic_id AND x.\"rank\" < y.\"rank\"",
    "prob": "SELECT topic_id, word1, word2, (p.n + 1e-12) / (t.n + 1e-12) AS p1, (q.n + 1e-12) / (t.n + 1e-12) AS p2, (coalesce(pc.n, 0) + 1e-12) / (t.n + 1e-12) AS p12 FROM asked CROSS JOIN (SELECT count(*) AS n FROM win) t JOIN wc p ON p.term = word1 JOIN wc q ON q.term = word2 LEFT JOIN pc ON pc.a = least(word1, word2) AND pc.b = greatest(word1, word2)",
    "npmi": "SELECT topic_id, word1, word2, greatest(-1, least(1, ln(p12 / (p1 * p2)) / -ln(p12))) AS npmi FROM prob",
    "coh": "SELECT topic_id, avg(npmi) AS coherence FROM npmi GROUP BY topic_id",
    "ovl": "SELECT x.topic_id AS i, y.topic_id AS j, count(*) FILTER (WHERE x.term = y.term) / count(DISTINCT x.term) AS overlap FROM kw x CROSS JOIN kw y GROUP BY ALL",
    "red": "SELECT topic_id, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS redundancy FROM (SELECT topic_id, count(*) OVER (PARTITION BY term) AS n FROM kw) GROUP BY topic_id",
    "coo": "SELECT src AS \"row\", dst AS col, 1 / (1 + d) AS \"value\" FROM knn",
    "sym": "SELECT coalesce(x.\"row\", y.col) AS \"row\", coalesce(x.col, y.\"row\") AS col, coalesce(x.\"value\", 0) + coalesce(y.\"value\", 0) - coalesce(x.\"value\", 0) * coalesce(y.\"value\", 0) AS \"value\" FROM coo x FULL JOIN coo y ON x.\"row\" = y.col AND x.col = y.\"row\"",
    "deg": "SELECT \"row\", sum(\"value\") AS degree FROM sym GROUP BY \"row\"",
    "halves": "SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id % 2 AS half FROM embeddings",
    "hcen": "SELECT half, label AS topic_id, list(m ORDER BY i) AS centroid FROM (SELECT half, label, i, avg(x) AS m FROM halves GROUP BY ALL) GROUP BY ALL",
    "mat": (
        "SELECT i, list(w ORDER BY j) AS r FROM (SELECT x.p AS i, y.p AS j, CASE WHEN x.p = y.p THEN NULL ELSE greatest(n.d, c.core, e.core) END AS w"
        " FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM dvec) x CROSS JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM dvec) y"
        " LEFT JOIN near n ON n.src = x.vec_id AND n.dst = y.vec_id LEFT JOIN cores c ON c.id = x.vec_id LEFT JOIN cores e ON e.id = y.vec_id) GROUP BY i"
    ),
    "prim": (
        "SELECT 0, NULL::DOUBLE, r FROM mat WHERE i = 1 UNION ALL SELECT step + 1, least_, list_transform(generate_series(1, len(b)), lambda k: CASE WHEN b[k] IS NULL OR k = p THEN NULL ELSE least(b[k], m.r[k]) END)"
        " FROM (SELECT step, b, list_min(b) AS least_, list_position(b, list_min(b)) AS p FROM prim WHERE list_min(b) IS NOT NULL) q JOIN mat m ON m.i = q.p"
    ),
    "tri": (
        "SELECT topic_id, term1, term2, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS s FROM (SELECT x.topic_id, x.term AS term1, y.term AS term2,"
        " list_distinct(list_transform(generate_series(1, greatest(length(x.term) - 2, 1)), lambda i: substring(x.term, i, 3))) AS a, list_distinct(list_transform(generate_series(1, greatest(length(y.term) - 2, 1)), lambda i: substring(y.term, i, 3))) AS b"
        " FROM kw x JOIN kw y ON x.topic_id = y.topic_id AND x.term != y.term)"
    ),
    "mmr": (
        "SELECT topic_id, 1, [term] FROM kw WHERE \"rank\" = 1 UNION ALL SELECT topic_id, step + 1, list_append(chosen, term) FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY v DESC, k) AS n FROM"
        " (SELECT c.topic_id, c.step, c.chosen, x.term, x.\"rank\" AS k, 0.7::DOUBLE * any_value(x.score) + 0.3::DOUBLE * (1 - max(t.s)) AS v FROM mmr c JOIN kw x ON x.topic_id = c.topic_id AND NOT list_contains(c.chosen, x.term)"
        " JOIN tri t ON t.topic_id = c.topic_id AND t.term1 = x.term AND list_contains(c.chosen, t.term2) GROUP BY c.topic_id, c.step, c.chosen, x.term, x.\"rank\")) WHERE n = 1"
    ),
    "cov": "SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM dvec) a JOIN (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM dvec) b USING (vec_id) GROUP BY a.i, b.i",
    "tsim": "SELECT a.topic_id AS old_id, b.topic_id AS new_id, round(list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(a.centroid, lambda x: x * x)) * list_sum(list_transform(b.centroid, lambda x: x * x))), 9) AS similarity FROM hcen a JOIN hcen b ON a.half = 0 AND b.half = 1",
    "dp": (
        "SELECT 0, 0, 0::DOUBLE, []::BIGINT[] UNION ALL SELECT step + 1, after, t, c FROM (SELECT *, row_number() OVER (PARTITION BY after ORDER BY t DESC) AS n FROM"
        " (SELECT d.step, d.mask | (1 << (p.j - 1)::INTEGER) AS after, d.total + p.similarity AS t, list_append(d.chosen, p.new_id) AS c FROM dp d"
        " JOIN (SELECT *, dense_rank() OVER (ORDER BY old_id) AS i, dense_rank() OVER (ORDER BY new_id) AS j FROM tsim) p ON p.i = d.step + 1 AND d.mask & (1 << (p.j - 1)::INTEGER) = 0)) WHERE n = 1"
    ),
}


def _needed(sql: str) -> list[str]:
    import re

    found: set[str] = set()
    stack = [sql]
    while stack:
        s = stack.pop()
        for n, body in PARTS.items():
            if n not in found and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", s):
                found.add(n)
                stack.append(body)
    return [n for n in PARTS if n in found]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, tokens), tokenised once and stored; the vectors aren't read."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return checkpointed(documents(spark, sf_dir).select("doc_id", "text").join(labels, "doc_id").select("doc_id", "label", text.tokenize("text").alias("tokens")))


def scores(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    c = corpus(spark, sf_dir) if c is None else c
    return vocabulary.ctfidf(c, vocabulary.vocabulary_terms(c, max_df=0.7))


def keywords(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """The ten best of each topic, stored: they are few, and asked for more than once."""
    return checkpointed(vocabulary.top_keywords(scores(spark, sf_dir, c), 10).withColumnRenamed("label", "topic_id"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(points(spark, sf_dir), "label").select(F.col("label").alias("topic_id"), "centroid")


# text


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY term")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.term_counts(checkpointed(vocabulary.token_table(documents(spark, sf_dir)).select("tokens")))


@query("SELECT term, count(*) AS tf FROM (SELECT unnest(list_transform(list_zip(tokens[:len(tokens) - 1], tokens[2:]), lambda p: p[1] || '_' || p[2])) AS term FROM tok WHERE len(tokens) > 1) GROUP BY term")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vocabulary.token_table(documents(spark, sf_dir))
    return t.select(F.explode(text.bigrams(F.col("tokens"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


@query(r"SELECT term, count(*) AS tf FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: length(t) > 2)) AS term FROM documents) GROUP BY term")
def stream_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(text.stream_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))


@query("SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_index, df, tf FROM vocab")
def vocabulary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(corpus(spark, sf_dir), max_df=0.7).withColumn("term_index", F.col("term_index").cast("long"))


@query(f"SELECT term, count(*) AS tf FROM (SELECT unnest(tokens) AS term FROM tok) WHERE term NOT IN ({_STOP}) GROUP BY term")
def stop_word_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = vocabulary.token_table(documents(spark, sf_dir)).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    return vocabulary.without_stop_words(terms, spark.createDataFrame([(w,) for w in sorted(STANDARD)], "term string"))


@query("SELECT doc_id, term, count(*) AS tf FROM occ SEMI JOIN vocab USING (term) GROUP BY ALL")
def vocabulary_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.known_frequencies(corpus(spark, sf_dir), 0.7)


@query(
    "SELECT topic_id, term1, term2, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT x.topic_id, x.term AS term1, y.term AS term2,"
    " list_distinct(list_transform(generate_series(1, greatest(length(x.term) - 2, 1)), lambda i: substring(x.term, i, 3))) AS a, list_distinct(list_transform(generate_series(1, greatest(length(y.term) - 2, 1)), lambda i: substring(y.term, i, 3))) AS b"
    ' FROM kw x JOIN kw y ON x.topic_id = y.topic_id AND x."rank" < y."rank")'
)
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = coherence.keyword_pairs(keywords(spark, sf_dir))
    return pairs.select("topic_id", F.col("word1").alias("term1"), F.col("word2").alias("term2"), rounded(text.trigram_similarity(F.col("word1"), F.col("word2"))).alias("similarity"))


@query("SELECT topic_id, string_agg(term, ', ' ORDER BY \"rank\") FILTER (WHERE \"rank\" <= 5) AS summary, 'topic_' || topic_id AS name FROM kw GROUP BY topic_id")
def keyword_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = vocabulary.keyword_arrays(keywords(spark, sf_dir), "topic_id")
    return arrays.select("topic_id", text.keyword_summary("keywords").alias("summary"), text.topic_name("topic_id").alias("name"))


# class-based tf-idf


@query("SELECT label, term, tf, round(raw, 6) AS raw, round(score, 6) AS score FROM scores")
def ctfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("label", "term", "tf", rounded("raw").alias("raw"), rounded("score").alias("score"))


@query('SELECT topic_id, CAST("rank" AS INTEGER) AS "rank", term, tf, round(score, 6) AS score FROM kw')
def ctfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords(spark, sf_dir).select("topic_id", "rank", "term", "tf", rounded("score").alias("score"))


@query(
    'SELECT lang, CAST("rank" AS INTEGER) AS "rank", term, round(raw, 6) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(raw, 9) DESC, term) AS "rank" FROM (SELECT lang, term, tf * ln(1 + (SELECT sum(n) / count(*) FROM (SELECT lang, sum(len(tokens)) AS n FROM tok GROUP BY lang)) / sum(tf) OVER (PARTITION BY term)) AS raw'
    " FROM (SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest(tokens) AS term FROM tok) GROUP BY ALL))) WHERE \"rank\" <= 10"
)
def ctfidf_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = checkpointed(vocabulary.token_table(documents(spark, sf_dir), "text", "doc_id", text.TokenizerConfig(), "lang"))
    s = vocabulary.ctfidf(t, vocabulary.vocabulary_terms(t, max_df=1.0), label="lang")
    return vocabulary.top_keywords(s, 10, "lang").select("lang", "rank", "term", rounded("raw").alias("raw"))


@query(
    "SELECT label AS topic_id, term, round(ln(n / (df + 1)), 6) AS idf, round(tf / size * ln(n / (df + 1)), 6) AS score FROM ltf JOIN vocab v USING (term) JOIN (SELECT label, count(*) AS size FROM corpus GROUP BY label) USING (label) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM corpus)".replace(
        "ltf JOIN vocab v USING (term)", "ltf JOIN (SELECT term, df FROM vocab) v USING (term)"
    )
)
def incremental_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    v = vocabulary.vocabulary_terms(c, max_df=0.7)
    counts = c.select("label", F.explode("tokens").alias("term")).groupBy(F.col("label").alias("topic_id"), "term").agg(F.count("*").alias("tf"))
    sizes = c.groupBy(F.col("label").alias("topic_id")).agg(F.count("*").alias("size"))
    return vocabulary.incremental_scores(counts, v.select("term", "df"), c.count(), sizes).select("topic_id", "term", rounded("idf").alias("idf"), rounded("score").alias("score"))


# assignments


@query("SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.topic_sizes(table(spark, sf_dir, "embeddings"))


@query(
    "SELECT count(*) FILTER (WHERE label != -1) AS clusters, sum(n)::BIGINT AS documents, coalesce(sum(n) FILTER (WHERE label = -1), 0)::BIGINT AS outliers, sum(n) FILTER (WHERE label != -1)::BIGINT AS assigned, max(n) FILTER (WHERE label != -1) AS max_size,"
    " min(n) FILTER (WHERE label != -1) AS min_size, avg(n) FILTER (WHERE label != -1) AS avg_size, coalesce(sum(n) FILTER (WHERE label = -1), 0) / sum(n) AS outlier_rate FROM (SELECT label - 1 AS label, count(*) AS n FROM embeddings GROUP BY label)"
)
def assignment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # label 0 stands for the outliers here
    return vocabulary.assignment_statistics(table(spark, sf_dir, "embeddings").select((F.col("label") - 1).alias("label")))


@query("SELECT topic_id, unnest(generate_series(0, len(centroid) - 1)) AS i, round(unnest(centroid), 6) AS x FROM cen")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centres(spark, sf_dir).select("topic_id", F.posexplode("centroid").alias("i", "x")).select("topic_id", F.col("i").cast("long").alias("i"), rounded("x").alias("x"))


@query("SELECT vec_id AS id, topic_id, round(d, 6) AS distance, round(1 / (1 + d * d), 6) AS probability FROM dist QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), topic_id) = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = assignment.nearest_centroid(points(spark, sf_dir), centres(spark, sf_dir), key="id")
    return n.select("id", "topic_id", rounded("distance").alias("distance"), rounded("probability").alias("probability"))


@query("SELECT vec_id AS id, topic_id, round(1 / (1 + d * d) / sum(1 / (1 + d * d)) OVER (PARTITION BY vec_id), 6) AS probability FROM dist")
def topic_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment.topic_probabilities(points(spark, sf_dir), centres(spark, sf_dir), key="id").select("id", "topic_id", rounded("probability").alias("probability"))


@query("SELECT vec_id AS id, CASE WHEN d > 2 * m THEN -1 ELSE topic_id END AS label, round(CASE WHEN d > 2 * m THEN 0 ELSE greatest(0.1, 1 - d / (2 * m)) END, 6) AS probability FROM dist CROSS JOIN (SELECT avg(core) AS m FROM cores) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), topic_id) = 1")
def density_predict_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    mean = neighbours.core_distances(p, K).agg(F.avg("core")).first()[0]
    engine = hdbscan.HDBSCAN(centroids=centres(spark, sf_dir).withColumnRenamed("topic_id", "label"), mean_core=mean)
    return engine.predict(p).select("id", "label", rounded("probability").alias("probability"))


@query(
    "SELECT id, CASE WHEN s1 < 0.3 THEN -1 ELSE topic_id END AS topic_id, round(s1, 6) AS similarity, round(CASE WHEN s1 < 0.3 THEN 0 ELSE least(1, (s1 + s1 - s2) / 2) END, 6) AS confidence FROM (SELECT vec_id AS id, topic_id, s AS s1, lead(s) OVER w AS s2, row_number() OVER w AS r FROM sims WINDOW w AS (PARTITION BY vec_id ORDER BY round(s, 12) DESC, topic_id)) WHERE r = 1"
)
def incremental_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assignment.cosine_assignment(points(spark, sf_dir), centres(spark, sf_dir), key="id")
    return a.select("id", "topic_id", rounded("similarity").alias("similarity"), rounded("confidence").alias("confidence"))


@query(
    'SELECT query_id, CAST(r AS INTEGER) AS "rank", id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - similarity, 9), id) AS r FROM'
    " (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS similarity FROM dvec a JOIN dvec b ON a.vec_id % 50 = 0)) WHERE r <= 10"
)
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query against all."""
    p = points(spark, sf_dir)
    found = assignment.search_all(p.where("id % 50 = 0"), p, 10)
    return found.select("query_id", "rank", "id", rounded("similarity").alias("similarity"))


@query('SELECT topic_id, CAST(r AS INTEGER) AS "rank", vec_id AS id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(d, 9), vec_id) AS r FROM dist WHERE label = topic_id) WHERE r <= 3')
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = assignment.representatives(points(spark, sf_dir), centres(spark, sf_dir), key="id")
    return r.select("topic_id", "rank", "id", rounded("distance").alias("distance"))


# neighbours


@query("SELECT src, dst, round(d, 6) AS dist FROM near WHERE src < dst")
def pairwise_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.pairwise(points(spark, sf_dir)).select("src", "dst", rounded("dist").alias("dist"))


@query("SELECT vec_id AS id, topic_id, round(list_sum(list_transform(list_zip(v, centroid), lambda p: abs(p[1] - p[2]))), 6) AS dist FROM dvec CROSS JOIN cen")
def metric_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).crossJoin(centres(spark, sf_dir)).select("id", "topic_id", rounded(vectors.distance(F.col("embedding"), F.col("centroid"), "manhattan")).alias("dist"))


@query("SELECT vec_id AS id, topic_id, round(1 - s, 6) AS dist FROM sims")
def metric_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).crossJoin(centres(spark, sf_dir)).select("id", "topic_id", rounded(vectors.distance(F.col("embedding"), F.col("centroid"), "cosine")).alias("dist"))


@query('SELECT src, CAST("rank" AS INTEGER) AS "rank", dst, round(d, 6) AS dist FROM knn')
def knn_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn_graph(points(spark, sf_dir), K).select("src", "rank", "dst", rounded("dist").alias("dist"))


@query("SELECT src, dst, round(d, 6) AS dist FROM near WHERE round(d, 9) <= 1.2")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return neighbours.range_join(p, p, 1.2, same=True).select("src", "dst", rounded("dist").alias("dist"))


@query("SELECT id, round(core, 6) AS core FROM cores")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.core_distances(points(spark, sf_dir), K).select("id", rounded("core").alias("core"))


@query("SELECT round(min(core), 6) AS min_core, round(max(core), 6) AS max_core, round(avg(core), 6) AS mean_core FROM cores")
def core_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = neighbours.core_statistics(neighbours.core_distances(points(spark, sf_dir), K))
    return s.select(*[rounded(c).alias(c) for c in s.columns])


@query("SELECT src, dst, round(greatest(d, x.core, y.core), 6) AS mrd FROM near JOIN cores x ON x.id = src JOIN cores y ON y.id = dst WHERE src < dst")
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.mutual_reachability(points(spark, sf_dir), K).select("src", "dst", rounded("mrd").alias("mrd"))


@query("SELECT src, dst, round(min(d), 6) AS dist FROM (SELECT src, dst, d FROM knn UNION ALL SELECT dst, src, d FROM knn) GROUP BY ALL")
def knn_symmetrised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.symmetrised(neighbours.knn_graph(points(spark, sf_dir), K)).select("src", "dst", rounded("dist").alias("dist"))


@query("SELECT count(DISTINCT src) AS nodes, count(*) AS edges, round(min(d), 6) AS min_dist, round(max(d), 6) AS max_dist, round(avg(d), 6) AS mean_dist FROM knn")
def knn_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = neighbours.graph_statistics(neighbours.knn_graph(points(spark, sf_dir), K))
    return s.select("nodes", "edges", *[rounded(c).alias(c) for c in ("min_dist", "max_dist", "mean_dist")])


# co-occurrence and quality


def _cooccurrence(spark: SparkSession, sf_dir: str, **config: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = corpus(spark, sf_dir)
    return coherence.cooccurrence(c, keywords(spark, sf_dir, c), coherence.CoherenceConfig(**config))


@query("SELECT x.term AS a, y.term AS b, count(*) AS n FROM (SELECT DISTINCT doc_id, term FROM occ WHERE term IN (SELECT term FROM kw)) x JOIN (SELECT DISTINCT doc_id, term FROM occ WHERE term IN (SELECT term FROM kw)) y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL")
def cooc_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cooccurrence(spark, sf_dir, sliding=False)[1]


@query("SELECT a, b, n FROM pc")
def cooc_window10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cooccurrence(spark, sf_dir)[1]


@query("SELECT term, n FROM wc")
def cooc_words10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cooccurrence(spark, sf_dir)[0]


@query("SELECT topic_id, word1, word2, round(npmi, 6) AS npmi FROM npmi")
def npmi_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    kw = keywords(spark, sf_dir, c)
    w, p, t = coherence.cooccurrence(c, kw)
    return coherence.npmi_pairs(coherence.keyword_pairs(kw), w, p, t).withColumn("npmi", rounded("npmi"))


@query("SELECT topic_id, round(coherence, 6) AS coherence FROM coh")
def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return coherence.topic_coherence(c, keywords(spark, sf_dir, c)).select("topic_id", rounded("coherence").alias("coherence"))


@query("SELECT round(avg(coherence), 6) AS mean, round(median(coherence), 6) AS median, round(min(coherence), 6) AS min, round(max(coherence), 6) AS max, round(stddev_pop(coherence), 6) AS std, count(*) FILTER (WHERE coherence > 0) AS positive, round(avg((coherence > 0)::INT), 6) AS positive_ratio FROM coh")
def coherence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    s = coherence.coherence_summary(coherence.topic_coherence(c, keywords(spark, sf_dir, c)))
    return s.select(*[(F.col(c) if c == "positive" else rounded(c)).alias(c) for c in s.columns])


@query("SELECT count(DISTINCT term) AS unique_keywords, count(*) AS total_keywords, round(count(DISTINCT term) / count(*), 6) AS diversity, round((SELECT avg(redundancy) FROM red), 6) AS mean_redundancy FROM kw")
def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.diversity(keywords(spark, sf_dir)).select("unique_keywords", "total_keywords", rounded("diversity").alias("diversity"), rounded("mean_redundancy").alias("mean_redundancy"))


@query("SELECT topic_id, round(redundancy, 6) AS redundancy FROM red")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.redundancy(keywords(spark, sf_dir)).select("topic_id", rounded("redundancy").alias("redundancy"))


@query("SELECT i, j, round(CASE WHEN i = j THEN 1 ELSE overlap END, 6) AS overlap FROM ovl")
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.overlap(keywords(spark, sf_dir)).select("i", "j", rounded("overlap").alias("overlap"))


@query("SELECT least(i, j) AS i, greatest(i, j) AS j, round(max(overlap), 6) AS overlap FROM ovl WHERE i != j GROUP BY 1, 2 HAVING max(overlap) >= 0.2")
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coherence.overlapping_pairs(coherence.overlap(keywords(spark, sf_dir)), 0.2).select("i", "j", rounded("overlap").alias("overlap"))


@query("SELECT round(m, 6) AS mean_npmi, round(d, 6) AS diversity, round((m + 1) / 2 * d, 6) AS quality FROM (SELECT (SELECT avg(coherence) FROM coh) AS m, (SELECT count(DISTINCT term) / count(*) FROM kw) AS d)")
def topic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    kw = keywords(spark, sf_dir, c)
    q = coherence.quality(coherence.topic_coherence(c, kw), coherence.diversity(kw))
    return q.select(*[rounded(c).alias(c) for c in q.columns])


# sparse matrices


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn_graph(points(spark, sf_dir), K).select(F.col("src").alias("row"), F.col("dst").alias("col"), (1 / (1 + F.col("dist"))).alias("value"))


@query('SELECT "row", col, round("value", 6) AS "value" FROM sym')
def fuzzy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.fuzzy_union(_matrix(spark, sf_dir)).select("row", "col", rounded("value").alias("value"))


@query('SELECT "row", round(degree, 6) AS degree FROM deg')
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.degrees(sparse.fuzzy_union(_matrix(spark, sf_dir))).select("row", rounded("degree").alias("degree"))


@query('SELECT s."row", s.col, round(-s."value" / sqrt(x.degree * y.degree), 6) AS "value" FROM sym s JOIN deg x ON x."row" = s."row" JOIN deg y ON y."row" = s.col UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings')
def laplacian_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = points(spark, sf_dir).select(F.col("id").alias("row"))
    return sparse.normalized_laplacian(sparse.fuzzy_union(_matrix(spark, sf_dir)), nodes).select("row", "col", rounded("value").alias("value"))


@query('SELECT "row", col, round("value" / sum("value") OVER (PARTITION BY "row"), 6) AS "value" FROM sym')
def row_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.row_normalized(sparse.fuzzy_union(_matrix(spark, sf_dir))).select("row", "col", rounded("value").alias("value"))


@query('SELECT "row", round(sum("value" * (1 + col % 7)), 6) AS "value" FROM sym GROUP BY "row"')
def matrix_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = points(spark, sf_dir).select(F.col("id").alias("col"), (1 + F.col("id") % 7).alias("x"))
    return sparse.multiply_vector(sparse.fuzzy_union(_matrix(spark, sf_dir)), v).select("row", rounded("value").alias("value"))


# models compared and merged: the even and the odd vectors of each label are two models


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return tuple(vectors.centroids(p.where(F.col("id") % 2 == h), "label").withColumnRenamed("label", "topic_id") for h in (0, 1))


@query("SELECT old_id, new_id, round(similarity, 6) AS similarity FROM tsim")
def topic_similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.similarity_matrix(*_halves(spark, sf_dir)).withColumn("similarity", rounded("similarity"))


@query("SELECT round(avg(best), 6) AS average_best_match FROM (SELECT max(similarity) AS best FROM tsim GROUP BY old_id)")
def average_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.average_best_match(matching.similarity_matrix(*_halves(spark, sf_dir))).select(rounded("average_best_match").alias("average_best_match"))


@query(
    "SELECT 'merge' AS kind, b AS topic_id, list(a ORDER BY a) AS others FROM (SELECT old_id AS a, arg_max(new_id, (similarity, -new_id)) AS b, max(similarity) AS s FROM tsim GROUP BY old_id) WHERE s >= 0.0 GROUP BY b HAVING count(*) > 1"
    " UNION ALL SELECT 'split', b, list(a ORDER BY a) FROM (SELECT new_id AS a, arg_max(old_id, (similarity, -old_id)) AS b, max(similarity) AS s FROM tsim GROUP BY new_id) WHERE s >= 0.0 GROUP BY b HAVING count(*) > 1"
)
def topic_splits_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = matching.similarity_matrix(*_halves(spark, sf_dir))
    m = matching.merge_events(s, 0.0).select(F.lit("merge").alias("kind"), F.col("new_id").alias("topic_id"), F.col("old_ids").alias("others"))
    return m.union(matching.split_events(s, 0.0).select(F.lit("split"), "old_id", "new_ids"))


@query(
    'SELECT topic_id, CAST(r AS INTEGER) AS "rank", term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS r FROM (SELECT topic_id // 2 AS topic_id, term, max(round(score, 9)) AS score FROM kw GROUP BY 1, 2)) WHERE r <= 10'
)
def keyword_union_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = keywords(spark, sf_dir).select("topic_id", "term", F.round("score", 9).alias("score"))
    half = lambda r: kw.where(F.col("topic_id") % 2 == r).select((F.col("topic_id") / 2).cast("int").alias("topic_id"), "term", "score")
    return matching.union_reranked(half(0), half(1), 10).withColumn("score", rounded("score"))


@query(
    'SELECT topic_id, CAST(r AS INTEGER) AS "rank", term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY side, score DESC, term) AS r FROM (SELECT topic_id // 2 AS topic_id, term, min(topic_id % 2) AS side, arg_min(round(score, 9), topic_id % 2) AS score FROM kw GROUP BY 1, 2)) WHERE r <= 15'
)
def keyword_existing_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = keywords(spark, sf_dir).select("topic_id", "term", F.round("score", 9).alias("score"))
    half = lambda r: kw.where(F.col("topic_id") % 2 == r).select((F.col("topic_id") / 2).cast("int").alias("topic_id"), "term", "score")
    return matching.existing_first(half(0), half(1), 15).withColumn("score", rounded("score"))


@query("SELECT label AS topic_id, i - 1 AS i, round(avg(x), 6) AS x, count(*) AS size FROM pos GROUP BY ALL")
def weighted_centroid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)

    def model(h: int) -> DataFrame:
        own = p.where(F.col("id") % 2 == h)
        sizes = own.groupBy("label").agg(F.count("*").alias("size"))
        return vectors.centroids(own, "label").join(sizes, "label").select(F.col("label").alias("topic_id"), "size", F.lit(None).cast("double").alias("coherence"), "centroid", F.array().cast("array<bigint>").alias("representative_docs"))

    merged = matching.merge_topic_tables(model(0), model(1))
    return merged.select("topic_id", F.posexplode("centroid").alias("i", "x"), "size").select("topic_id", F.col("i").cast("long").alias("i"), rounded("x").alias("x"), "size")


_MERGED = "CASE WHEN label IN (0, 1) THEN 0 ELSE label END"


@query(
    f'SELECT label, CAST(r AS INTEGER) AS "rank", term, round(raw, 6) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(raw, 9) DESC, term) AS r FROM (SELECT label, term, tf * ln(1 + (SELECT sum(n) / count(*) FROM (SELECT {_MERGED} AS l, count(*) AS n FROM occ GROUP BY 1)) / sum(tf) OVER (PARTITION BY term)) AS raw'
    f" FROM (SELECT {_MERGED} AS label, term, count(*) AS tf FROM occ SEMI JOIN vocab USING (term) GROUP BY 1, 2))) WHERE r <= 10"
)
def merge_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = matching.relabel(corpus(spark, sf_dir), {1: 0})
    s = vocabulary.ctfidf(c, vocabulary.vocabulary_terms(c, max_df=0.7))
    return vocabulary.top_keywords(s, 10).select("label", "rank", "term", rounded("raw").alias("raw"))


# drift of a stream


@query(
    "SELECT count(*) AS total, round(avg(x), 6) AS overall, round(sum(x * a * pow(1 - a, n - i)), 6) AS recent, round(sum(o * a * pow(1 - a, n - i)), 6) AS outlier_rate FROM"
    " (SELECT value AS x, (value > 50)::INT AS o, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n, 2.0::DOUBLE / 101 AS a FROM events WHERE value IS NOT NULL)"
)
def drift_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("ts", "event_id", F.col("value").alias("distance"), (F.col("value") > 50).alias("outlier"))
    d = drift.batch_drift(e, ["ts", "event_id"], 100)
    return d.select("total", *[rounded(c).alias(c) for c in ("overall", "recent", "outlier_rate")])


# models: what has one right answer with SQL of it, then what hasn't


@query("SELECT round(sum(c) FILTER (WHERE i = j) + 64 * 1e-6, 6) AS total_variance, round(sum(c * c) + 2e-6 * sum(c) FILTER (WHERE i = j) + 64 * 1e-12, 6) AS squared, 64 AS components FROM cov")
def pca_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the eigenvalues and of their squares: trace and squared norm of the covariance (with its ridge)."""
    values = reduction.PCA(1).fit(points(spark, sf_dir)).eigenvalues
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 6), len(values))], "total_variance double, squared double, components int")


@query("SELECT CAST(step AS INTEGER) AS \"rank\", round(w, 6) AS weight FROM (SELECT row_number() OVER (ORDER BY w) AS step, w FROM prim WHERE w IS NOT NULL)")
def mst_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of the minimum spanning tree in order, which are the same whatever edges tie."""
    _, edges = hdbscan.minimum_spanning_tree(points(spark, sf_dir), K)
    return spark.createDataFrame([(i + 1, round(w, 6)) for i, w in enumerate(sorted(w for *_, w in edges))], "rank int, weight double")


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.pca(points(spark, sf_dir).select("id", "embedding"), 15)


@query()
def mst_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.spanning_tree(points(spark, sf_dir), K)


@query()
def hdbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdbscan.hdbscan(reduction.pca(points(spark, sf_dir).select("id", "embedding"), 15))


@query()
def umap_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.umap(points(spark, sf_dir), 2)


@query('SELECT topic_id AS label, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS "rank", unnest(chosen) AS term FROM mmr WHERE step = 10')
def mmr_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = vocabulary.diversified(vocabulary.keyword_arrays(vocabulary.top_keywords(scores(spark, sf_dir), 10)))
    return order.select("label", F.posexplode("keywords").alias("i", "k")).select("label", (F.col("i") + 1).alias("rank"), "k.term")


@query(
    "SELECT CAST(new_id AS INTEGER) AS new_id, CAST(old_id AS INTEGER) AS old_id FROM (SELECT unnest(chosen) AS new_id, generate_subscripts(chosen, 1) AS i FROM dp WHERE step = (SELECT count(DISTINCT old_id) FROM tsim)) c"
    " JOIN (SELECT DISTINCT old_id, dense_rank() OVER (ORDER BY old_id) AS i FROM tsim) o USING (i) JOIN tsim t USING (old_id, new_id) WHERE t.similarity >= 0"
)
def hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match_topics(*_halves(spark, sf_dir), matching.MatchConfig(0.0))
    return spark.createDataFrame(sorted(m.mapping.items()), "new_id int, old_id int")


@query()
def topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .config import TopicModelConfig
    from .model import TopicModel

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(e, "doc_id")
    return TopicModel(TopicModelConfig.preset("small_corpus")).fit(docs).topics


@query('SELECT term, CAST(max("rank") AS INTEGER) AS worst_rank, count(*) AS topics FROM kw GROUP BY term')
def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords(spark, sf_dir).groupBy("term").agg(F.max("rank").alias("worst_rank"), F.count("*").alias("topics"))
