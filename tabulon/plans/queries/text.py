"""Queries: text topics, clusters and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import text
from tabulon.plans.queries.base import Tables, query, rounded

# A short list given as the parameter, so that both engines use the same one.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with".split()

NORMAL = r"regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g')"
TOKENS = rf"list_filter(string_split_regex({NORMAL}, '\s+'), lambda w: w <> '')"


def _corpus(t: Tables):
    return text.corpus(t.documents, "doc_id", ["text"], keep=["source"])


@query("text_normalize", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.normalized_text(["text"]).alias("text"))


@query("text_length_filter", f"SELECT doc_id, CAST(n AS INT) AS n_tokens FROM (SELECT doc_id, len({TOKENS}) AS n FROM documents) WHERE n BETWEEN 5 AND 500")
def _(t: Tables):
    return _corpus(t).select("doc_id", "n_tokens")


_stop = ", ".join(f"'{w}'" for w in STOP_WORDS)


TERMS = f"""docs AS (SELECT doc_id, {TOKENS} AS ws FROM documents WHERE len({TOKENS}) BETWEEN 5 AND 500),
      size AS (SELECT count(*) AS m FROM docs),
      toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM docs),
      kept AS (SELECT * FROM toks WHERE length(w) >= 2 AND w NOT IN ({_stop})),
      pairs AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY p) AS term FROM kept),
      terms AS (SELECT doc_id, w AS term FROM kept UNION ALL SELECT doc_id, term FROM pairs WHERE term IS NOT NULL),
      counted AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM terms GROUP BY 1),
      vocabulary AS (SELECT term, df, cf, ln((1e0 + m) / (1e0 + df)) + 1e0 AS idf FROM counted, size WHERE df >= 5 AND df <= 0.85 * m
      ORDER BY cf DESC, term LIMIT 2000)"""


@query("tfidf_terms", f"WITH {TERMS} SELECT term, df, cf, round(idf, 8) AS idf FROM vocabulary")
def _(t: Tables):
    docs = _corpus(t)
    return rounded(text.tfidf_terms(text.with_tokens(docs, STOP_WORDS), docs.count()), 8, "idf")


@query(
    "tfidf_model",
    f"""WITH {TERMS}, weights AS (SELECT doc_id, term, count(*) * idf AS w FROM terms JOIN vocabulary USING (term) GROUP BY doc_id, term, idf),
      summed AS (SELECT doc_id, count(*) AS n, sum(w) / sqrt(sum(w * w)) AS total, max(w) / sqrt(sum(w * w)) AS top FROM weights GROUP BY 1)
      SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS terms, round(coalesce(total, 0), 8) AS total, round(top, 8) AS top FROM docs LEFT JOIN summed USING (doc_id)""",
)
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    features = text.tfidf(_corpus(t), STOP_WORDS)
    weights = features.frame.select("doc_id", F.filter(vector_to_array("features"), lambda w: w > 0).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, w: a + w)
    return rounded(weights.select("doc_id", F.size("w").alias("terms"), total.alias("total"), F.array_max("w").alias("top")), 8)


def _topics(t: Tables):
    features = text.tfidf(_corpus(t))
    return features, text.fit_topics(features)


@query("lda_topics")
def _(t: Tables):
    features, model = _topics(t)
    return text.topic_terms(model, features)


@query("lda_distribution")
def _(t: Tables):
    features, model = _topics(t)
    return text.topic_distribution(model, features)


@query("text_clusters")
def _(t: Tables):
    features = text.tfidf(_corpus(t))
    return text.assign_clusters(text.fit_clusters(features), features).select("doc_id", "cluster")


@query("cluster_profile")
def _(t: Tables):
    features = text.tfidf(_corpus(t))
    assigned = text.assign_clusters(text.fit_clusters(features), features)
    return text.cluster_profile(assigned, features, "source")


@query(
    "cluster_region_join",
    f"""SELECT source, count(*) AS n FROM documents WHERE len({TOKENS}) BETWEEN 5 AND 500 GROUP BY 1""",
)
def _(t: Tables):
    docs = text.corpus(t.documents, "doc_id", ["text"])
    joined = docs.select("doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


RULES = [("Small Things", ["small", "hot"]), ("Colours", ["red", "blue"]), ("Parts", ["gear", "bolt"])]


@query(
    "cluster_label",
    """SELECT p_partkey, CASE WHEN list_has_any(ws, ['small', 'hot']) THEN 'Small Things' WHEN list_has_any(ws, ['red', 'blue']) THEN 'Colours'
       WHEN list_has_any(ws, ['gear', 'bolt']) THEN 'Parts' ELSE 'Nexus Innovation (' || upper(ws[1][1]) || ws[1][2:] || ')' END AS label
       FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)""",
)
def _(t: Tables):
    return t.part.select("p_partkey", text.cluster_label(F.split("p_name", " "), RULES).alias("label"))


@query(
    "topic_extremes",
    """WITH c AS (SELECT CAST(substr(source, 4) AS BIGINT) + 1 AS topic, count(*) AS n FROM documents GROUP BY 1)
       SELECT (SELECT topic FROM c ORDER BY n DESC, topic LIMIT 1) AS most_topic, max(n) AS most_count,
              (SELECT topic FROM c ORDER BY n, topic DESC LIMIT 1) AS least_topic, min(n) AS least_count FROM c""",
)
def _(t: Tables):
    topic = (F.substring("source", 4, 9).cast("bigint") + 1).alias("topic")
    return text.topic_extremes(t.documents.groupBy(topic).agg(F.count(F.lit(1)).alias("doc_count")))


@query("largest_clusters", "SELECT source AS cluster, count(*) AS size FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def _(t: Tables):
    return text.largest_clusters(t.documents.groupBy(F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("size")))
