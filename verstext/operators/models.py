"""Topic and text classification models on content tokens, with Spark ML.

Spark ML keeps the vocabulary and the weights of these models on the driver. The only selection
of terms is the least share of texts that a term must be in, which also bounds the vocabulary: there are at
most (mean number of distinct terms of a text) / (least share) such terms, however many texts there are.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from verstext.functions.text import content_tokens
from verstext.operators.frequent import join_by_word
from verstext.runtime import materialise

ALL_TERMS = (1 << 31) - 1  # no selection by number


def _tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("tokens", content_tokens(text))


def _fit(pipeline: Pipeline, rows: DataFrame):
    """Fit on rows kept as Spark packs them; CountVectorizer would keep each word of rows that are not kept as an object."""
    rows.persist()
    try:
        return pipeline.fit(rows)
    finally:
        rows.unpersist()


def topic_model(df: DataFrame, key: str, text: str, topics: int = 20, iterations: int = 10, seed: int = 7):
    """(key, topic, weight) of the strongest topic of each text, and (topic, rank, term) of its words."""
    counter = CountVectorizer(
        inputCol="tokens", outputCol="features", minDF=0.005, maxDF=0.5, vocabSize=ALL_TERMS
    )
    pipeline = Pipeline(stages=[counter, LDA(k=topics, maxIter=iterations, seed=seed, optimizer="online")])
    rows = _tokens(df.select(key, text), text)
    model = _fit(pipeline, rows.select(key, "tokens"))
    weights = vector_to_array("topicDistribution")
    scored = model.transform(rows).withColumn("_w", weights).withColumn("weight", F.array_max("_w"))
    topics_of = scored.select(key, (F.array_position("_w", F.col("weight")) - 1).alias("topic"), "weight")
    terms = df.sparkSession.createDataFrame(list(enumerate(model.stages[0].vocabulary)), "_i int, term string")
    words = (
        model.stages[1].describeTopics(10)
        .select("topic", F.posexplode("termIndices").alias("rank", "_i"))
        .join(terms, "_i").select("topic", "rank", "term")
    )
    return topics_of, words


def term_weights(df: DataFrame, key: str, text: str, least_share: float = 0.0005) -> DataFrame:
    """``key, term, n, weight``: the TF-IDF features of the classifier as rows, without a vocabulary on the driver.

    The weight is n * ln((texts + 1) / (texts with the term + 1)) for the terms that at least ``least_share`` of the
    texts have.
    """
    # the words of a text are found once and stored for the steps that count them
    rows = materialise(_tokens(df.select(key, text), text).select(key, "tokens"), "tokens", "zstd")
    counts = rows.repartition(key).select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "term_counts", "zstd")
    n_texts = df.count()
    spread = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    weight = F.log((F.lit(n_texts) + 1) / (F.col("texts") + 1))
    idf = spread.where(F.col("texts") >= least_share * n_texts).select("term", weight.alias("idf"))
    return join_by_word(counts, idf, "term").select(key, "term", "n", (F.col("n") * F.col("idf")).alias("weight"))


def tfidf_logistic(df: DataFrame, text: str, label: str, k: int = 50, least_share: float = 0.0005) -> DataFrame:
    """The k terms with the largest and the k with the smallest coefficient of a TF-IDF classifier."""
    counter = CountVectorizer(inputCol="tokens", outputCol="counts", minDF=least_share, vocabSize=ALL_TERMS)
    stages = [
        counter, IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=30),
    ]
    model = _fit(Pipeline(stages=stages), _tokens(df.select(text, F.col(label).cast("double")), text).select(label, "tokens"))
    rows = list(zip(model.stages[0].vocabulary, [float(c) for c in model.stages[2].coefficients]))
    terms = df.sparkSession.createDataFrame(rows, "term string, coefficient double")
    top = terms.orderBy(F.desc("coefficient"), "term").limit(k).withColumn("side", F.lit("top"))
    bottom = terms.orderBy("coefficient", "term").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
