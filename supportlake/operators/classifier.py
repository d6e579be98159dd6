"""Intent classifier: TF-IDF rows, balanced multinomial logistic regression."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.operators import tfidf
from supportlake.operators.clusters import dealt, sparse_vectors, vocabulary
from supportlake.operators.intents import class_weights
from supportlake.operators.sampling import stratified_split
from supportlake.session import materialize


@dataclass
class IntentModel:
    """Vocabulary and fitted pipeline; saved and loaded as one folder."""

    vocab: DataFrame
    pipeline: PipelineModel
    settings: tfidf.Vectorizer

    @property
    def labels(self) -> list[str]:
        return list(self.pipeline.stages[0].labels)

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = self.vocab.sparkSession
        settings = spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "settings string")
        settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IntentModel:
        saved = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
        saved["stop_words"] = tuple(saved["stop_words"])
        return IntentModel(
            spark.read.parquet(f"{path}/vocabulary"),
            PipelineModel.load(f"{path}/pipeline"),
            tfidf.Vectorizer(**saved),
        )

    def predict(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Add intent (most probable) and intent_confidence (its probability, 4 dp)."""
        features = _vectors(docs, id_col, text_col, self.vocab, self.settings)
        keep = [c for c in docs.columns if c not in ("intent", "intent_confidence")]
        return docs.select(*keep).join(self.scored(features, id_col), id_col)

    def scored(self, features: DataFrame, id_col: str) -> DataFrame:
        """(id_col, intent, intent_confidence) of vectors (id, features)."""
        best = F.round(F.array_max(vector_to_array("probability")), 4)
        return self.pipeline.transform(features).select(
            F.col("id").alias(id_col), F.col("predicted").alias("intent"),
            best.alias("intent_confidence"),
        )


def _vectors(
    docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, settings: tfidf.Vectorizer
) -> DataFrame:
    weights = tfidf.transform(docs, id_col, text_col, vocab, settings)
    ids = docs.select(F.col(id_col).alias("id"))
    return sparse_vectors(weights, vocab, ids, max(1, vocab.count()))


def train(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    label: str = "intent",
    settings: tfidf.Vectorizer = tfidf.CLASSIFY,
    c: float = 1.0,
    max_iter: int = 1000,
) -> IntentModel:
    """Fit on labelled rows. regParam = 1 / (c * n) gives the usual penalised objective, as
    balanced weights sum to n."""
    rows = docs.select(F.col(id_col).alias("id"), text_col, F.col(label).alias("label_text"))
    vocab, vectors = _fitted_vectors(rows.withColumn("fitted", F.lit(True)), text_col, settings)
    return _fit(docs.select(F.col(id_col).alias("id"), label), label, vocab, vectors, settings, c, max_iter)


def _fitted_vectors(
    rows: DataFrame, text_col: str, settings: tfidf.Vectorizer
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary of the `fitted` ones among `rows` (id, text, fitted), and vectors of all."""
    if settings.max_features is None:
        raise ValueError("the classifier needs a vocabulary cut to max_features")
    stats, weights = tfidf.fit_transform(rows, "id", text_col, settings, "fitted")
    vocab = materialize(vocabulary(stats), "vocab")
    return vocab, sparse_vectors(weights, vocab, rows.select("id"), max(1, vocab.count()))


def _fit(
    docs: DataFrame, label: str, vocab: DataFrame, vectors: DataFrame, settings: tfidf.Vectorizer,
    c: float, max_iter: int,
) -> IntentModel:
    """The regression on the vectors of labelled rows (id, label)."""
    n = docs.count()
    ids = docs.select("id", F.col(label).alias("label_text"))
    balance = class_weights(docs, label).select(F.col(label).alias("label_text"), "weight")
    # One row per class: broadcast.
    features = dealt(
        materialize(vectors.join(ids, "id").join(F.broadcast(balance), "label_text"), "features"), n
    ).persist()  # dealt once for all passes before the regression makes its blocks
    indexer = StringIndexer(
        inputCol="label_text", outputCol="label", stringOrderType="alphabetAsc",
    ).fit(features)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        maxIter=max_iter,
        regParam=1.0 / (c * max(1, n)),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-5,
    ).fit(indexer.transform(features))
    names = IndexToString(
        inputCol="prediction", outputCol="predicted", labels=list(indexer.labels)
    )
    pipeline = Pipeline(stages=[indexer, regression, names]).fit(features)
    features.unpersist()
    return IntentModel(vocab, pipeline, settings)


def train_and_test(
    docs: DataFrame, id_col: str, text_col: str, label: str = "intent", seed: int = 42,
    settings: tfidf.Vectorizer = tfidf.CLASSIFY, c: float = 1.0, max_iter: int = 1000,
) -> tuple[IntentModel, DataFrame]:
    """Fit on the train part of a stratified split; return the model and the test rows with
    `gold` and the predicted intent. The texts of both parts are cut into n-grams once."""
    rows = materialize(docs.select(id_col, text_col, label), "labelled")
    split = materialize(stratified_split(rows, label, id_col, 0.2, seed), "split")
    marked = split.select(
        F.col(id_col).alias("id"), text_col, label, (F.col("split") == "train").alias("fitted")
    )
    vocab, vectors = _fitted_vectors(marked, text_col, settings)
    train_rows = marked.filter("fitted").select("id", label)
    model = _fit(train_rows, label, vocab, vectors, settings, c, max_iter)
    held_out = split.filter("split = 'test'").withColumnRenamed(label, "gold")
    features = held_out.select(F.col(id_col).alias("id")).join(vectors, "id")
    return model, held_out.join(model.scored(features, id_col), id_col)
