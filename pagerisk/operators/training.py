"""Model training on feature tables and on labelled text, with MLlib."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagerisk.functions.text import FEAR_LABEL, NO_FEAR_LABEL

RANDOM_FOREST, BOOSTED_TREES, BAGGED_SVM = "Random Forest", "Boosted Trees", "Bagged SVM"
ALGORITHMS = (RANDOM_FOREST, BOOSTED_TREES, BAGGED_SVM)
SEED = 42


def train_text_classifier(
    labelled: DataFrame,
    text: str = "text",
    label: str = "label",
    features: int = 1 << 14,
    max_iter: int = 20,
) -> PipelineModel:
    """A text classifier from (text, 0/1 label)."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"[^\p{L}]+"),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=features),
            IDF(inputCol="__tf", outputCol="__tfidf"),
            LogisticRegression(
                featuresCol="__tfidf", labelCol=label, maxIter=max_iter, regParam=0.01
            ),
        ]
    ).fit(labelled)


def classify_text(model: PipelineModel, df: DataFrame, text: str = "text") -> DataFrame:
    """Add the predicted label name and its confidence, as a text-classification model does."""
    scored = model.transform(df)
    sure = F.array_max(vector_to_array("probability"))
    name = F.when(F.col("prediction") == 1, FEAR_LABEL).otherwise(NO_FEAR_LABEL)
    return scored.select(*df.columns, name.alias("label_name"), sure.alias("score"))


class BaggedSvm:
    """Linear support vector machines fitted on bootstrap samples, voting by majority."""

    def __init__(self, models: list[LinearSVCModel]):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        voted = df
        for i, model in enumerate(self.models):
            voted = (
                model.setPredictionCol(f"__v{i}")
                .setRawPredictionCol(f"__r{i}")
                .transform(voted)
                .drop(f"__r{i}")
            )
        votes = [F.col(f"__v{i}") for i in range(len(self.models))]
        total = reduce(lambda a, b: a + b, votes)
        winner = (total * 2 > len(votes)).cast("double")
        return voted.withColumn("prediction", winner).drop(*(f"__v{i}" for i in range(len(votes))))


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def train_label_model(
    train: DataFrame,
    algorithm: str,
    label: str = "label",
    folds: int = 0,
    trees: int = 20,
    bags: int = 5,
    max_iter: int = 20,
    seed: int = SEED,
):
    """Fit one algorithm on (features vector, 0/1 label).

    ``trees`` sizes the forest, ``bags`` the bagged ensemble, ``max_iter`` bounds boosting and
    optimisation. ``folds`` of 2 or more selects the tree depth, or the regularisation of the
    machines, by cross-validation.
    """
    if algorithm == RANDOM_FOREST:
        learner = RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)
        grid = ParamGridBuilder().addGrid(learner.maxDepth, [3, 5])
    elif algorithm == BOOSTED_TREES:
        learner = GBTClassifier(labelCol=label, maxIter=max_iter, seed=seed)
        grid = ParamGridBuilder().addGrid(learner.maxDepth, [3, 5])
    elif algorithm == BAGGED_SVM:
        learner = LinearSVC(labelCol=label, maxIter=max_iter, regParam=0.01)
        grid = ParamGridBuilder().addGrid(learner.regParam, [0.001, 0.01, 0.1])
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    best = None
    if folds >= 2:
        best = CrossValidator(
            estimator=learner,
            estimatorParamMaps=grid.build(),
            evaluator=BinaryClassificationEvaluator(labelCol=label),
            numFolds=folds,
            seed=seed,
        ).fit(train).bestModel
    if algorithm != BAGGED_SVM:
        return best or learner.fit(train)
    if best is not None:
        learner = learner.copy({learner.regParam: best.getRegParam()})
    bootstraps = [
        train.sample(withReplacement=True, fraction=1.0, seed=seed + i) for i in range(bags)
    ]
    return BaggedSvm([learner.fit(rows) for rows in bootstraps])


_SAVED = {
    "forest": RandomForestClassificationModel,
    "boosted": GBTClassificationModel,
    "bagged": LinearSVCModel,
}


def save_model(model, path: str) -> None:
    """Write a trained model and what it is, for ``load_model``."""
    parts = model.models if isinstance(model, BaggedSvm) else [model]
    kind = next(name for name, one in _SAVED.items() if isinstance(parts[0], one))
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/{i}")
    spark = SparkSession.active()
    about = spark.createDataFrame([(kind, len(parts))], "kind string, parts int")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(spark: SparkSession, path: str):
    """Read back what ``save_model`` wrote."""
    about = spark.read.schema("kind string, parts int").json(f"{path}/about").first()
    parts = [_SAVED[about.kind].load(f"{path}/{i}") for i in range(about.parts)]
    return BaggedSvm(parts) if about.kind == "bagged" else parts[0]


def predictions_of(models: dict[str, object], test: DataFrame, key: str, label: str) -> DataFrame:
    """Long (model, sample_id, y_true, y_pred) table; one pass over the test rows."""
    scored, columns = test, []
    for i, (name, model) in enumerate(models.items()):
        before = scored.columns
        scored = model.transform(scored).withColumnRenamed("prediction", f"__p{i}")
        scored = scored.select(*before, f"__p{i}")
        columns.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col(key).alias("sample_id"),
                F.col(label).cast("int").alias("y_true"),
                F.col(f"__p{i}").cast("int").alias("y_pred"),
            )
        )
    return scored.select(F.inline(F.array(*columns)))
