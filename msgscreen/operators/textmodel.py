"""M3: a trainable text classifier with ``pyspark.ml``.

Tokenizer -> HashingTF -> IDF -> LogisticRegression, trained on the train
split; the regularisation is chosen on the validation split (never on test);
predictions on test come back as the long prediction table. Training is
distributed (treeAggregate of gradients); nothing is collected per row.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def features() -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="message", outputCol="tokens", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=1 << 18),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
    ])


def train_and_predict(split_df: DataFrame, grid=(0.0, 0.01, 0.1)) -> DataFrame:
    """The features are fitted once and written to the checkpoint folder; each
    grid value only trains a regression on them."""
    data = split_df.filter(F.col("message").isNotNull()).withColumn("y", (F.col("label") == "spam").cast("double"))
    data = materialize(data.select("message_id", "message", "y", "split"))
    fitted = features().fit(data.filter(F.col("split") == "train"))
    data = materialize(fitted.transform(data).select("message_id", "features", "y", "split"))
    train, val, test = (data.filter(F.col("split") == x) for x in ("train", "val", "test"))
    ev = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="f1")
    best, best_f1 = None, -1.0
    for reg in grid:
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=reg, maxIter=50).fit(train)
        f1 = ev.evaluate(model.transform(val))
        if f1 > best_f1:
            best, best_f1 = model, f1
    out = best.transform(test)
    p = vector_to_array(F.col("probability"))
    return out.select("message_id", F.lit("tfidf_logreg").alias("model"),
                      F.when(F.col("prediction") == 1.0, F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
                      F.array_max(p).alias("confidence"))
