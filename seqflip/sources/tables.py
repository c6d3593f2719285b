"""Table sources and parquet persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Optional session setting: the number of partitions that whole texts are dealt to before windowing.
SPREAD_CONF = "spark.seqflip.windowPartitions"


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to as many partitions as the session setting ``spark.seqflip.windowPartitions`` names.

    Unset (the default), the rows stay in the splits of the scan and nothing
    moves.  Set it where a table is one small file whose single split would
    leave the other cores idle.  The deal is round-robin, so no key can be hot."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df


def save_linear_model(model, spark: SparkSession, path: str) -> None:
    """A linear model as two small parquet tables: ``weights(pos, token, w)`` and
    ``meta(length, alphabet, bias, integer)``."""
    model.to_df(spark).write.mode("overwrite").parquet(f"{path}/weights")
    meta = spark.createDataFrame([(model.length, model.alphabet, float(model.bias), model.integer)],
                                 "length INT, alphabet INT, bias DOUBLE, integer BOOLEAN")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def save_mlp_model(model, spark: SparkSession, path: str) -> None:
    """A multilayer perceptron as ``weights(i, w)`` (a bound fixed by its layers) and ``meta(length, alphabet, layers)``."""
    spark.createDataFrame(list(enumerate(model.weights)), "i INT, w DOUBLE").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame([(model.length, model.alphabet, list(model.layers))], "length INT, alphabet INT, layers ARRAY<INT>") \
        .write.mode("overwrite").parquet(f"{path}/meta")


def load_mlp_model(spark: SparkSession, path: str):
    """Load a model saved by :func:`save_mlp_model`; every weight must be there once."""
    from ..operators.train import MLPModel

    meta = spark.read.parquet(f"{path}/meta").first()
    layers = tuple(meta["layers"])
    rows = sorted((r["i"], r["w"]) for r in spark.read.parquet(f"{path}/weights").collect())
    if [i for i, _ in rows] != list(range(sum((a + 1) * b for a, b in zip(layers, layers[1:])))):
        raise ValueError(f"{path}: weights are missing or doubled")
    return MLPModel(meta["length"], meta["alphabet"], layers, tuple(w for _, w in rows))


def load_linear_model(spark: SparkSession, path: str):
    """Load a model saved by :func:`save_linear_model` from any Hadoop-readable URI."""
    from ..operators.model import LinearModel

    meta = spark.read.parquet(f"{path}/meta").first()
    return LinearModel.from_df(spark.read.parquet(f"{path}/weights"), meta["bias"], meta["length"],
                               meta["alphabet"], bool(meta["integer"]))


