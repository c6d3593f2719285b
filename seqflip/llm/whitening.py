"""Embedding whitening with MLlib block matrices.

1. A vector's entries become whole numbers x = floor(scale * c).  The fit list holds each distinct x vector once; copies
   are folded before the shuffle, so a vector that makes up a third of all rows is one row of the fit list.
2. The fit list is numbered, centred and indexed into distributed blocks (``IndexedRowMatrix.toBlockMatrix``).  The blocks
   times their transpose are the scatter matrix; its middle dimension, the rows, is dealt out in parts of ``part_bytes``, so
   no task holds more of it, and the parts' products (dimension x dimension) are summed map-side.
3. The eigenvectors come from a local ``eigh`` of the scatter matrix, whose size is the dimension's and not the data's.
4. A second block product with the whitening matrix projects the rows of the fit list; the covariance of the result is
   measured on the stored projections, and every row of the table gets the projection of its x vector by a join.

Bounds: the driver holds numbers of the dimension squared, ``BUCKETS`` counts, and, inside MLlib's product, the places
of the blocks (one for each ``block_rows`` rows).

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped.  The space has the length that
most distinct vectors have (of equally frequent lengths the greatest); rows of another length are dropped too.  Repeated rows
and rows with a null key stay, each with its own result; ties between equal eigenvalues are broken by ``eigh``, the same for
all rows.  A component without variance has null ``whitened`` (and ``explained`` 0, or null if nothing varies); if none
varies ``identity_error`` is null.  Vectors of fewer entries than ``components`` have as many components as entries.
Other columns are dropped, whatever they are called; an empty table gives an empty result.  Sums beyond a long raise.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Hash buckets in which the fit list is numbered; one count for each goes through the driver.
BUCKETS = 4096


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, x) of the rows whose vector is whole and finite."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return (df.filter(F.col(vector).isNotNull()).filter(sound)
            .select(F.col(key).alias("key"), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias("x")))


def digest_of(x: str):
    """The key of an x vector in joins."""
    return F.unhex(F.sha2(F.array_join(F.col(x), ","), 256))


def fit_list(rows: DataFrame) -> DataFrame:
    """(x, bucket) of each distinct x vector, stored."""
    return stored(rows.select("x").distinct().withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).cast("int")), "fit")


def numbered(fit: DataFrame) -> tuple[DataFrame, int]:
    """(index, x) with the indices 0 to n - 1, and n.  A bucket's rows are numbered by a window of its own; the buckets'
    offsets are sums of their counts."""
    spark = fit.sparkSession
    counts = {r["bucket"]: r["count"] for r in fit.groupBy("bucket").count().collect()}
    offsets, n = [], 0
    for bucket in sorted(counts):
        offsets.append((bucket, n))
        n += counts[bucket]
    first = spark.createDataFrame(offsets, "bucket int, first long")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("x"))
    return fit.withColumn("place", place).join(F.broadcast(first), "bucket").select((F.col("first") + F.col("place") - 1).alias("index"), "x"), n


def multiply(a: BlockMatrix, b: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """``a.multiply(b)`` in MLlib's second form, which deals the middle dimension out to ``parts`` tasks for each block of
    the result."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def block_matrix(rows: DataFrame, n: int, d: int, block_rows: int, block_columns: int) -> BlockMatrix:
    """(index, values array<double>) as distributed blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows, block_columns)


def local_blocks(spark, matrix: np.ndarray, block_rows: int) -> BlockMatrix:
    """A matrix of the driver (dimension x components) as blocks of ``block_rows`` rows."""
    d, k = matrix.shape
    blocks = [((i, 0), DenseMatrix(len(part), k, part.ravel(order="F").tolist()))
              for i, part in enumerate(matrix[at:at + block_rows] for at in range(0, d, block_rows))]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), block_rows, k, d, k)


def indexed_rows(matrix: BlockMatrix) -> DataFrame:
    """(index, values array<double>) of the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("values"))


def principal_axes(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of the covariance, falling, and the whitening matrix of those above rounding."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors = values[::-1], vectors[:, ::-1]
    live = values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0)
    k = int(live.argmin()) if not live.all() else len(live)
    return values, vectors[:, :k] / np.sqrt(values[:k])


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256,
           block_rows: int = 1024, block_columns: int = 1024, part_bytes: int = 32 << 20) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every sound row.

    ``n`` is the length of the fit list, ``deviation`` the exact sum of (n * x - S)^2 as decimal(38, 0), ``explained`` the
    component's share of the variance and ``identity_error`` the largest absolute entry of the whitened fit list's
    covariance minus the identity.  ``df`` is read twice."""
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    rows = quantised(df, key, vector, scale)
    fit = fit_list(rows)
    common = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None or not common["d"]:
        return spark.createDataFrame([], f"`{key}` {key_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
                                         "identity_error double")
    d = common["d"]
    same = F.size("x") == d
    index, n = numbered(fit.filter(same))
    sums = dict(fit.filter(same).select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v")).collect())
    total = [sums[i] for i in range(d)]

    centre = F.array(*[F.lit(s / n) for s in total])
    width = min(d, block_columns)
    centred = block_matrix(index.select("index", F.zip_with("x", centre, lambda x, m: x - m).alias("values")), n, d, block_rows, width)
    blocks_a_part = max(1, part_bytes // (block_rows * width * 8))
    scatter = multiply(centred.transpose(), centred, -(-n // (block_rows * blocks_a_part))).toLocalMatrix().toArray()
    values, axes = principal_axes(scatter, n, components)
    trace, k = float(np.trace(scatter)) / n, axes.shape[1]

    if k:
        projected = indexed_rows(multiply(centred, local_blocks(spark, axes, width)))
        projected = stored(index.select("index", digest_of("x").alias("digest")).join(projected, "index").select("digest", "values"), "projected")
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        covariance = projected.agg(*[F.covar_pop(F.col("values")[i], F.col("values")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    else:
        projected, error = spark.createDataFrame([], "digest binary, values array<double>"), None

    # sum (n x - S)^2 = n^2 sum x^2 - 2 n sum x S + sum S^2, in whole numbers.
    whole = lambda e: e.cast("decimal(38,0)")
    exact = lambda number: F.lit(str(number)).cast("decimal(38,0)")
    add = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda t, e: t + e)
    squares, products = add(F.transform("x", lambda e: e * e)), add(F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in total]), lambda e, s: e * s))
    deviation = (whole(whole(squares) * exact(n * n)) - whole(whole(products) * exact(2 * n))
                 + exact(sum(s * s for s in total)))
    shares = F.array(*[F.lit(float(max(v, 0.0)) / trace if trace else None).cast("double") for v in values[:min(components, d)]])
    out = (rows.filter(same).select("key", whole(deviation).alias("deviation"), digest_of("x").alias("digest"))
           .join(projected, "digest", "left")
           .select("key", "deviation", "values", F.posexplode(shares).alias("c", "explained")))
    return out.select(F.col("key").alias(key), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.get("values", F.col("c")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
