"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become whole numbers first, so that sums and deviations are exact. Tasks pack centred rows
into blocks where they lie; the blocks are numbered and make up a BlockMatrix, whose transpose times
itself is the scatter matrix. Only that matrix, of as many rows and columns as a vector has entries,
reaches the driver; its leading eigenvectors, scaled, are the whitening matrix, and another product
of block matrices projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funclab.llm.common import settle_table
from funclab.plans.settle import lookup_join

#: Steps of an entry to the unit, and components returned.
SCALE, COMPONENTS = 256, 4
#: Values of a block, about, and blocks that one task of a product of the scatter holds.
VALUES, BLOCKS = 1 << 18, 16
#: Eigenvalues below this share of the largest one count as zero.
LEAST = 1e-12
_PACKED = "part int, k int, filled int, held binary, ids array<long>, deviations array<long>"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(embeddings: DataFrame, scale=SCALE) -> DataFrame:
    """vec_id and x, floor(scale * entry) of every entry, of vectors without null or non-finite entries."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all numbers
    rows = rows.filter(F.col("c").isNotNull() & F.forall("c", finite))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _pack(height):
    """Blocks of ``height`` rows of values, the last one of a task filled up with zeros."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, []
        names = [c.split()[0] for c in _PACKED.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def block(rows):
            full = np.zeros((height, rows[0][2].shape[0]))
            full[: len(rows)] = [r[2] for r in rows]
            values = (part, made, len(rows), full.tobytes(), [r[0] for r in rows], [r[1] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for b in batches:
            values = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else []
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), values)
            while len(held) >= height:
                yield block(held[:height])
                held, made = held[height:], made + 1
        if held:
            yield block(held)

    return run


def _matrix_schema():
    """Rows as MLlib keeps the blocks of a matrix."""
    from pyspark.mllib.linalg import MatrixUDT
    from pyspark.sql.types import LongType, StructField, StructType

    place = StructType([StructField("row", LongType()), StructField("column", LongType())])
    return StructType([StructField("place", place), StructField("matrix", MatrixUDT())])


def _as_matrices(height, width):
    """Packed blocks, one by one, as matrices in the form of their SQL type; no value becomes an object."""

    def run(batches):
        import pyarrow as pa

        ints = pa.list_(pa.int32())
        names = ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"]
        for b in batches:
            for number, held in zip(b.column(0).to_pylist(), b.column(1)):
                values = pa.array(np.frombuffer(held.as_buffer()))
                dense = [pa.array([1], pa.int8()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.nulls(1, ints), pa.nulls(1, ints)]
                dense += [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.array([True])]
                place = pa.StructArray.from_arrays([pa.array([number], pa.int64()), pa.array([0], pa.int64())], names=["row", "column"])
                yield pa.RecordBatch.from_arrays([place, pa.StructArray.from_arrays(dense, names=names)], names=["place", "matrix"])

    return run


def _as_rows(batches):
    """Blocks of a product, one by one, as lists of their rows."""
    import pyarrow as pa

    for b in batches:
        for place, matrix in zip(b.column(0), b.column(1)):
            height, width = matrix["numRows"].as_py(), matrix["numCols"].as_py()
            values = matrix["values"].values.to_numpy()
            values = values.reshape(height, width) if matrix["isTransposed"].as_py() else values.reshape(width, height).T
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, height * width + 1, width), pa.int32()), pa.array(values.ravel()))
            rows = pa.ListArray.from_arrays(pa.array([0, height], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array([place[0].as_py()], pa.int64()), rows], names=["number", "projected"])


class Blocks:
    """Centred rows (vec_id, deviation, centred) as a BlockMatrix, with the ids of the rows of each block."""

    def __init__(self, rows: DataFrame, width: int, name: str):
        from pyspark.mllib.common import callMLlibFunc
        from pyspark.mllib.linalg.distributed import BlockMatrix

        self.width, self.height = width, max(1, VALUES // width)
        packed = settle_table(rows.select("vec_id", "deviation", "centred").mapInArrow(_pack(self.height), _PACKED), name)
        # A row for each block, so few that one task can number them.
        numbers = packed.select("part", "k", (F.row_number().over(Window.orderBy("part", "k")) - 1).cast("long").alias("number"))
        self.packed = lookup_join(packed, settle_table(numbers, f"{name}-numbers"), ["part", "k"], spread="k")
        self.count = numbers.count()
        frame = self.packed.select("number", "held").mapInArrow(_as_matrices(self.height, width), _matrix_schema())
        # What BlockMatrix itself calls, on a table in place of Python objects.
        made = callMLlibFunc("createBlockMatrix", frame, self.height, width, self.count * self.height, width)
        self.matrix = BlockMatrix(made, self.height, width)

    def scatter(self) -> np.ndarray:
        """Sum of the outer products of all rows: the transpose times the matrix."""
        from pyspark.mllib.linalg.distributed import BlockMatrix

        # MLlib's product cuts the middle dimension, here the rows, on request; Python's method has no argument for it.
        own = self.matrix._java_matrix_wrapper._java_model
        product = self.matrix.transpose()._java_matrix_wrapper.call("multiply", own, -(-self.count // BLOCKS))
        return BlockMatrix(product, self.width, self.width).toLocalMatrix().toArray()

    def project(self, by: np.ndarray) -> DataFrame:
        """vec_id, deviation and projected (a value for each column of ``by``) of every row."""
        from pyspark.mllib.common import callMLlibFunc
        from pyspark.mllib.linalg import DenseMatrix
        from pyspark.mllib.linalg.distributed import BlockMatrix

        session, columns = self.packed.sparkSession, by.shape[1]
        right = session.sparkContext.parallelize([((0, 0), DenseMatrix(self.width, columns, by.ravel(order="F")))], 1)
        product = self.matrix.multiply(BlockMatrix(right, self.width, columns, self.width, columns))
        blocks = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)
        made = blocks.mapInArrow(_as_rows, "number long, projected array<array<double>>")
        both = self.packed.select("number", "filled", "ids", "deviations").join(made, "number")
        rows = F.slice("projected", F.lit(1), F.col("filled"))
        both = both.select(F.explode(F.arrays_zip("ids", "deviations", rows.alias("projected"))).alias("r"))
        return both.select(F.col("r.ids").alias("vec_id"), F.col("r.deviations").alias("deviation"), F.col("r.projected").alias("projected"))


def whiten(embeddings: DataFrame, components=COMPONENTS, scale=SCALE) -> DataFrame:
    """Rows of ``embeddings`` (vec_id, embedding) on the leading principal components, with unit variance.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of
    another length than most (of equally frequent lengths the smallest counts). All others are
    rows, also with a null or repeated vec_id; the fit takes each distinct vector of whole numbers
    once. Other columns are not read. Where there is no vector, or vectors have no entries, there
    are no rows; with fewer entries than ``components``, there are fewer components. A component
    without variance has null in ``whitened``, and ``explained`` is null where no component has
    any. ``deviation`` is exact: beyond 64 bits, the arithmetic overflow is an error.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings, scale)
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None or lengths["length"] == 0:
        return spark.createDataFrame([], _OUT)
    width = lengths["length"]
    rows = rows.filter(F.size("x") == width)
    fit = settle_table(rows.select("x").distinct(), "fit")
    sums = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum"))
    sums = sorted(sums.collect())  # a row for each dimension
    n, total = sums[0]["n"], F.lit([r["sum"] for r in sums])
    apart = F.zip_with("x", total, lambda x, s: x * F.lit(n) - s)  # n times the centred vector, in whole numbers

    def centred(source, vec_id):
        square = F.aggregate("apart", F.lit(0).cast("long"), lambda a, x: a + x * x)
        shared = source.select(vec_id.alias("vec_id"), apart.alias("apart"))
        return shared.select("vec_id", square.alias("deviation"), F.transform("apart", lambda x: x / F.lit(n)).alias("centred"))

    fitted = Blocks(centred(fit, F.lit(None).cast("long")), width, "whitening-fit")
    values, vectors = np.linalg.eigh(fitted.scatter() / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count, trace = min(components, width), float(values.sum())
    used = [k for k in range(count) if values[k] > LEAST * max(values[0], 0)]
    by = vectors[:, :count] * [1 / np.sqrt(values[k]) if k in used else 0.0 for k in range(count)]
    # Spark's covariance takes the means off before it multiplies.
    pairs = [(i, j) for i in used for j in used]
    seen = fitted.project(by).agg(F.count(F.lit(1)), *(F.covar_pop(F.col("projected")[i], F.col("projected")[j]) for i, j in pairs)).first()[1:]
    error = max((abs(c - (i == j)) for c, (i, j) in zip(seen, pairs)), default=None)

    projected = Blocks(centred(rows, F.col("vec_id")), width, "whitening").project(by)
    out = projected.select("vec_id", "deviation", F.posexplode("projected").alias("k", "value"))
    explained = F.lit([float(v) / trace for v in values[:count]] if trace > 0 else [None] * count).cast("array<double>")
    return out.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.array_contains(F.lit(used).cast("array<int>"), F.col("k")), F.col("value")).alias("whitened"),
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
