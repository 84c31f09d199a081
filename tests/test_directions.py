import numpy as np
from pyspark import RDD

from routelens.ml import train


def test_the_driver_meets_one_matrix_however_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(train, "SUM_CELLS", 6)
    rng = np.random.default_rng(2)
    rows = [(sorted(rng.choice(7, 3, replace=False).tolist()), rng.integers(1, 4, 3).tolist(), rng.random(2).tolist()) for _ in range(40)]
    counts = spark.createDataFrame(rows, "at array<int>, n array<int>, own array<double>").repartition(4)
    own = train.Weights(np.arange(7), (rng.random(4) + 1, rng.random(3) + 1), np.array([0.5, 2.0]))
    held = counts.toArrow().combine_chunks().to_batches()[0]
    x = np.zeros((40, 9))
    row, index, value = own.of(train.listed(held.column(0), held.column(1)), held.column(2))
    x[row, index] = value
    axes, met, collect = rng.standard_normal((9, 3)), [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: met.append(collect(rdd)) or met[-1])
    assert np.allclose(train._sums(counts, own, axes), x.T @ (x @ axes))
    assert len(met) == 1 and sorted(begin for begin, _ in met[0]) == [0, 2, 4, 6, 8] and sum(part.size for _, part in met[0]) == axes.size
    main = train.axes_of(counts, own, 9, 2)
    assert np.allclose(np.linalg.norm(x @ main, axis=0), np.linalg.svd(x)[1][:2], rtol=1e-6)
