import numpy as np

from matrelate import streaming
from matrelate.matrix import Matrix


def test_triplets_add_up(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0)], "i long, j long, v double").write.parquet(str(source))
    spark.createDataFrame([(1, 1, 2.0)], "i long, j long, v double").write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = streaming.accumulate(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 2
    assert np.allclose(Matrix.of(streaming.accumulated(spark, str(tmp_path / "out")), 2).to_numpy(), [[3, 0], [3, 0]])
