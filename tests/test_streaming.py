"""Change files consumed by the stream give the same snapshot as the batch job."""

from pyspark.sql import functions as F

from vitrine.operators import changes
from vitrine.sources.fixtures import Catalogue
from vitrine.streaming.changes import latest_version, start_delete_stream

from conftest import SF_SMALL


def test_delete_stream_matches_batch(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    initial = str(tmp_path / "initial")
    c.products.write.parquet(initial)
    incoming = tmp_path / "incoming"
    deletes = c.product_deletes
    deletes.filter(F.col("id") % 2 == 0).write.parquet(str(incoming / "a"))
    deletes.filter(F.col("id") % 2 == 1).write.parquet(str(incoming / "b"))
    q = start_delete_stream(spark, str(incoming) + "/*", initial, str(tmp_path / "snap"),
                            str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    last = latest_version(spark, str(tmp_path / "snap"), 1000)
    assert last is not None
    got = spark.read.parquet(last)
    want = changes.soft_delete(c.products, deletes)
    assert sorted(got.collect()) == sorted(want.collect())


def test_delete_stream_restart_is_idempotent(spark, tmp_path):
    c = Catalogue(spark, SF_SMALL)
    initial = str(tmp_path / "initial")
    c.products.write.parquet(initial)
    incoming = tmp_path / "incoming"
    c.product_deletes.write.parquet(str(incoming / "a"))
    args = (spark, str(incoming) + "/*", initial, str(tmp_path / "snap"), str(tmp_path / "ckpt"))
    start_delete_stream(*args, trigger_once=True).awaitTermination(120)
    first = latest_version(spark, str(tmp_path / "snap"), 1000)
    # restart on the same checkpoint: the file is not consumed again, no version is added
    start_delete_stream(*args, trigger_once=True).awaitTermination(120)
    assert latest_version(spark, str(tmp_path / "snap"), 1000) == first
    assert spark.read.parquet(first).filter(F.col("is_deleted")).count() >= c.product_deletes.count()
