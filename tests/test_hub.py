"""The sharded dataset source: splits, columns and shards are chosen before any file is opened."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagelens.sources import hub

SCHEMA = "k bigint, t string, w array<string>"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("hub") / "data")
    x = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"), F.array(F.lit("a"), F.lit(None)).alias("w"))
    hub.write_hub({"train": x.where("k < 800"), "test": x.where("k >= 800")}, f"file://{at}", "k", 4)
    return at


def test_splits_and_columns(spark, folder):
    train = hub.read_hub(spark, f"file://{folder}", SCHEMA)
    assert train.columns == ["k", "t", "w"] and train.count() == 800 and train.rdd.getNumPartitions() == 4
    test = hub.read_hub(spark, f"file://{folder}", SCHEMA, "test", ["t"])
    assert test.columns == ["t"] and {r["t"] for r in test.collect()} == {f"t{k}" for k in range(800, 1000)}
    assert train.where("k = 5").first()["w"] == ["a", None]
    with pytest.raises(Exception, match="no split dev; there are test, train"):
        hub.read_hub(spark, f"file://{folder}", SCHEMA, "dev").collect()


def test_unread_shards_stay_closed(spark, folder):
    """Every shard but those that a filter leaves is spoilt: reading them would fail."""
    shards = [json.loads(x) for x in open(f"{folder}/{hub.MANIFEST}")]
    keep = [s for s in shards if s["split"] == "train" and s["low"]["k"] <= 300 <= s["high"]["k"]]
    assert len(keep) == 1 and len(shards) == 8
    held = {}
    for s in shards:
        if s not in keep:
            os.chmod(f"{folder}/{s['file']}", 0o600)
            held[s["file"]] = open(f"{folder}/{s['file']}", "rb").read()
            open(f"{folder}/{s['file']}", "wb").write(b"spoilt")
    try:
        read = lambda: hub.read_hub(spark, f"file://{folder}", SCHEMA, columns=["k", "t"])
        assert read().where("k = 300").collect()[0]["t"] == "t300"
        low, high = keep[0]["low"]["k"], keep[0]["high"]["k"]
        assert read().where(f"k >= {low} and k <= {high}").count() == keep[0]["rows"] and read().where("k in (300, 301)").count() == 2
        assert read().where("k > 5000").count() == 0
        with pytest.raises(Exception):
            read().where("t = 't1'").collect()
    finally:
        for file, data in held.items():
            open(f"{folder}/{file}", "wb").write(data)
