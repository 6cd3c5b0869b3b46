import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def database(spark):
    """Build a database from shards: lists of (key, payload text or None)."""
    from keyloom.operators.tag_index import build_tags
    from keyloom.plans.database import Database

    def make(*shards, tags=True):
        rows = []
        for number, entries in enumerate(shards):
            items = [(e, None) if isinstance(e, str) else e for e in entries]
            for i, (key, payload) in enumerate(sorted(items, key=lambda x: x[0].encode())):
                rows.append((number, i + 1, key, payload))
        entries = spark.createDataFrame(rows, "shard int, id long, key string, payload string")
        return Database(entries, build_tags(entries) if tags else None)

    return make


def tagged(*labels):
    import json

    return json.dumps({"tags": list(labels)})
