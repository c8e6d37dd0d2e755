"""Filters: what repeats is always found, across tasks too."""

import numpy as np

from graphloom.llm.bloom import count_classes, might_repeat, twice_seen
from graphloom.llm.text import mix


def test_twice_and_counts(spark):
    keys = [i for i in range(3000)] + [i for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)

    def hashes(batch):
        yield mix(batch.column(0).to_numpy().astype(np.uint64))

    h = mix(np.arange(3000, dtype=np.uint64))
    twice = twice_seen(df, hashes, 18, 2)
    found = might_repeat(twice.value, h, 18, 2)
    assert found[::7].all()
    assert found.mean() < 0.3
    classes = np.frombuffer(count_classes(df, hashes, 20).value, np.uint8)[(h >> np.uint64(44)).astype(np.int64)]
    assert (classes[::7] >= 2).all() and (classes >= 1).all()


def test_empty(spark):
    def hashes(batch):
        yield batch.column(0).to_numpy().astype(np.uint64)

    twice = twice_seen(spark.createDataFrame([], "k long"), hashes, 18, 1)
    assert not any(twice.value)
