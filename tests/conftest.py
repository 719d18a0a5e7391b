from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

import nearfield

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield nearfield.attach(session)
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session keys for one test."""
    changed = {}

    def put(key: str, value) -> None:
        changed.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, str(value))

    yield put
    for key, value in changed.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{TESTDATA}/sf0.01/embeddings.parquet")


@pytest.fixture(scope="session")
def unit(spark, embeddings):
    """(vec_id, f32) of the supplied vectors, cached."""
    from nearfield.operators import prep

    return prep.represent(embeddings, 64, 64, ("f32",)).cache()


@pytest.fixture(scope="session")
def thresholds(embeddings):
    from nearfield.operators import prep

    return prep.fit_thresholds(embeddings, 64)


def vectors(spark, rows, column: str = "embedding", element: str = "float"):
    """A table (vec_id, column) from Python lists; None makes a NULL vector."""
    data = [(i, None if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"vec_id bigint, {column} array<{element}>")


def brute_knn(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> list[int]:
    """Nearest ids by cosine distance; distances this close count as ties."""
    dist = 1 - (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
    return [int(i) for i in ids[np.lexsort((ids, np.round(dist, 12)))][:k]]


def as_map(found, key: str = "qid", value: str = "vec_id") -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for row in found.orderBy(key, "rk").collect():
        out.setdefault(row[key], []).append(row[value])
    return out
