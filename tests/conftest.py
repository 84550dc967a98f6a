import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quorumlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """Build an update table from ``{client: [layer arrays]}``, or a list of them by round."""

    def build(rounds, shuffle_seed=0):
        import random

        rounds = dict(enumerate(rounds if isinstance(rounds, list) else [rounds]))
        rows = [
            (r, c, layer, coord, float(v))
            for r, clients in rounds.items()
            for c, layers in clients.items()
            for layer, values in enumerate(layers)
            for coord, v in enumerate(values)
        ]
        random.Random(shuffle_seed).shuffle(rows)
        return spark.createDataFrame(rows, "round int, client_id int, layer int, coord int, value double")

    return build


def cells(df):
    return {(r["round"], r["layer"], r["coord"]): r["value"] for r in df.collect()}


def per_client(df, column):
    return {(r["round"], r["client_id"]): r[column] for r in df.collect()}


def flagged(df):
    return {r["client_id"] for r in df.collect() if r["flagged"]}
