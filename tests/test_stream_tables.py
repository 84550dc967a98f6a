"""The stream queries take a table that is a folder of files as they take one that is a file."""

import os
import shutil

import pytest

from quorumlab.catalog import load

NAMES = ("w01_windowed_norms", "w02_running_history", "w02_history_in_state", "w03_log_stream")


def write(table, path, files):
    """The table as one file, or as a folder of several."""
    table.repartition(max(files, 1)).write.parquet(path if files else f"{path}-folder")
    if not files:
        (part,) = [f for f in os.listdir(f"{path}-folder") if f.startswith("part-")]
        shutil.copy(f"{path}-folder/{part}", path)


@pytest.fixture
def folders(spark, tmp_path):
    vectors = [(i, i % 4, [float(i % 7), None if i % 5 == 0 else -1.5, 0.25 * i]) for i in range(700)] + [(None, None, [2.0, 2.0, 2.0]), (3, 3, None)]
    texts = [(i, f"[Round {i}] line\n(raylet) noise\nend {i}") for i in range(40)] + [(None, "no key"), (7, None), (7, "again")]
    for kind, files in (("file", 0), ("folder", 3)):
        os.mkdir(tmp_path / kind)
        write(spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>"), f"{tmp_path}/{kind}/embeddings.parquet", files)
        write(spark.createDataFrame(texts, "doc_id long, text string"), f"{tmp_path}/{kind}/documents.parquet", files)
    return str(tmp_path / "file"), str(tmp_path / "folder")


@pytest.mark.parametrize("name", NAMES)
def test_tables_of_several_files(spark, folders, name):
    one, several = (sorted(map(repr, load()[0][name](spark, path).collect())) for path in folders)
    assert len(one) > 10 and one == several
