from collections import Counter

import pytest
from quorumlab.llm import overlap, simhash

KEEPERS = [simhash.keep_first, overlap.keep_first]


def text(seed, n=80):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.mark.parametrize("keep", KEEPERS)
def test_odd_rows_that_stay(odd_docs, no_docs, keep):
    kept = keep(odd_docs)
    assert kept.columns == odd_docs.columns and keep(no_docs).count() == 0
    long = next(r["text"] for r in odd_docs.collect() if r["doc_id"] == 4)
    expected = {(1, "One short line here."), (2, None), (4, long), (7, odd_docs.filter("doc_id = 7").first()["text"])}
    expected.add((None, "no key, mail x@y.example.com\nand a line\nand a line"))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(expected)


@pytest.mark.parametrize("keep", KEEPERS)
def test_one_row_of_each_component_stays(spark, keep):
    rows = [
        *[(1, text(1), "a")] * 3,  # repeated whole
        (1, text(2), "a"),  # the key of another text, alone in its component
        (1, text(3), "a"), (0, text(3), "a"),  # the key is kept for others, here a smaller one is
        (9, text(4), "b"), (9, text(4), "c"),  # key and text repeated, other columns not
        (None, text(5), "a"), (None, text(5), "a"),  # no key in the component
        (None, text(6), "a"), (8, text(6), "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = Counter((r["doc_id"], r["text"]) for r in keep(docs).collect())
    assert found == Counter([(1, text(1)), (1, text(2)), (0, text(3)), (9, text(4)), (None, text(5)), (8, text(6))])
