"""Corpus preparation: columns, cleaning, deduplication, balance, splits.

Decisions are taken on slim columns (id, label, digest); the text travels once, in the
final join on the id, whatever the number of steps in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.text import normalise_label, strip
from quorumlab.operators.ranking import first_ranked, kth_keys, order_struct


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The column whose normalised name stands first among the candidates."""
    place = {name: i for i, name in enumerate(candidates)}
    ranked = [(place[key], -i, c) for i, c in enumerate(columns) if (key := str(c).strip().lower()) in place]
    return min(ranked)[2] if ranked else None


def standardise(raw: DataFrame, id_col: str) -> DataFrame:
    """``(id, text, label)`` from a table with recognisable text and label columns."""
    others = [c for c in raw.columns if c != id_col]
    text = pick_column(others, C.TEXT_COLUMNS)
    label = pick_column(others, C.LABEL_COLUMNS)
    if text is None or label is None:
        raise ValueError(f"no text and label columns found in {others}; rename them to 'text' and 'label'")
    kind = raw.schema[label].dataType.simpleString()
    return raw.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text}`").cast("string").alias("text"),
        normalise_label(F.col(f"`{label}`"), kind).alias("label"),
    )


def drop_unnamed(raw: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop leftover index columns and rows without the required values."""
    kept = [c for c in raw.columns if not c.startswith("Unnamed")]
    return raw.select(*[F.col(f"`{c}`") for c in kept]).dropna(subset=list(required))


def cleaned(text: Column, max_chars: int = C.MAX_TEXT_CHARS) -> Column:
    """The text as the clean corpus has it: trimmed, then cut, then left alone."""
    return F.substring(strip(F.coalesce(text, F.lit(""))), 1, max_chars)


def _reason(text: Column, min_chars: int, drop_empty: bool) -> Column:
    empty = F.lit(drop_empty) & (F.lower(text) == "empty")
    return F.when(empty, "empty").when(F.char_length(text) < min_chars, "short").otherwise("keep")


def examine(
    df: DataFrame,
    min_chars: int = C.MIN_TEXT_CHARS,
    max_chars: int = C.MAX_TEXT_CHARS,
    drop_empty: bool = True,
) -> DataFrame:
    """Trimmed and truncated text with the reason a row is kept or dropped.

    A missing text counts as a text of length 0.  Truncation comes before any
    deduplication and the cut text is not trimmed again.
    """
    stripped = df.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    return stripped.select(
        "id",
        F.substring("text", 1, max_chars).alias("text"),
        "label",
        _reason(F.col("text"), min_chars, drop_empty).alias("reason"),
        (F.char_length("text") > max_chars).alias("truncated"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def surviving_keys(examined: DataFrame) -> DataFrame:
    """``(id, label)`` of kept rows, first id per text.

    Copies collapse on the map side, so a text with a third of all copies costs one
    partial row per task.
    """
    kept = examined.filter("reason = 'keep'").select("id", "label", _digest())
    return kept.groupBy("digest").agg(
        F.min("id").alias("id"), F.min_by("label", "id").alias("label")
    ).select("id", "label")


def clean_corpus(
    df: DataFrame,
    min_chars: int = C.MIN_TEXT_CHARS,
    max_chars: int = C.MAX_TEXT_CHARS,
    drop_empty: bool = True,
    drop_duplicates: bool = True,
) -> DataFrame:
    """Clean ``(id, text, label)``: noise removed, truncated, first of each text kept."""
    examined = examine(df, min_chars, max_chars, drop_empty)
    kept = examined.filter("reason = 'keep'").select("id", "text", "label")
    if not drop_duplicates:
        return kept
    return kept.join(surviving_keys(examined).select("id"), "id", "left_semi")


def cleaning_report(
    df: DataFrame,
    min_chars: int = C.MIN_TEXT_CHARS,
    max_chars: int = C.MAX_TEXT_CHARS,
    drop_empty: bool = True,
) -> DataFrame:
    """All step counts of :func:`clean_corpus` in one pass: one row."""
    examined = examine(df, min_chars, max_chars, drop_empty)
    keep = F.col("reason") == "keep"
    digest = F.when(keep, F.unhex(F.sha2("text", 256))).alias("digest")
    texts = (
        examined.select("id", "label", "reason", "truncated", digest)
        .groupBy("reason", "digest")
        .agg(
            F.count("*").alias("n"),
            F.count_if("truncated").alias("cut"),
            F.min_by("label", "id").alias("label"),
        )
    )

    def rows(reason: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("reason") == reason, value)), F.lit(0)).cast("long")

    one, n, label = F.lit(1), F.col("n"), F.col("label")
    return texts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("initial"),
        rows("empty", n).alias("dropped_empty"),
        rows("short", n).alias("dropped_too_short"),
        rows("keep", F.col("cut")).alias("truncated"),
        rows("keep", n - 1).alias("dropped_duplicates"),
        rows("keep", one).alias("remaining"),
        rows("keep", F.when(label == 1, 1).otherwise(0)).alias("phishing"),
        rows("keep", F.when(label == 0, 1).otherwise(0)).alias("benign"),
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct texts and surplus copies."""
    per_text = df.select(_digest()).groupBy("digest").agg(F.count("*").alias("n"))
    return per_text.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("*").alias("distinct_texts"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
    )


def require_no_leak(df: DataFrame) -> None:
    """Raise when a text occurs twice: the splits would leak into each other."""
    surplus = duplicate_count(df).first()["duplicates"]
    if surplus:
        raise ValueError(f"{surplus} duplicated texts remain: train and test would share content")


def balance(
    df: DataFrame, max_samples: int | None = C.MAX_SAMPLES, seed: int = C.SEED, label_col: str = "label",
    classes: Sequence = (0, 1),
) -> DataFrame:
    """Equally many rows of both classes, at most ``max_samples`` in all.

    Rows are taken in the seeded shuffle order within their class; a small sample of a
    large table ranks little more than the sample.
    """
    label = F.col(label_col)
    n = F.least(*[F.count_if(label == c) for c in classes])
    if max_samples:
        n = F.least(n, F.lit(max_samples // 2).cast("long"))
    return first_ranked(
        df.filter(label.isin(*classes)), df.agg(n).scalar(), [label_col], len(classes), seed=seed
    )


def add_label(df: DataFrame, type_col: str, positive: str = "Phishing Email") -> DataFrame:
    return df.withColumn("label", F.coalesce((F.col(type_col) == positive).cast("int"), F.lit(0)))


def split(
    df: DataFrame,
    test_ratio: float = C.TEST_RATIO,
    root_size: int = C.ROOT_SIZE,
    seed: int = C.SEED,
    digits: int = 3,
) -> DataFrame:
    """Add ``split``: the first share of the shuffle order is ``test``; of the rest the
    first ``root_size // 2`` rows of each class are ``root``; what remains is ``train``.

    Three keys of the order decide, the last one of the test share and of each class's root
    rows; they are looked up first and rows are then marked where they are read: none is exchanged.
    """
    half = max(1, root_size // 2)
    place = order_struct(seed=seed)

    def up_to(last: Row | None) -> Column:
        """Whether a row stands no later than a looked-up one."""
        if last is None:
            return F.lit(False)
        return (place["key"] < last["key"]) | ((place["key"] == last["key"]) & (place["id"] <= F.lit(last["id"])))

    share = kth_keys(df, lambda n: F.floor(n * F.lit(float(test_ratio))), seed=seed, digits=digits).first()
    is_test = up_to(share["last"] if share else None)
    pool = df.filter(~is_test & F.col("label").isin(0, 1))
    ends = {row["label"]: row["last"] for row in kth_keys(pool, lambda _: F.lit(half), ["label"], seed=seed, digits=digits, groups=2).collect()}
    in_root = F.coalesce(*[F.when(F.col("label") == c, up_to(last)) for c, last in sorted(ends.items())], F.lit(False))
    name = F.when(is_test, "test").when(in_root, "root").otherwise("train")
    return df.select("*", name.alias("split"))


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count("*").alias("n"))
