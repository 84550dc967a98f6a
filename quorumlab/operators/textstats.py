"""Text statistics of triggers and documents against a corpus vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlab import constants as C
from quorumlab.functions.numeric import lit, r4, ratio, round_to
from quorumlab.functions.text import is_rare, looks_suspicious, tokens
from quorumlab.session import cut_lineage

# A vocabulary whose tokens take no more than this is sent to every task.
BROADCAST_BYTES = 16 * 1024 * 1024


def token_rows(texts: DataFrame) -> DataFrame:
    """One row per token: the other columns next to ``token``, null for a text without any."""
    others = [c for c in texts.columns if c != "text"]
    return texts.select(*others, F.explode_outer(tokens(F.col("text"))).alias("token"))


def vocabulary(texts: DataFrame, top_k: int = C.VOCAB_TOP_K) -> DataFrame:
    """The ``top_k`` most frequent tokens ``(token, cnt)``; ties in token order."""
    rows = token_rows(texts.select("text")).filter(F.col("token").isNotNull())
    counts = rows.groupBy("token").agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "token").limit(top_k)


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.hash(token), F.lit(slots))


def _hash_table(vocab: DataFrame, slots: int) -> Column:
    """The vocabulary as one value: an array of ``slots`` short lists of ``(token, logfreq)``."""
    filled = vocab.groupBy(_slot(F.col("token"), slots).alias("slot")).agg(F.collect_list(F.struct("token", "logfreq")).alias("own"))
    every = vocab.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    cells = F.sort_array(F.collect_list(F.struct("slot", "own")))
    return every.agg(F.transform(cells, lambda cell: cell["own"])).scalar()


def vocabulary_measures(
    texts: DataFrame, vocab: DataFrame, key: Sequence[str] = ("id",), broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Per text: token count, out-of-vocabulary share and mean log frequency; 0 without tokens.

    The vocabulary is checkpointed and measured first.  A small one is sent to every task as one
    hash table, and tokens are looked up where their text is read: nothing is exploded or
    shuffled.  Against a larger one tokens are counted per text first, so a frequent token weighs
    one row per text in the join.
    """
    key = list(key)
    vocab = cut_lineage(vocab.select("token", "cnt"))
    facts = vocab.agg(F.sum("cnt").alias("total"), F.sum(F.octet_length("token")).alias("bytes"), F.count("*").alias("n")).first()
    total = float(facts["total"] or 1)
    shares = vocab.select("token", F.log1p(F.col("cnt") / total * 1e6).alias("logfreq"))
    if (facts["bytes"] or 0) <= broadcast_bytes:
        slots = max(1, 2 * facts["n"])
        found = F.transform(tokens(F.col("text")), lambda t: F.get(F.filter(F.get("_table", _slot(t, slots)), lambda x: x["token"] == t), 0)["logfreq"])
        rows = texts.select(*key, "text").withColumn("_table", _hash_table(shares, slots)).withColumn("_found", F.coalesce(found, F.array()))
        sums = rows.select(
            *key,
            F.size("_found").cast("long").alias("n_tokens"),
            F.size(F.filter("_found", F.isnull)).alias("_oov"),
            F.aggregate("_found", lit(0), lambda total, x: total + F.coalesce(x, lit(0))).alias("_log"),
        )
    else:
        counted = token_rows(texts.select(*key, "text")).groupBy(*key, "token").agg(F.count("token").alias("n"))
        sums = counted.join(shares, "token", "left").groupBy(*key).agg(
            F.sum("n").alias("n_tokens"),
            F.sum(F.when(F.col("logfreq").isNull(), F.col("n")).otherwise(0)).alias("_oov"),
            F.sum(F.col("n") * F.coalesce("logfreq", lit(0))).alias("_log"),
        )
    return sums.select(
        *key,
        "n_tokens",
        ratio(F.col("_oov"), F.col("n_tokens")).alias("oov_ratio"),
        r4(ratio(F.col("_log"), F.col("n_tokens"))).alias("avg_word_frequency"),
    )


def rare_rates(texts: DataFrame, common: Sequence[str] = C.COMMON_WORDS) -> DataFrame:
    """Add ``rare_token_rate``: the share of rare tokens, 0 without tokens.  Row-local, no shuffle."""
    split = texts.withColumn("_t", tokens(F.col("text")))
    rare = F.size(F.filter("_t", lambda t: is_rare(t, common)))
    return split.withColumn("rare_token_rate", ratio(rare, F.size("_t"))).drop("_t")


def detection_rate(texts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of texts the suspicious-text heuristic catches."""
    flag = looks_suspicious(F.col("text")).cast("int").alias("_flag")
    rate = r4(F.coalesce(F.avg("_flag"), lit(0))).alias("filter_detection_rate")
    return texts.select(*by, flag).groupBy(*by).agg(rate)


def trigger_summary(
    triggers: DataFrame, corpus: DataFrame, top_k: int = C.VOCAB_TOP_K,
    common: Sequence[str] = C.COMMON_WORDS,
) -> DataFrame:
    """Evasion measures per trigger set: ``triggers`` has ``(trigger_type, k, text)``."""
    vocab = vocabulary(corpus, top_k)
    key = ["trigger_type", "k"]
    measured = vocabulary_measures(triggers, vocab, key)
    row_wise = rare_rates(triggers, common).select(
        *key, "text", F.col("rare_token_rate").alias("rare"),
        looks_suspicious(F.col("text")).cast("int").alias("caught"),
    )
    return row_wise.join(measured, key).groupBy("trigger_type").agg(
        F.count("*").alias("n_triggers"),
        r4(F.avg("rare")).alias("rare_token_rate"),
        r4(F.avg("oov_ratio")).alias("oov_ratio"),
        r4(F.avg("avg_word_frequency")).alias("avg_word_frequency"),
        r4(F.avg("caught")).alias("filter_detection_rate"),
        round_to(F.avg("n_tokens"), 2).alias("avg_length_words"),
        F.min_by("text", "k").alias("example"),
    )


def _complete_rounds(diagnostics: DataFrame, metric: str, num_clients: int) -> DataFrame:
    bad = F.col("is_malicious")
    value = F.col("value")
    return (
        diagnostics.filter(F.col("metric") == metric)
        .groupBy("run", "round")
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.avg(F.when(bad, value)), lit(0)).alias("mal_mean"),
            F.coalesce(F.avg(F.when(~bad, value)), lit(0)).alias("hon_mean"),
            F.coalesce(F.median(F.when(~bad, value)), lit(0)).alias("hon_median"),
        )
        .filter(F.col("n") == num_clients)
    )


def norm_ratio(diagnostics: DataFrame, num_clients: int, metric: str = "norm") -> DataFrame:
    """Mean over rounds of mean malicious norm / median honest norm; rounds with missing
    clients or a vanishing median are skipped."""
    rounds = _complete_rounds(diagnostics, metric, num_clients).filter("hon_median > 1e-9")
    mean_ratio = F.avg(F.col("mal_mean") / F.col("hon_median"))
    return rounds.groupBy("run").agg(r4(mean_ratio).alias("update_norm_ratio"))


def trust_gap(diagnostics: DataFrame, num_clients: int, metric: str = "trust") -> DataFrame:
    """Mean over rounds of mean honest trust - mean malicious trust."""
    rounds = _complete_rounds(diagnostics, metric, num_clients)
    return rounds.groupBy("run").agg(r4(F.avg(F.col("hon_mean") - F.col("mal_mean"))).alias("trust_gap"))
