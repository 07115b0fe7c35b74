"""Quality rules whose cutoffs are controlled for risk.

A rule rejects a text whose value exceeds a cutoff.  Cutoffs come from labelled
texts that the base rules keep: of the good ones of a stratum (a language), all
rules together may reject a share of at most ``risk``.  What the base rules
reject is no rejection of these rules, so such texts are no part of the sample,
and the certificate holds for the texts that the rules decide on.  The cutoffs of all rules are steps of one
fixed sequence (see ``steps``), each of which makes one rule stricter.  A step
is certified if, were the true share of all that is rejected so far just at
the limit, so few false rejections among so many good texts would have at most
probability ``level`` / strata: an exact binomial (Clopper-Pearson) bound with
Bonferroni's correction over strata.  The sequence stops at the first failure,
so it needs no further correction, and the risk is spent once, not once a
rule.  With probability 1 - ``level`` the rules hold the limit in all strata.
Of the certified steps the first is taken that still rejects ``enough`` of the
bad texts that the last one rejects.  A stratum with fewer good labels than
``least_labels`` (144 of four strata) can have no cutoff, and its texts are
kept.

The labelled texts are used for nothing but the cutoffs: which rules there are,
their cutoffs and their sequence are fixed beforehand, so all labels are the
holdout.

Defined results: a null text has no words; a very long text is counted as a
whole; a value equal to a cutoff is kept; a null stratum is a stratum of its
own; of several labels of one id the least counts; labels of texts that are not
there are ignored; an empty table gives no rows; repeated rows get a verdict
each; other columns go along in one struct, so names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scanweave.llm.common import small_batches, table, tidy, written
from scanweave.llm.textstats import COUNTS, add_counts, with_counts

RISK = 0.03
LEVEL = 0.05
ENOUGH = 0.98
MIN_WORDS, MOST_REPEATED = 50, 50


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


#: Each rule's value, and its cutoffs from the mildest to the strictest.
RULES: dict[str, tuple[Column, tuple[float, ...]]] = {}


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Values as columns over COUNTS; made on first use, as columns need a session."""
    if not RULES:
        RULES.update(
            {
                "symbols": (_share("n_symbols", "word_chars"), (0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
                "marks": (_share("n_marks", "n_words"), (1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1)),
                "dup_lines": (_share("n_dup_lines", "n_lines"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
                "repeats": (_share("n_repeat_words", "n_words"), (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
                "upper": (_share("n_upper", "word_chars"), (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
                "digits": (_share("n_digits", "word_chars"), (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1)),
            }
        )
    return RULES


def at_most(k: int, n: int, p: float) -> float:
    """Probability of at most k successes in n trials of probability p."""
    if k >= n:
        return 1.0
    if k >= n * p:  # beyond the mean: not small, and no certificate hangs on its exact value
        return 1.0 if k > n * p + 1 else max(0.5, _lower_tail(k, n, p))
    return _lower_tail(k, n, p)


def _lower_tail(k: int, n: int, p: float) -> float:
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):  # terms below the mean fall the faster, the farther from it
        total += term
        if term < total * 1e-17:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
    return min(1.0, total)


def certified(good: int, false: np.ndarray, caught: np.ndarray, limit: float, level: float, enough: float = ENOUGH) -> int | None:
    """The step to take, by number: false and caught are good and bad texts that are rejected at each step, mildest first."""
    passed = -1
    for i, k in enumerate(false):
        if good == 0 or at_most(int(k), good, limit) > level:
            break
        passed = i
    if passed < 0 or caught[passed] == 0:
        return None
    return int(np.flatnonzero(caught >= enough * caught[passed])[0])


def steps() -> list[tuple[str, int]]:
    """The fixed sequence of (rule, number of its cutoff): every rule's cutoffs in order, all rules from mild to strict at the same pace."""
    every = [(i / len(cuts), place, name, i) for place, (name, (_, cuts)) in enumerate(rules().items()) for i in range(len(cuts))]
    return [(name, i) for _, _, name, i in sorted(every)]


def counted(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """docs with COUNTS; without its text unless that is to be kept."""
    small_batches(docs.sparkSession)
    own = [f for f in docs.schema.fields if f.name != text and f.name not in COUNTS]
    read = docs.select(F.col(text), *(F.col(f"`{f.name}`") for f in own))
    schema = StructType([*read.schema.fields[0 if keep else 1 :], *(StructField(c, LongType()) for c in COUNTS)])
    return read.mapInArrow(tidy(with_counts if keep else add_counts), schema)


def cutoffs(labelled: DataFrame, stratum: str = "lang", label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(limit_of, good, false, max_<rule> ...) of each stratum with a certificate, from labelled rows with COUNTS: its good texts, how many of them the cutoffs reject, and the cutoffs (null: none).  Rows that fail the base rules are left out.

    Labelled rows are counted by step first, so what is certified is a row a
    stratum, in tasks by stratum; any number of strata will do.
    """
    own, sequence = rules(), steps()
    # the first step that rejects a text: from there on it is rejected
    first = F.least(*(F.when(own[name][0] > own[name][1][i], t).otherwise(len(sequence)) for t, (name, i) in enumerate(sequence)))
    each = labelled.filter(~base_failed()).select(F.col(stratum).cast("string").alias("stratum"), (F.col(label) == 1).alias("good"), first.alias("first"))
    counts = each.groupBy("stratum", "good", "first").agg(F.count("*").alias("n"))
    # at most two entries a step
    rows = written(counts.groupBy("stratum").agg(F.collect_list(F.struct("good", "first", "n")).alias("steps")), "steps")
    strata = max(1, rows.count())
    values = {name: cuts for name, (_, cuts) in own.items()}

    def certify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, found in batch[["stratum", "steps"]].itertuples(index=False):
                by = np.zeros((2, len(sequence) + 1), np.int64)
                for x in found:
                    by[int(x["good"]), x["first"]] += x["n"]
                caught, false = by.cumsum(1)[:, :-1]
                n = int(by[1].sum())
                last = certified(n, false, caught, risk, level / strata)
                if last is not None:
                    held = {name: values[name][i] for name, i in sequence[: last + 1]}
                    out.append((s, n, int(false[last]), *(held.get(name) for name in values)))
            yield pd.DataFrame(out, columns=["limit_of", "good", "false", *(f"max_{n}" for n in values)]).astype({f"max_{n}": float for n in values})

    return rows.mapInPandas(certify, "limit_of string, good long, false long, " + ", ".join(f"max_{n} double" for n in values))


def least_labels(strata: int, risk: float = RISK, level: float = LEVEL) -> int:
    """Good texts that a stratum needs for its first step to be certified, with no false rejection."""
    return math.ceil(math.log(level / strata) / math.log1p(-risk))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _limited(seen: DataFrame, known: DataFrame) -> DataFrame:
    """seen (with stratum and COUNTS) with base_failed and kept."""
    limits = known.drop("good", "false")
    bad = F.lit(False)
    for name, (value, _) in rules().items():
        # a cutoff that isn't there rejects nothing
        bad = bad | F.coalesce(value > F.nanvl(F.col(f"max_{name}"), F.lit(float("inf"))), F.lit(False))
    with_limits = seen.join(limits, F.col("stratum").cast("string").eqNullSafe(F.col("limit_of")), "left")
    return with_limits.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~bad)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, COUNTS, base_failed, kept) of every document."""
    seen = written(counted(docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.col(stratum).alias("stratum"))), "counts")
    marked = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("quality"))
    return _limited(seen, cutoffs(seen.join(marked, "key"), "stratum", "quality")).select("key", "stratum", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns as they are.

    Labelled texts are counted first, for the cutoffs; then each row goes
    through the rules as its text and one struct of its other columns, which
    can't clash with COUNTS.
    """
    marked = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").alias("quality"))
    known = cutoffs(counted(docs.select(F.col(text).alias("text"), F.col(key).alias("key"), F.col(stratum).alias("stratum")).join(marked, "key")), "stratum", "quality")
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    rows = counted(docs.select(F.col(text).alias("text"), F.col(stratum).alias("stratum"), others), keep=True)
    return _limited(rows, known).filter("kept").select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
