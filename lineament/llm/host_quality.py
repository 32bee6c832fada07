"""Quality rules with host-level verdicts.

Counts come from whole texts in one pass.  A row fails its base rules, or soft
ones (too many symbols, repeated lines, odd word lengths).  Failures are
aggregated by host; a host's rate is shrunk towards that of all hosts with a
beta prior fitted to the hosts' rates by moments, so that a host of few rows
isn't judged by them alone.  A host is judged by what its posterior makes
credible, two standard deviations off its mean, against the rate of all rows:

* rejected, if its rate is over half way from the common rate to one: none of its rows stays;
* trusted, if its rate is under half the common one: rows that fail soft rules alone stay;
* ordinary otherwise: those go.

Verdicts are joined back to the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineament.llm.words import Words, bounded, gram_names, mix, pieces, span_names, unused
from lineament.plans.storage import sized, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
# fixed values: the symbols counted
SYMBOLS = b"#*$%&|<>"
#: Where a host is rejected, as a share of the way from the common rate to one, and trusted, as a share of the common rate.
REJECT, TRUST = 0.5, 0.5
#: Standard deviations of a host's posterior that a verdict leaves room for.
DEVIATIONS = 2.0
_symbol = np.zeros(256, bool)
_symbol[[*SYMBOLS]] = True
_u = np.uint64


def _twice(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, not the group's first) for equal values of a row."""
    key = mix(value + mix(row.astype(np.uint64) + _u(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    many, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
    many[order], again[order] = same[:-1] | same[1:], same[:-1]
    return many, again


def counts(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text of a column."""
    w = Words(column)
    n, off, data = len(w.count), w.off, w.data
    by_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[off])
    chars = by_row(w.inside & ((data & 0xC0) != 0x80))
    symbols = by_row(_symbol[data])
    names, row = w.names(), w.rows()
    start = np.flatnonzero((np.arange(len(names)) + 3 <= w.at[1:][row])) if len(names) else np.zeros(0, int)
    many, _ = _twice(gram_names(names, 3)[start], row[start])
    cover = np.zeros(len(names) + 1, np.int64)
    np.add.at(cover, start[many], 1)
    np.add.at(cover, start[many] + 3, -1)
    repeat = np.bincount(row, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)
    # lines: bytes between line feeds of a row
    feed = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([off[:-1], feed + 1]))
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, feed, side="right") - 1]))
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - 1
    last = np.flatnonzero(np.append(line_row[1:] != line_row[:-1], True)) if len(begin) else np.zeros(0, int)
    end[last] = off[1:][line_row[last]]
    word_at = np.concatenate([[0], np.cumsum(w.inside)])
    full = word_at[end] > word_at[begin]
    begin, end, line_row = begin[full], end[full], line_row[full]
    _, again = _twice(span_names(data, begin, end), line_row)
    dup = np.bincount(line_row, weights=again, minlength=n).astype(np.int64)
    return [w.count, chars, symbols, dup, repeat, np.bincount(line_row, minlength=n)]


def _counted(names: list[str], text: str):
    def run(batches):
        for b in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), *(pa.array(x, pa.int64()) for x in counts(b.column(text)))], names=[*names, *("__" + k for k in COUNTS)])

    return run


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) from hosts' (n, failed) by moments; one row of sums reaches the driver.

    The mean is that of all rows.  The spread is the hosts' variance about it,
    weighted by rows, less what sampling alone would give; where none is left
    the prior weighs as much as a mean host.
    """
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    t = hosts.agg(F.sum(n).alias("rows"), F.sum(failed).alias("fails"), F.count("*").alias("hosts"), F.sum(failed * failed / n).alias("squares")).first()
    if not t["hosts"]:
        return 1.0, 1.0
    mean = t["fails"] / t["rows"]
    between = t["squares"] / t["rows"] - mean * mean - mean * (1 - mean) * t["hosts"] / t["rows"]
    weight = max(mean * (1 - mean) / between - 1, 1.0) if between > 0 and 0 < mean < 1 else t["rows"] / t["hosts"]
    return mean * weight, (1 - mean) * weight


def judged(docs: DataFrame, text: str = "text", least_words: int = 50) -> DataFrame:
    """docs with the columns __<count>, __base_failed and __soft_failed.

    Base: fewer than least_words words, or over half of the words in repeated
    three-word windows.  Soft: more than one symbol for ten words, ten lines or more of which over 30 %
    equal an earlier one, or a mean word of under 2 or over 15
    characters.  A null text has no words and fails.
    """
    shape = T.StructType([*docs.schema.fields, *(T.StructField("__" + c, T.LongType()) for c in COUNTS)])
    c = {k: F.col("__" + k) for k in COUNTS}
    base = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    soft = (10 * c["n_symbols"] > c["n_words"]) | ((c["n_lines"] >= 10) & (100 * c["n_dup_lines"] > 30 * c["n_lines"])) | (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])
    return bounded(docs).mapInArrow(_counted(docs.columns, text), shape).withColumn("__base_failed", base).withColumn("__soft_failed", soft)


def host_rates(rows: DataFrame, host: str = "source", reject: float = REJECT, trust: float = TRUST, deviations: float = DEVIATIONS) -> DataFrame:
    """(__host, __host_rate, __host_verdict) from judged() rows: shrunk shares of rows that fail any rule, and what follows.

    Sums are combined before the shuffle, so a host of very many rows costs no
    more than another.  Rows with a null host are a host of their own; a row
    that repeats counts each time.
    """
    failed = (F.col("__base_failed") | F.col("__soft_failed")).cast("long")
    hosts = written(rows.groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), F.sum(failed).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    common, weight = alpha / (alpha + beta), F.col("n") + alpha + beta
    out = hosts.withColumn("__host_rate", (F.col("failed") + alpha) / weight)
    out = out.withColumn("spread", deviations * F.sqrt(F.col("__host_rate") * (1 - F.col("__host_rate")) / (weight + 1)))
    bad = F.col("__host_rate") - F.col("spread") > common + reject * (1 - common)
    good = F.col("__host_rate") + F.col("spread") < trust * common
    return out.select("__host", "__host_rate", F.when(bad, "rejected").when(good, "trusted").otherwise("ordinary").alias("__host_verdict"))


def verdicts(rows: DataFrame, rates: DataFrame, host: str = "source") -> DataFrame:
    """judged() rows with __host_rate, __host_verdict and __kept."""
    out = rows.join(sized(rates, 120), rows[host].eqNullSafe(rates["__host"]), "left").drop("__host")
    bad = F.col("__base_failed") | (F.col("__host_verdict") == "rejected") | (F.col("__soft_failed") & (F.col("__host_verdict") != "trusted"))
    return out.withColumn("__kept", ~bad)


#: Columns that the operator adds; those of the input that are named so are replaced.
ADDED = ["__" + c for c in COUNTS] + ["__base_failed", "__soft_failed", "__host", "__host_rate", "__host_verdict", "__kept"]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(docs[c] for c in docs.columns if c.lower() not in ADDED))


def quality(docs: DataFrame, host: str = "source", text: str = "text", least_words: int = 50, reject: float = REJECT, trust: float = TRUST) -> DataFrame:
    """docs without the text, with judged()'s columns, __host_rate, __host_verdict and __kept; one pass over the texts.

    A null text has no words and fails its base rules; a null host is a host of
    its own; rows that repeat are judged and counted each; an empty table gives
    no rows.  Columns named like ADDED are replaced.
    """
    rows = written(judged(_plain(docs), text, least_words).drop(text), "judged")
    return verdicts(rows, host_rates(rows, host, reject, trust), host)


def accepted(docs: DataFrame, host: str = "source", text: str = "text", least_words: int = 50, reject: float = REJECT, trust: float = TRUST) -> DataFrame:
    """The rows of docs that are kept, as quality() says; two passes over the texts, of which only hosts' sums are shuffled.

    The columns are those of docs, as they are, whatever their names.
    """
    moved = {c: unused(docs, f"moved_{i}") for i, c in enumerate(docs.columns) if c.lower() in ADDED}
    rows = docs.select(*(docs[c].alias(moved.get(c, c)) for c in docs.columns))
    rates = host_rates(judged(rows.select(host, text), text, least_words), host, reject, trust)
    kept = verdicts(judged(rows, text, least_words), rates, host).filter("__kept")
    return kept.select(*(F.col(moved.get(c, c)).alias(c) for c in docs.columns))
