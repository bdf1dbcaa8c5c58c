"""Operator 4: mixing sources to target weights by iterative proportional fitting.

Every document has a cell: source, language and topic. The tokens of all cells are summed; raking
then scales the cells' weights in turn until the shares of sources, languages and topics all meet
their targets. A document's probability is its cell's weight a token times one factor, capped at 1;
the factor makes the expected tokens equal the budget. A document is kept when the hash of its id
falls below its probability, so the choice is the same in every run.

Targets: a dictionary of shares for each margin (values not named share what is left, in proportion
to their tokens), or by default the tokens' shares raised to `temper` (below 1 lifts small ones). Tokens
are words between blanks, counted over whole texts.
Raking is a sum over cells only: where they are few (`local_cells`, counted first), their sums come
to the driver; beyond that, the same steps run as aggregations and joins over the cell table, to the
same tolerance and round limit. Where the limit comes first, a warning names the deviation left.

Defined results: null sources and languages are values of their own; null and empty texts have no
tokens, get their cell's probability and the topic `none`; rows with the same id share one fate; an
empty table gives an empty result. Documents are read once for the sums and once for the choice, or
only once where the result needs no texts (topics and tokens are then kept in a narrow table); a
source with a third of all rows is a few partial sums.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import cut, spread_join, table

MARGINS = ("source", "lang", "topic")
NULL = "\x00"
ROUNDS, TOLERANCE = 100, 1e-9  # of raking, on either path
LOCAL = 50_000  # rows of a counted table that is still collected or broadcast
MADE = ("mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept")


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of `text` are in the class `chars`; the runs of others go in one linear pass."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", ""))


def topic_of(text: Column) -> Column:
    """A coarse topic by form: code, list, shout, legal, long or prose; `none` for texts without a word.

    Code, list and shout are shares of the text's characters: a tenth of marks, a twentieth of bars
    and tabs, half of capitals.
    """
    n = F.length(text)
    return (F.when(~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), "none").when(_count_of(text, "{}#*$%&<>=;") * 10 > n, "code").when(_count_of(text, r"|\t") * 20 > n, "list")
            .when(_count_of(text, "A-Z") * 2 > n, "shout").when(F.lower(text).rlike("license|rights reserved"), "legal").when(n > 8000, "long").otherwise("prose"))


def tokens_of(text: Column) -> Column:
    """Words between blanks."""
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    # a single plain character is split without a regular expression
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def target_shares(tokens: dict[str, float], wanted: dict[str, float] | None, temper: float) -> dict[str, float]:
    """The share that each value of a margin is to have; they sum to 1 over the values that have tokens."""
    total = sum(tokens.values())
    if not total:
        return dict.fromkeys(tokens, 0.0)
    if wanted is None:
        raised = {k: (v / total) ** temper if v else 0.0 for k, v in tokens.items()}
    else:
        named = {k: wanted[k] for k in tokens if k in wanted and tokens[k]}
        rest = {k: v for k, v in tokens.items() if k not in wanted}
        left = max(0.0, 1 - sum(named.values()))
        raised = named | {k: left * v / max(sum(rest.values()), 1e-300) for k, v in rest.items()}
    sum_ = sum(raised.values())
    return {k: v / sum_ for k, v in raised.items()}


def _report(worst: float, rounds: int) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds; a share was still {worst:.3g} off its target in the last", RuntimeWarning, stacklevel=3)


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights (shares of the mixture) whose margins meet the targets; `codes`: a row for each margin."""
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weights=w, minlength=len(target))
            worst = max(worst, float(np.abs(have - target).max(initial=0)))
            w = w * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if worst < tolerance:
            break
    else:
        _report(worst, rounds)
    return w


def factor_for(weights: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """The factor c for which sum(tokens * min(1, c * weight / tokens)) is the budget (or all tokens)."""
    some = (tokens > 0) & (weights > 0)
    w, t = weights[some], tokens[some].astype(float)
    if not len(w) or budget >= t.sum():
        return float("inf")
    full = t / w  # the factor at which a cell is taken whole
    order = np.argsort(full)
    w, t, full = w[order], t[order], full[order]
    taken, open_ = np.concatenate(([0], np.cumsum(t)))[:-1], w[::-1].cumsum()[::-1]
    c = (budget - taken) / open_
    return float(c[np.argmax(c <= full)])


def _cells(spread: DataFrame) -> DataFrame:
    return spread.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))


def _local(cells: DataFrame, wanted: dict, temper: float, budget_share: float, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with weight and probability, raked in the driver (their number was counted)."""
    rows = sorted(cells.collect())
    tokens = np.array([r.tokens for r in rows], dtype=float)
    codes, targets = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows})
        number = {v: i for i, v in enumerate(values)}
        code = np.array([number[r[m]] for r in rows], dtype=np.int64)
        shares = target_shares(dict(zip(values, np.bincount(code, weights=tokens, minlength=len(values)).tolist(), strict=True)), wanted.get(m), temper)
        codes.append(code)
        targets.append(np.array([shares[v] for v in values]))
    w = rake(tokens, np.array(codes), targets, tolerance=tolerance) if rows else tokens
    c = factor_for(w, tokens, budget_share * tokens.sum())
    p = np.minimum(1.0, c * np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)) if np.isfinite(c) else np.ones(len(rows))
    p = np.where(tokens > 0, p, 1.0)
    out = [(*(r[m] for m in MARGINS), float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, weight double, probability double")


def _joined(cells: DataFrame, few: DataFrame, margin: str, n: int) -> DataFrame:
    """Cells with a column of the margin's values, of which there are `n`."""
    return cells.join(F.broadcast(few), margin) if n <= LOCAL else spread_join(cells, few, margin, "tokens")


def _spread(cells: DataFrame, wanted: dict, temper: float, budget_share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same over the cell table, which is never rewritten: a cell's weight is its tokens' share times one factor of each margin.

    Each step sums the cells by one margin, under the factors of the others, which gives that margin's
    new factors; those of up to `LOCAL` values (counted) come by way of the driver and are broadcast,
    others are written and joined.
    """
    spark = cells.sparkSession
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    factors, values = {}, {}
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("t"))
        if wanted.get(m) is None:
            raised = sums.withColumn("r", F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(total, 1))), F.lit(temper))).otherwise(0.0))
        else:
            named = spark.createDataFrame([*wanted[m].items()], f"{m} string, share double")
            joined = sums.join(named, m, "left")
            left = 1 - (joined.where("t > 0").agg(F.sum("share")).first()[0] or 0.0)
            rest = joined.where("share is null").agg(F.sum("t")).first()[0] or 0
            raised = joined.withColumn("r", F.when(F.col("share").isNotNull(), F.when(F.col("t") > 0, F.col("share")).otherwise(0.0)).otherwise(F.lit(max(left, 0.0)) * F.col("t") / F.lit(float(max(rest, 1)))))
        every = raised.agg(F.sum("r")).first()[0] or 1.0
        factors[m] = cut(raised.select(m, (F.col("r") / F.lit(float(every))).alias("target"), F.lit(1.0).alias("f")))
        values[m] = factors[m].count()

    def weighted(without: str | None = None) -> DataFrame:
        out, w = cells, share
        for m in MARGINS:
            if m != without:
                out, w = _joined(out, factors[m].select(m, F.col("f").alias(f"f_{m}")), m, values[m]), w * F.col(f"f_{m}")
        return out.withColumn("weight", w).select(*MARGINS, "tokens", "weight")

    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            have = weighted(m).groupBy(m).agg(F.sum("weight").alias("h")).join(factors[m], m)
            new = have.select(m, "target", F.when(F.col("h") > 0, F.col("target") / F.col("h")).otherwise(0.0).alias("f"), F.abs(F.col("h") * F.col("f") - F.col("target")).alias("off"))
            factors[m] = spark.createDataFrame(new.toArrow()) if values[m] <= LOCAL else cut(new)
            worst = max(worst, factors[m].agg(F.max("off")).first()[0] or 0.0)
        if worst < tolerance:
            break
    else:
        _report(worst, rounds)
    now = cut(weighted())
    # the factor by narrowing: each pass sums the cell table for many factors at once
    budget, low, high = budget_share * total, 0.0, float(max(total, 1)) * 1e6
    if budget >= total:
        return now.select(*MARGINS, "weight", F.lit(1.0).alias("probability"))
    for k in range(16):
        tries = [low + (high - low) * i / 32 for i in range(1, 32)] if k > 5 or low else [high / 16.0**i for i in range(31, 0, -1)]
        sums = now.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * c)) for c in tries]).first()
        low, high = max([low, *(c for c, got in zip(tries, sums, strict=True) if (got or 0.0) < budget)]), min([high, *(c for c, got in zip(tries, sums, strict=True) if (got or 0.0) >= budget)])
    return now.select(*MARGINS, "weight", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(high) * F.col("weight") / F.col("tokens"))).otherwise(1.0).alias("probability"))


def mix_sources(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.7, budget_share: float = 0.8, seed: int = 11, local_cells: int = LOCAL, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, keep_text: bool = True) -> DataFrame:
    """The input's rows with mix_tokens, mix_topic, mix_weight (of the cell), mix_probability and mix_kept.

    Without `keep_text` the rows come without their texts, and topics and tokens are taken only once.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    columns = [c for c in docs.columns if (keep_text or c != text_col) and c.lower() not in MADE]
    own = docs.select(F.struct(*columns).alias("row"), value("source").alias("source"), value("lang").alias("lang"), F.coalesce(topic if topic is not None else topic_of(F.col(text_col)), F.lit(NULL)).alias("topic"), tokens_of(F.col(text_col)).alias("n_tokens"))
    own = own if keep_text else cut(own)
    cells = cut(_cells(own))
    n = cells.count()
    made = (_local if n <= local_cells else _spread)(cells, targets or {}, temper, budget_share, tolerance=tolerance)
    if n <= local_cells:
        # at most local_cells rows, counted above
        rows = own.join(F.broadcast(made), [*MARGINS])
    else:
        key = F.xxhash64(*MARGINS).alias("cell")
        rows = spread_join(own.select("*", key, F.xxhash64(F.col(f"row.{id_col}")).alias("h")), cut(made.select(key, "weight", "probability")), "cell", "h", 64)
    place = F.pmod(F.xxhash64(F.col(f"row.{id_col}"), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return rows.select("row.*", F.col("n_tokens").alias("mix_tokens"), F.col("topic").alias("mix_topic"), F.round("weight", 9).alias("mix_weight"), F.round("probability", 9).alias("mix_probability"), (place < F.col("probability")).alias("mix_kept"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = mix_sources(docs, keep_text=False)
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("cell_weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))


QUERIES = {"op4_mixing": op4_mixing}
