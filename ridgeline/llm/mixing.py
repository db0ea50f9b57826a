"""Mixing sources to target weights by iterative proportional fitting.

Every document gets its tokens (words) and a topic. Tokens are added up by (source, language, topic); the cells' weights
are raked until the source, language and topic marginals meet their targets; each cell's calibrated factor gives its
documents a probability, and a document is drawn if a hash of its id falls below it, so a draw needs no state and is the
same on every run.

Targets are shares of tokens by category. Left open, a dimension's target is each category's share to the power
`temperature`, made to add up to 1: small categories gain, large ones lose. Probabilities are scaled so that the expected
tokens are `budget` of all; no probability exceeds 1, and what a cell lacks at 1 the others make up.

Topics: the `TOPICS` buckets of hashed long words; a document's topic is the bucket that has most of its words, the
lowest of equals, and -1 without long words. Nulls: a null source or language is a category of its own; a null text has
no tokens; a null id is drawn by its text. Repeated rows are drawn together. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import Memo, forget, settle, text_or_empty, unused

TOPICS = 8
LONG = 6
#: Cells that the driver may rake in memory; more are raked in Spark.
MOST_CELLS = 200_000
NONE = "\x00"

_bucket = Memo(lambda w: 1 + xxhash.xxh3_64_intdigest(w.lower()) % TOPICS if len(w) >= LONG else 0, 150_000)


@F.pandas_udf(T.StructType([T.StructField("topic", T.IntegerType()), T.StructField("tokens", T.LongType())]))
def _topic_and_tokens(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in columns:
        topics, tokens = [], []
        for text in texts:
            words = text.split()
            n = np.bincount(np.fromiter(map(_bucket.__getitem__, words), np.int64, len(words)), minlength=TOPICS + 1)[1:]
            topics.append(int(n.argmax()) if n.any() else -1)
            tokens.append(len(words))
        yield pd.DataFrame({"topic": pd.array(topics, "int32"), "tokens": pd.array(tokens, "int64")})
    forget()


# Else Spark computes it once more, in a worker of its own a task, for the filter on nulls that it adds before a join.
_topic_and_tokens = _topic_and_tokens.asNondeterministic()


def _category(name: str) -> Column:
    """NONE for null; a value that begins like NONE gets one more of it before."""
    value = F.col(name).cast("string")
    return F.coalesce(F.when(F.startswith(value, F.lit(NONE)), F.concat(F.lit(NONE), value)).otherwise(value), F.lit(NONE))


def _value(category: Column) -> Column:
    """What _category was made from."""
    return F.when(category != NONE, F.when(F.startswith(category, F.lit(NONE)), F.substr(category, F.lit(2))).otherwise(category))


def _draw(seed: int) -> Column:
    """A number in [0, 1) fixed by the row's id (by its text if it has none)."""
    of = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    return F.pmod(F.xxhash64(F.lit(seed), of), F.lit(1 << 53)) / float(1 << 53)


def measure(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, tokens, draw for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _category("source").alias("source"), _category("lang").alias("lang"), _topic_and_tokens(text_or_empty()).alias("m"), _draw(seed).alias("draw"))
    return slim.select("doc_id", "source", "lang", "m.topic", "m.tokens", "draw")


DIMENSIONS = ["source", "lang", "topic"]


def targets_of(shares: pd.Series, temperature: float) -> pd.Series:
    w = shares.clip(lower=0) ** temperature
    return w / w.sum() if w.sum() else w


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Factors by cell: tokens * factor has the target shares in every dimension (total kept)."""
    tokens = cells.tokens.to_numpy(float)
    total, weight = tokens.sum(), tokens.copy()
    if not len(tokens):
        return weight
    codes = {d: pd.factorize(cells[d]) for d in targets}
    for _ in range(rounds):
        worst = 0.0
        for d, target in targets.items():
            code, names = codes[d]
            now = np.bincount(code, weight, len(names))
            goal = target.reindex(names).fillna(0).to_numpy() * total
            ratio = np.divide(goal, now, out=np.ones(len(names)), where=now > 0)
            worst = max(worst, float(np.abs(ratio[now > 0] - 1).max(initial=0)))
            weight = weight * ratio[code]
        if worst < tolerance:
            break
    return np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)


def scale(tokens: np.ndarray, factor: np.ndarray, budget: float) -> float:
    """The multiplier at which min(1, multiplier * factor) has budget of all tokens expected, or at which all that can be
    drawn is, if that is less. Cells reach 1 in order of their factors: between two of them the sum is a straight line."""
    goal, some = budget * tokens.sum(), factor > 0
    if not goal or not some.any():
        return 0.0
    order = np.argsort(-factor[some], kind="stable")
    f, t = factor[some][order], tokens[some][order]
    full = np.append(0.0, np.cumsum(t))[:-1]  # tokens of the cells before this one, all at 1
    rest = np.cumsum((f * t)[::-1])[::-1]  # factor * tokens of this one and those behind
    m = np.divide(goal - full, rest, out=np.full(len(f), np.inf), where=rest > 0)
    fits = np.flatnonzero(m * f <= 1)
    return float(max(m[fits[0]], 0.0)) if len(fits) else float(1 / f[-1])


def _source_goals(cells: DataFrame, total: float, temperature: float, given: dict | None) -> DataFrame:
    """source, goal (tokens): the given shares, nothing for what they lack, or the open target."""
    if given:
        named = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items() if v is not None], "source string, share double")
        return cells.select("source").distinct().join(named, "source", "left").select("source", (F.coalesce("share", F.lit(0.0)) * total).alias("goal"))
    w = settle(cells.groupBy("source").agg(F.pow(F.sum("tokens") / (total or 1.0), F.lit(temperature)).alias("goal")), "goals")
    norm = w.agg(F.sum("goal")).first()[0] or 1.0
    return w.withColumn("goal", F.col("goal") / norm * total)


def _rake_in_spark(cells: DataFrame, temperature: float, targets: dict[str, dict] | None = None, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """The same for any number of sources. A row holds a source with its cells, at most one for each (language, topic); it
    finds its own factor from those of the pairs. A round adds the pairs' weights up over all sources, and the driver, which
    holds a number for each pair, brings languages and topics to their goals."""
    spark = cells.sparkSession
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(["lang", "topic"]).reset_index(drop=True)
    total, n = float(pairs.tokens.sum()), len(pairs)
    codes, goals = {}, {}
    for d in ("lang", "topic"):
        codes[d], names = pd.factorize(pairs[d])
        shares = pd.Series(np.bincount(codes[d], pairs.tokens, len(names)) / (total or 1.0), index=names)
        given = (targets or {}).get(d)
        goals[d] = (pd.Series(given, dtype=float) if given else targets_of(shares, temperature)).reindex(names).fillna(0).to_numpy() * total
    numbers = spark.createDataFrame([(r.lang, int(r.topic), k) for k, r in enumerate(pairs.itertuples())], "lang string, topic int, pair int")
    own = cells.join(F.broadcast(numbers), ["lang", "topic"]).groupBy("source").agg(F.collect_list(F.struct("pair", F.col("tokens").cast("double").alias("tokens"))).alias("c"))
    rows = settle(own.join(_source_goals(cells, total, temperature, (targets or {}).get("source")), "source").select("source", "goal", F.col("c.pair").alias("pair"), F.col("c.tokens").alias("tokens")), "cells")

    def factors(batch: pa.RecordBatch, of_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each cell's row, pair and tokens, and each row's factor at these factors of the pairs (nan if it has no weight)."""
        goal, pair, tokens = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
        has = np.bincount(row, tokens * of_pair[pair], batch.num_rows)
        return row, pair, tokens, np.divide(goal, has, out=np.full(len(has), np.nan), where=has > 0)

    def add_up(of_pair: np.ndarray, before: np.ndarray | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, off = np.zeros(n), 0.0
            for batch in batches:
                row, pair, tokens, factor = factors(batch, of_pair)
                last = np.ones(len(factor)) if before is None else factors(batch, before)[3]
                off = max(off, np.nanmax(np.abs(factor / last - 1), initial=0.0))
                weight += np.bincount(pair, tokens * of_pair[pair] * np.nan_to_num(factor[row], nan=1.0), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n), pa.int32()), pa.array(np.append(off, weight), pa.float64())], names=["pair", "weight"])

        return work

    of_pair, before = np.ones(n), None
    for _ in range(rounds if total else 0):
        sums = rows.mapInArrow(add_up(of_pair, before), "pair int, weight double").groupBy("pair").agg(F.sum("weight").alias("weight"), F.max("weight").alias("most")).toPandas().set_index("pair")
        worst, weight = sums.most.get(-1, 0.0), sums.weight.reindex(range(n)).fillna(0).to_numpy()
        before, of_pair = of_pair, of_pair.copy()
        for d in ("lang", "topic"):
            now = np.bincount(codes[d], weight, len(goals[d]))
            ratio = np.divide(goals[d], now, out=np.ones(len(now)), where=now > 0)
            worst = max(worst, float(np.abs(ratio[now > 0] - 1).max(initial=0)))
            weight, of_pair = weight * ratio[codes[d]], of_pair * ratio[codes[d]]
        if worst < tolerance:
            break

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pair, tokens, factor = factors(batch, before if before is not None else of_pair)
            all_of = np.where(tokens > 0, np.nan_to_num(factor[row], nan=1.0) * of_pair[pair], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pair, pa.int32()), pa.array(tokens.astype(np.int64)), pa.array(all_of)], names=["source", "pair", "tokens", "factor"])

    return rows.mapInArrow(spell, "source string, pair int, tokens bigint, factor double").join(F.broadcast(numbers), "pair").select(*DIMENSIONS, "tokens", "factor")


def _scale_in_spark(raked: DataFrame, budget: float) -> float:
    """As scale, to a number's last digits: each pass tries 63 numbers between the bounds at once."""
    every, some, least = raked.agg(F.sum("tokens"), F.sum(F.col("factor") * F.col("tokens")), F.min(F.when(F.col("factor") > 0, F.col("factor")))).first()
    goal = budget * (every or 0)
    if not goal or least is None:
        return 0.0
    low, high = min(goal / some, 1 / least) if some else 1 / least, 1 / least
    for _ in range(12):
        bounds = [low, *(low * (high / low) ** (k / 64) for k in range(1, 64)), high]
        has = raked.agg(*(F.sum(F.least(F.lit(1.0), F.col("factor") * m) * F.col("tokens")) for m in bounds[:-1])).first()
        less = sum(x < goal for x in has)  # the sum grows with the number
        if less == 0 or (bounds[less - 1], bounds[less]) == (low, high):
            return low if less == 0 else high
        low, high = bounds[less - 1], bounds[less]
    return high


def calibrate(measured: DataFrame, budget: float = 0.7, temperature: float = 0.7, targets: dict[str, dict] | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """source, lang, topic, factor, probability: one row a cell."""
    spark = measured.sparkSession
    cells = settle(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    if cells.count() > most_cells:
        raked = settle(_rake_in_spark(cells, temperature, targets))
        return raked.select(*DIMENSIONS, "factor", F.least(F.lit(1.0), F.col("factor") * _scale_in_spark(raked, budget)).alias("probability"))
    table = cells.toPandas().sort_values(DIMENSIONS).reset_index(drop=True)  # at most most_cells rows
    goals = {}
    for d in DIMENSIONS:
        shares = table.groupby(d).tokens.sum().astype(float)
        goals[d] = pd.Series((targets or {}).get(d), dtype=float) if (targets or {}).get(d) else targets_of(shares / max(shares.sum(), 1.0), temperature)
    factor = rake(table, goals)
    probability = np.minimum(1.0, factor * scale(table.tokens.to_numpy(float), factor, budget))
    rows = [(r.source, r.lang, int(r.topic), float(f), float(p)) for r, f, p in zip(table.itertuples(), factor, probability, strict=True)]
    return spark.createDataFrame(rows, "source string, lang string, topic int, factor double, probability double")


def mix_sources(docs: DataFrame, budget: float = 0.7, temperature: float = 0.7, seed: int = 1, targets: dict[str, dict] | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, factor, probability, sampled: one row for each row of docs."""
    measured = settle(measure(docs, seed))
    cells = calibrate(measured, budget, temperature, targets, most_cells)
    return measured.join(cells, DIMENSIONS).select(
        "doc_id", *(_value(F.col(c)).alias(c) for c in ("source", "lang")), "topic", "tokens", "factor", "probability", (F.col("draw") < F.col("probability")).alias("sampled"))


def sample_documents(docs: DataFrame, budget: float = 0.7, temperature: float = 0.7, seed: int = 1, targets: dict[str, dict] | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """The rows of docs that are drawn, all columns kept. Documents are not shuffled while the cells are few: the
    factors come to the texts."""
    cells = calibrate(measure(docs, seed), budget, temperature, targets, most_cells)
    mixed = unused(docs, "mixed")
    cells = cells.select(F.struct(*DIMENSIONS).alias(cell := unused(docs, "cell")), F.col("probability").alias(chance := unused(docs, "chance")))
    rows = docs.withColumn(mixed, F.struct(_category("source").alias("source"), _category("lang").alias("lang"), _topic_and_tokens(text_or_empty()).topic.alias("topic")))
    rows = rows.join(cells, (F.col(mixed).source == F.col(cell).source) & (F.col(mixed).lang == F.col(cell).lang) & (F.col(mixed).topic == F.col(cell).topic))
    return rows.where(_draw(seed) < F.col(chance)).select(*(F.col(f"`{c}`") for c in docs.columns))
