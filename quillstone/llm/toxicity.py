"""Toxicity by weak supervision.

1. Lexicon and pattern voters (whole words; word prefixes of 3 to 6 letters) are taken
   from a bounded sample of labelled training rows by log-odds.
2. A generative label model fits, by expectation-maximisation over the sample's votes,
   each voter's accuracy and the correlation of voters beyond what the posterior
   explains; correlated voters share one vote.
3. A linear classifier (logistic regression over word and prefix features) is trained on
   the posterior labels, calibrated on the sample, and scores every whole text.

Only the text is an input of a score. Null and empty texts get the score of a text
without evidence; texts are scored whole, of any length. Rows repeat freely: equal texts
count once in training, as toxic if any of them is; features with equal odds stand in the
order of their spelling. Labels for unknown documents, null labels and training sets without
a toxic row are fine (the score is then the base rate). A column of the score's name is
replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillstone.llm.common import batches_of, keep, text_slices

#: The classifier is fitted on at most so many labelled rows, the ones with the least id hash.
LABELLED = 12_000
#: Rows of the sample that a feature must be seen in; all that then pass the bars below are used.
SUPPORT = 4
#: The accuracy of a word, and of a prefix, must be so high at the lower end of a Wilson interval of so many deviations.
ACCURATE, ACCURATE_PREFIX, SURE = 0.6, 0.85, 2.0
#: Deviations from even odds that a feature other than a voter must show.
FEATURE_Z = 8
#: Weight of the first guess of a voter's accuracy beside its votes.
GUESS = 2.0
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
LETTERS = regex.compile(r"\p{L}+")
MEMO = 300_000
#: Rows handed at once to the task that lists the features of labelled texts.
ROWS = 1000


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def features_of(text: str) -> set[str]:
    """Words, and prefixes marked by ``*``, of the lower-cased text."""
    out = set()
    for w in set(LETTERS.findall(text.lower())):
        out.add(w)
        out.update(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return out


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 2):
        lists = [sorted(features_of(t or "")) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.string()))], ["_key", "_y", "feature"])


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str, memo: dict[str, tuple[str, ...]]) -> float:
        hit: set[str] = set()
        for w in set(LETTERS.findall(text.lower())):
            found = memo.get(w)
            if found is None:
                found = tuple(f for f in [w, *(w[:k] + "*" for k in PREFIXES if len(w) > k)] if f in self.weights)
                memo[w] = found
            hit.update(found)
        if len(memo) > MEMO:
            memo.clear()
        z = self.bias + sum(self.weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def logit(p):
    return np.log(p / (1 - p))


def label_model(votes: np.ndarray, prior: float, accuracy: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's accuracy and its share of a vote.

    A voter votes toxic or abstains, and abstaining says nothing by itself; a last voter
    is added that votes clean where all others abstain. accuracy: first guesses of the
    chance that a row with the vote is toxic. Voters whose votes go together beyond what
    the posterior explains share one vote.
    """
    v = np.c_[votes, ~votes.any(axis=1)].astype(np.float64)
    cast = v.sum(0)
    guess = right = np.clip(np.r_[accuracy, prior / 20], 1e-3, 1 - 1e-3)
    share, base = np.ones(v.shape[1]), logit(prior)
    q = np.full(len(v), prior)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-np.clip(base + v @ (share * (logit(right) - base)), -30, 30)))
        done = np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
        right = np.clip((q @ v + GUESS * guess * cast + prior) / ((1 + GUESS) * cast + 1), 1e-3, 1 - 1e-3)
        rest = v - np.clip(np.outer(q, right * cast / max(q.sum(), 1e-9)) + np.outer(1 - q, (1 - right) * cast / max((1 - q).sum(), 1e-9)), 0, 1)
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        linked = rest.T @ rest / len(v) / np.outer(spread, spread)
        linked[linked < 0.2] = 0
        np.fill_diagonal(linked, 1)
        share = 1 / linked.sum(1)
    return q, right, share


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.05, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels q, by Newton steps; ridge is that of the summed loss."""
    k = x.shape[1]
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    penalty = np.r_[np.full(k, ridge), 1e-6]
    w = np.r_[np.zeros(k), logit(np.clip(q.mean(), 1e-4, 1 - 1e-4))]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - q) + penalty * w)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """labels: the rows to learn from (id, label 0/1). All that comes to the driver is bounded by the labelled rows."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(label_col).cast("int").alias("_y"))
    # At most `labelled` rows of two numbers are broadcast.
    y = y.orderBy(F.xxhash64("_key"), "_key").limit(labelled)
    drawn = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(y), "_key")
    copy = F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256)
    # Equal texts count once, as toxic if any of them is.
    drawn = drawn.groupBy(copy.alias("_copy")).agg(F.min("_key").alias("_key"), F.max("_y").alias("_y"), F.first("_text").alias("_text")).select("_key", "_y", "_text")
    kind = docs.schema[id_col].dataType.simpleString()
    with batches_of(docs.sparkSession, ROWS):
        rows = keep(drawn.mapInArrow(_feature_batches, f"_key {kind}, _y int, feature array<string>"), "labelled")
    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        rate = min(max(pos / max(1, pos + neg), 1e-3), 1 - 1e-3)
        return Model(float(np.log(rate / (1 - rate))), {})
    seen = rows.select("_y", F.explode("feature").alias("f")).groupBy("f").agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    seen = seen.filter(F.col("p") + F.col("n") >= SUPPORT).withColumn("odds", odds)
    seen = seen.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5)))
    top = seen.filter(F.abs("z") >= FEATURE_Z).orderBy(F.desc(F.abs("z")), "f").toPandas()
    m = F.col("p") + F.col("n")
    rate, sq = F.col("p") / m, SURE**2
    sure = (rate + sq / (2 * m) - SURE * F.sqrt(rate * (1 - rate) / m + sq / (4 * m * m))) / (1 + sq / m)
    lexicon = seen.withColumn("sure", sure).filter(F.col("sure") >= F.when(F.endswith("f", F.lit("*")), ACCURATE_PREFIX).otherwise(ACCURATE)).orderBy(F.desc("sure"), "f").toPandas()
    names = list(dict.fromkeys([*lexicon["f"], *top["f"]]))
    place = {f: i for i, f in enumerate(names)}
    wanted = F.array(*[F.lit(f) for f in names]) if names else F.array().cast("array<string>")
    held = rows.select("_key", "_y", F.array_intersect("feature", wanted).alias("f")).toPandas().sort_values("_key", kind="stable")
    x = np.zeros((len(held), len(names)), np.float32)
    for i, fs in enumerate(held["f"]):
        x[i, [place[f] for f in fs]] = 1
    k = len(lexicon)
    prior = pos / (pos + neg)
    first = (lexicon["p"].to_numpy(float) + prior) / (lexicon["p"].to_numpy(float) + lexicon["n"].to_numpy(float) + 1)
    q = label_model(x[:, :k] > 0, prior, first)[0] if k else np.full(len(x), prior)
    w, bias = logistic(x, q)
    # Scale and shift the scores so that they read as chances on the labelled sample.
    scale, shift = logistic((x @ w + bias)[:, None], held["_y"].to_numpy(float), ridge=1.0)
    scale = max(float(scale[0]), 0.1)
    w, bias = w * scale, bias * scale + shift
    return Model(bias, {f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-4})


def scored_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int, out_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with the score of the texts in column `at`, cut so that few texts are held as strings and sent back at once."""
    memo: dict[str, tuple[str, ...]] = {}
    for batch in text_slices(batches, at):
        scores = pa.array([model.score(t or "", memo) for t in batch.column(at).to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, out_col])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text; a column of that name is replaced."""
    docs = docs.drop(out_col) if out_col != text_col else docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored_batches(batches, model, at, out_col)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))
