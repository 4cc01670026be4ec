"""Toxicity by a classifier chain: one linear model per category, each fed the ones before.

Words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) and their first five bytes, which
tell inflected forms, are hashed to presence features.
A model takes the buckets that a chi-square test finds telling, at most `features`, and is a logistic
regression with a ridge penalty, solved by Newton steps. The categories are fitted in order; from the second
on, a model also reads the probabilities of the earlier categories. Its training rows get those from
models that did not see them (out of fold), so that it learns how reliable they really are; when
documents are scored, the earlier models proper supply them.

Fitting uses at most `max_rows` labelled documents (a documented bound: those with the least hash of their
id), so one fold fits in a task and the folds are fitted side by side; scoring covers every
document in one pass without a shuffle. Labels other than 0 and 1 are ignored; of several label rows for an id
the largest values count. Null and empty texts are scored as having no words. Of a category whose
labels are all alike that label is the certain answer. Without any usable label (an empty table) all
probabilities are null and nothing is toxic. Columns of the documents are kept; columns named
like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from staycoder.llm.hashing import buffers, words
from staycoder.llm.memory import tidied
from staycoder.sources.shared import write_once


STEM_BYTES = 5
SLICE_ROWS = 512  # texts whose words a task holds at a time


@dataclass(frozen=True)
class ChainConfig:
    categories: tuple[str, ...] = ("quality", "toxic")
    folds: int = 3
    max_rows: int = 20_000
    buckets: int = 1 << 18
    features: int = 400
    least_documents: int = 3
    least_chi: float = 10.83  # one in a thousand buckets without any bearing reaches it
    ridge: float = 1.0
    steps: int = 25


@dataclass
class Model:
    """Weights of the chosen buckets, of the earlier categories' probabilities, and the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    intercept: float

    def probability(self, table: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """`table`: documents x chosen buckets (0 or 1); `earlier`: documents x earlier categories."""
        margin = table @ self.weights[: len(self.chosen)] + earlier @ self.weights[len(self.chosen) :] + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def presence(column, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct buckets of each text."""
    hashes, first, stems = words(*buffers(column), marks=True, prefix=STEM_BYTES)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    owner, hashes = np.concatenate([owner, owner]), np.concatenate([hashes, stems])
    pair = np.sort(owner * buckets + (hashes % np.uint64(buckets)).astype(np.int64))
    pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair
    return pair // buckets, pair % buckets


def as_table(owner: np.ndarray, bucket: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(chosen)))
    if len(chosen) and len(bucket):
        slot = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
        hit = chosen[slot] == bucket
        out[owner[hit], slot[hit]] = 1
    return out


def fit_model(owner: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, label: np.ndarray, config: ChainConfig) -> Model:
    n = len(label)
    if not n or label.min() == label.max():
        sure = 0.0 if not n else (40.0 if label[0] else -40.0)
        return Model(np.zeros(0, dtype=np.int64), np.zeros(earlier.shape[1]), sure)
    df = np.bincount(bucket, minlength=config.buckets).astype(float)
    hits = np.bincount(bucket, weights=label[owner], minlength=config.buckets)
    share = label.mean()
    inside, outside = df * share, df * (1 - share)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hits - inside) ** 2 / inside + (df - hits - outside) ** 2 / outside
        chi *= n / np.maximum(n - df, 1)
    chi[(df < config.least_documents) | (df == n) | (chi < config.least_chi)] = 0
    chosen = np.sort(np.argsort(-chi, kind="stable")[: config.features])
    chosen = chosen[chi[chosen] > 0]
    x = np.hstack([as_table(owner, bucket, n, chosen), earlier, np.ones((n, 1))])
    penalty = np.full(x.shape[1], config.ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log(share / (1 - share))

    def loss(b: np.ndarray) -> float:
        margin = x @ b
        return float(np.logaddexp(0, margin).sum() - label @ margin + (penalty * b * b).sum() / 2)

    value = loss(beta)
    for _ in range(config.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (p - label) + penalty * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(curve, slope), 1.0
        while (after := loss(beta - size * step)) > value and size > 1e-6:
            size /= 2
        if value - after < 1e-9 * n:
            break
        beta, value = beta - size * step, after
    return Model(chosen, beta[:-1], float(beta[-1]))


def _bags(config: ChainConfig):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                owner, bucket = presence(part.column("text"), config.buckets)
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket.astype(np.int32)))
                rest = [part.column(c) for c in ("fold", "y", "earlier")]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=["fold", "y", "earlier", "bag"])

    return tidied(run)


def _columns(table):
    """(owner, bucket, earlier, y) of rows with bags."""
    bag = table.column("bag").combine_chunks()
    owner = np.repeat(np.arange(len(bag)), bag.value_lengths().to_numpy())
    bucket = bag.flatten().to_numpy().astype(np.int64)
    y = np.array(table.column("y").to_pylist(), dtype=float).reshape(len(bag), -1)
    earlier = np.array(table.column("earlier").to_pylist(), dtype=float).reshape(len(bag), -1)
    return owner, bucket, earlier, y


def _fit_group(config: ChainConfig, category: int):
    def run(table):
        import pyarrow as pa

        owner, bucket, earlier, y = _columns(table)
        model = fit_model(owner, bucket, earlier, y[:, category], config)
        return pa.table(
            {
                "job": pa.array([table.column("job")[0].as_py()], pa.int32()),
                "chosen": pa.array([model.chosen.tolist()], pa.list_(pa.int64())),
                "weights": pa.array([model.weights.tolist()], pa.list_(pa.float64())),
                "intercept": pa.array([model.intercept], pa.float64()),
            }
        )

    return run


def _add_held_out(models: dict[int, Model]):
    """Append each row's probability by the model that did not see its fold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            owner, bucket, earlier, _ = _columns(table)
            fold = table.column("fold").to_numpy()
            p = np.zeros(len(fold))
            for one, model in models.items():
                use = fold == one
                if use.any():
                    p[use] = model.probability(as_table(owner, bucket, len(fold), model.chosen)[use], earlier[use])
            grown = pa.array(np.hstack([earlier, p[:, None]]).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("y"), grown, batch.column("bag")], names=["fold", "y", "earlier", "bag"])

    return run


ROWS = "fold int, y array<double>, earlier array<double>, bag array<int>"


def labelled_sample(docs: DataFrame, labels: DataFrame, config: ChainConfig, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bags and categories of at most max_rows labelled documents. The chosen ids are broadcast: they are bounded."""
    names = list(config.categories)
    sound = labels.select(F.col(doc_id).alias("_id"), *names).dropna()
    for name in names:
        sound = sound.where(F.col(name).isin(0, 1))
    sound = sound.groupBy("_id").agg(*[F.max(F.col(n).cast("double")).alias(n) for n in names])
    chosen = sound.orderBy(F.xxhash64("_id"), "_id").limit(config.max_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").select(
        "text",
        F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(config.folds)).cast("int").alias("fold"),
        F.array(*names).alias("y"),
        F.array().cast("array<double>").alias("earlier"),
    )
    return rows.mapInArrow(_bags(config), ROWS)


def fit_chain(
    docs: DataFrame, labels: DataFrame, config: ChainConfig = ChainConfig(), doc_id: str = "doc_id", text: str = "text"
) -> list[Model] | None:
    """One model per category, in order; None if no document is labelled."""
    rows = write_once(labelled_sample(docs, labels, config, doc_id, text), "labelled-bags")
    if rows.isEmpty():
        return None
    models = []
    for category in range(len(config.categories)):
        last = category + 1 == len(config.categories)
        folds = [] if last else list(range(config.folds))
        # job -1 learns from all rows, job k from the rows outside fold k
        jobs = F.filter(F.array(*[F.lit(k) for k in [-1, *folds]]), lambda k: k != F.col("fold"))
        fitted = rows.withColumn("job", F.explode(jobs)).groupBy("job").applyInArrow(
            _fit_group(config, category), "job int, chosen array<long>, weights array<double>, intercept double"
        )
        found = {
            r["job"]: Model(np.array(r["chosen"], dtype=np.int64), np.array(r["weights"], dtype=float), r["intercept"]) for r in fitted.collect()
        }
        models.append(found.pop(-1))
        if not last:
            rows = write_once(rows.mapInArrow(_add_held_out(found), ROWS), "out-of-fold")
    return models


def _score(models: list[Model], text: str, buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(i, SLICE_ROWS)
                owner, bucket = presence(part.column(text), buckets)
                earlier = np.zeros((part.num_rows, 0))
                for model in models:
                    p = model.probability(as_table(owner, bucket, part.num_rows, model.chosen), earlier)
                    earlier = np.hstack([earlier, p[:, None]])
                columns = [*part.columns, *[pa.array(earlier[:, k]) for k in range(len(models))]]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *[f"_p{k}" for k in range(len(models))]])

    return tidied(run)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    config: ChainConfig = ChainConfig(),
    threshold: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The columns of `docs` with p_<category> and `is_toxic` (the last category reaches `threshold`)."""
    names = [f"p_{c}" for c in config.categories]
    models = fit_chain(docs, labels, config, doc_id, text)
    docs = docs.drop(*names, "is_toxic")
    if models is None:
        return docs.withColumns({n: F.lit(None).cast("double") for n in names} | {"is_toxic": F.lit(False)})
    schema = StructType([*docs.schema.fields, *[StructField(f"_p{k}", DoubleType()) for k in range(len(names))]])
    scored = docs.mapInArrow(_score(models, text, config.buckets), schema)
    scored = scored.withColumnsRenamed({f"_p{k}": n for k, n in enumerate(names)})
    return scored.withColumn("is_toxic", F.col(names[-1]) >= threshold)
