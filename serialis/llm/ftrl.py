"""Follow-the-regularised-leader training of sparse linear models, over the partitions of a table.

Each shard of the rows runs FTRL-proximal from the shared state, and the shards' states are
averaged after every pass. The state is a pair of sums for each weight, of bounded size.
"""

from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import summed

SHARDS = 4


class Leader:
    """FTRL-proximal with elastic-net penalties for `outputs` weights per feature; the last of the
    `features` + 1 rows is the intercept. One output: logistic; more: softmax."""

    def __init__(self, features: int, outputs: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, outputs)), np.zeros((features + 1, outputs))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        ids, values = np.append(ids, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(ids)
        logits = values @ w
        if len(logits) == 1:
            error = 1 / (1 + np.exp(-np.clip(logits, -35, 35))) - label
        else:
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
        g = values[:, None] * error
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g

    def state(self) -> np.ndarray:
        return np.concatenate([self.z.ravel(), self.n.ravel(), [1.0]])

    def average(self, total: np.ndarray) -> None:
        if total[-1]:
            z, n = np.split(total[:-1] / total[-1], 2)
            self.z, self.n = z.reshape(self.z.shape), n.reshape(self.n.shape)


def train(rows: DataFrame, leader: Leader, passes: int) -> Leader:
    """rows: (ids array<int>, values array<float>, label int, key long), already bounded. Returns the
    leader. The key, a hash, deals rows to shards and orders them there, so that a rerun learns the
    same, however the rows are partitioned."""
    order = ["shard", "key", "label", "tie"]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS))).withColumn("tie", F.xxhash64("ids", "values"))
    sharded = dealt.repartition(SHARDS, "shard").sortWithinPartitions(*order).select("ids", "values", "label", "shard")

    def learner(start: Leader):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            now, mine = None, start
            for batch in batches:
                for ids, values, label, shard in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if shard != now:
                        if now is not None:
                            yield mine.state()
                        now, mine = shard, deepcopy(start)
                    mine.learn(ids.values.to_numpy(zero_copy_only=False), values.values.to_numpy(zero_copy_only=False).astype(np.float64), label)
            if now is not None:
                yield mine.state()

        return run

    for _ in range(passes):
        leader.average(summed(sharded, learner(leader), len(leader.state()), SHARDS))
    return leader
