"""Seeded sampling of beliefs, and recovery of planted edge rates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges without evidence are drawn from this mean and strength.
PRIOR_MEAN, PRIOR_STRENGTH = 0.75, 2.0
SOFTMIN_T = 0.1


def sampled_chains(edges: DataFrame, samples: int = 2000, seed: int = 0) -> DataFrame:
    """``chain_id, efficacy, low, high``: mean and 95 % range of the softmin over sampled edges.

    ``edges`` has ``chain_id, src, dst, edge_type, alpha, beta``. An edge's draws depend
    on its name and the seed alone, so chains that share it share its draws, whatever
    task computes them. Beliefs are re-centred on the informed prior and floored.
    """
    key = F.xxhash64(F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string"), "edge_type")
    x = edges.select("chain_id", key.alias("k"), "alpha", "beta").repartition("chain_id").sortWithinPartitions("chain_id", "k")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        chain, total, n = None, np.zeros(samples), 0
        out: list[tuple[int, float, float, float]] = []

        def close() -> None:
            if chain is not None:
                p = -SOFTMIN_T * np.log(total / n)
                out.append((chain, p.mean(), np.quantile(p, 0.025), np.quantile(p, 0.975)))

        @lru_cache(maxsize=4096)  # an edge of many chains of a task is drawn once
        def drawn(k: int, a: float, b: float) -> np.ndarray:
            a, b = max(a - 1 + PRIOR_MEAN * PRIOR_STRENGTH, 1e-6), max(b - 1 + (1 - PRIOR_MEAN) * PRIOR_STRENGTH, 1e-6)
            return np.exp(-np.clip(np.random.default_rng(k & (2**63 - 1)).beta(a, b, samples), 1e-12, 1) / SOFTMIN_T)

        columns = ["chain_id", "efficacy", "low", "high"]
        for pdf in batches:
            for c, k, a, b in pdf[["chain_id", "k", "alpha", "beta"]].itertuples(index=False):
                if c != chain:
                    close()
                    chain, total, n = c, np.zeros(samples), 0
                total += drawn(int(k), a, b)
                n += 1
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    return x.mapInPandas(draw, "chain_id long, efficacy double, low double, high double")


def planted(spark, chains: int, edges: int, per_chain: int, seed: int = 0) -> DataFrame:
    """Synthetic chains: an edge works with a rate that its number tells, a chain succeeds if all its edges do."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            rows = []
            for i in b["id"]:
                g = np.random.default_rng([seed, int(i)])
                for_chain = g.choice(edges, per_chain, replace=False)
                ok = g.random(per_chain) < 0.5 + 0.5 * ((for_chain * 37) % edges) / edges
                rows += [(int(i), int(e), float(ok.all())) for e in for_chain]
            yield pd.DataFrame(rows, columns=["chain_id", "edge", "y"])

    return spark.range(chains).mapInPandas(run, "chain_id long, edge long, y double")


def recover(rows: DataFrame, rounds: int = 10) -> DataFrame:
    """Edge rates of a noisy-and model by expectation maximisation; ``rows`` has ``chain_id, edge, y``.

    In a failed chain an edge still worked with probability (r - M) / (1 - M), M the
    product of the chain's rates; each round is two aggregations.
    """
    from credograph.session import cut

    rates = rows.groupBy("edge").agg(F.lit(0.75).alias("r"))
    for _ in range(rounds):
        x = rows.join(rates, "edge")
        m = x.groupBy("chain_id").agg(F.exp(F.sum(F.log("r"))).alias("m"))
        worked = F.when(F.col("y") == 1, 1.0).otherwise((F.col("r") - F.col("m")) / F.greatest(1 - F.col("m"), F.lit(1e-9)))
        rates = cut(x.join(m, "chain_id").groupBy("edge").agg(F.least(F.greatest(F.avg(worked), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("r")))
    return rates
