"""Beta-belief algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Observed probability of each support bucket.
P_OBS = {
    "strong_support": 0.95,
    "moderate_support": 0.80,
    "weak_support": 0.65,
    "ambiguous": 0.50,
    "weak_contradict": 0.35,
    "moderate_contradict": 0.20,
    "strong_contradict": 0.05,
}
# Effective sample size of each kind of evidence.
N_EFF = {
    "clinical_phase3": 15.0,
    "clinical_phase2": 6.0,
    "clinical_phase1": 2.0,
    "genetic_mr": 10.0,
    "genetic_gwas": 4.0,
    "preclinical_in_vivo": 2.0,
    "preclinical_in_vitro": 1.0,
    "database_ot_direct": 12.0,
    "database_chembl": 10.0,
    "database_mab_table": 10.0,
    "database_llm_inference": 3.0,
    "database_ot_association": 2.0,
    "database_endpoint_prior": 2.0,
    "database_reactome_go": 1.5,
    "database_lincs": 1.0,
    "database_indication_taxonomy": 1.0,
    "database_fallback": 0.5,
    "database_cross_reference": 0.3,
    "computational": 0.3,
    "literature": 0.2,
}
REFERENCE_N = 350.0
POOL_STRENGTH = 20.0
SOFTMIN_T = 0.1


def lookup(values: dict[str, float], key: Column) -> Column:
    """A fixed table as a map literal; null for what it lacks."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def precision(n_obs: Column, reference: float = REFERENCE_N) -> Column:
    """Square root of the sample against the reference, within 0.5 and 2.5; 1 without a sample."""
    return F.when(n_obs > 0, F.greatest(F.least(F.sqrt(n_obs / reference), F.lit(2.5)), F.lit(0.5))).otherwise(F.lit(1.0))


def exact(c: Column) -> Column:
    """Six decimals, so that sums don't depend on their order."""
    return F.round(c, 6).cast("decimal(18,6)")


def expected(a: Column, b: Column) -> Column:
    return F.round(a / (a + b), 6)


def strength(a: Column, b: Column) -> Column:
    return F.round(a + b - 2, 6)


def variance(a: Column, b: Column) -> Column:
    return F.round(a * b / ((a + b) * (a + b) * (a + b + 1)), 6)


def conflict(a: Column, b: Column) -> Column:
    s = a + b - 2
    return F.when(s <= 0, F.lit(0.0)).otherwise(F.round(s * (1 - 2 * F.abs(a / (a + b) - 0.5)), 6))


def trust(s: Column) -> Column:
    """How far an edge of this strength is trusted: 1 from 49 on."""
    return F.least(F.lit(1.0), F.log(F.greatest(s, F.lit(0.0)) + 1) / F.log(F.lit(50.0)))


def softmin(p: Column, t: float = SOFTMIN_T) -> Column:
    """Aggregate: close to the least of the probabilities, never below it nor above their mean."""
    return -t * F.log(F.avg(F.exp(-F.greatest(p, F.lit(1e-12)) / t)))


def capped(x: Column, a: Column, b: Column, most: float = POOL_STRENGTH) -> Column:
    """``x`` (a or b) scaled so that a+b is at most ``most``; the mean stays."""
    return x * F.least(F.lit(1.0), F.lit(most) / (a + b))


def pooled(levels: list[tuple[Column, Column]], most: float = POOL_STRENGTH) -> tuple[Column, Column]:
    """Belief over levels, the most general first: each caps what came before and adds its own mass.

    A null level is left out; without any level the belief is (1, 1).
    """
    a, b = F.lit(1.0), F.lit(1.0)
    seen: Column = F.lit(False)
    for x, y in levels:
        there = x.isNotNull()
        a, b = (
            F.when(~there, a).when(~seen, x).otherwise(capped(a, a, b, most) + F.greatest(x - 1, F.lit(0.0))),
            F.when(~there, b).when(~seen, y).otherwise(capped(b, a, b, most) + F.greatest(y - 1, F.lit(0.0))),
        )
        seen = seen | there
    return a, b


def flipped(bucket: Column) -> Column:
    """The bucket of the opposite direction; ambiguous stays."""
    b = F.regexp_replace(bucket, "support$", "#")
    return F.regexp_replace(F.regexp_replace(b, "contradict$", "support"), "#$", "contradict")


def modulation_bucket(direction: Column, confidence: Column) -> Column:
    """Amplifying supports and suppressing contradicts, by confidence; anything else is ambiguous."""
    side = F.when(direction == "amplifies", "support").when(direction == "suppresses", "contradict")
    grade = F.when(confidence >= 0.85, "strong").when(confidence >= 0.70, "moderate").when(confidence >= 0.55, "weak")
    return F.coalesce(F.concat(grade, F.lit("_"), side), F.lit("ambiguous"))
