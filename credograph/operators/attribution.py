"""Outcome attribution: failure routing, credit and blame along chains, arms and adverse events.

Within an epoch every trial reads the beliefs as they stood at its start, which makes the
order-dependent updates one aggregation; ``attribute_epochs`` applies epochs one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credograph.functions.belief import exact
from credograph.session import cut, release

# Routing branch of each failure mode; multiple_factors and any other mode are unknown.
BRANCHES = {
    "efficacy": ["no_target_engagement", "target_engaged_biology_not_moved"],
    "measurement": ["biology_moved_endpoint_flat", "wrong_timeframe", "high_placebo_response", "wrong_population", "efficacy_in_subgroup_only"],
    "safety": ["dose_limiting_toxicity"],
    "operational": ["underpowered", "manufacturing_or_delivery", "commercial_not_scientific", "insufficient_information"],
}
# Words of a stop reason; the first list that has one decides.
STOP_WORDS = {
    "veto": ["futility", "futile", "efficac", "did not meet", "lack of response", "no benefit", "ineffective", "primary endpoint", "interim analysis", "insufficient response", "negative result"],
    "operational": ["accrual", "enroll", "enrol", "recruit", "fund", "financ", "budget", "sponsor", "business", "commercial", "strateg", "portfolio", "prioriti", "supply", "manufactur", "administrativ", "merger", "reorganiz", "company", "discontinu", "logistic", "feasib", "covid", "pandemic"],
    "safety": ["toxic", "adverse event", "tolerab", "unacceptable risk", "safety signal", "serious adverse"],
}
STOPPED = ["TERMINATED", "WITHDRAWN", "SUSPENDED"]
# Observed probability of each outcome.
P_OUTCOME = {"success": 0.80, "partial": 0.35, "failure": 0.20}


def branch_of(mode: Column, own: dict[str, str] | None = None) -> Column:
    """The branch of a failure mode; ``own``: branches of modes that a collection has besides the fixed ones."""
    every = {m: b for b, modes in BRANCHES.items() for m in modes} | (own or {})
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in every.items() for x in kv]), mode), F.lit("unknown"))


def stop_override(status: Column, reason: Column) -> Column:
    """``operational``, ``safety`` or null (none, or efficacy, which can't be overridden)."""
    r = F.lower(reason)  # matched as parts of words

    def any_of(words: list[str]) -> Column:
        c = F.lit(False)
        for w in words:
            c = c | r.contains(w)
        return c

    live = F.upper(status).isin(STOPPED) & ~any_of(STOP_WORDS["veto"])
    return F.when(live & any_of(STOP_WORDS["operational"]), "operational").when(live & any_of(STOP_WORDS["safety"]), "safety")


def success_updates(edges: DataFrame) -> DataFrame:
    """Every edge of a successful chain takes the whole weight; once for each edge and chain."""
    return edges.where("outcome = 'success'").select("src", "dst", "edge_type", F.col("w").alias("n"), F.lit(P_OUTCOME["success"]).alias("p"))


def explain_away(edges: DataFrame, keys: tuple[str, ...] = ("chain_id",)) -> DataFrame:
    """Blame of chains (named by ``keys``) that failed for unknown reasons, split by what each edge lacks; ``r`` is its belief."""
    w = Window.partitionBy(*keys)
    lack = F.sum(1 - F.col("r")).over(w)
    share = F.when(lack > 0, (1 - F.col("r")) / lack).otherwise(1 / F.count("*").over(w))
    x = edges.where("branch = 'unknown' and outcome in ('failure', 'partial')")
    return x.withColumns({"share": share, "p": F.when(F.col("outcome") == "failure", P_OUTCOME["failure"]).otherwise(P_OUTCOME["partial"])})


def responsibility(edges: DataFrame, keys: tuple[str, ...] = ("chain_id",)) -> DataFrame:
    """Chains that failed on efficacy or measurement: p = (r - M) / (1 - M), M the chain's product; each takes the whole weight."""
    w = Window.partitionBy(*keys)
    m = F.exp(F.sum(F.log(F.greatest(F.col("r"), F.lit(1e-12)))).over(w))
    x = edges.where("branch in ('efficacy', 'measurement') and outcome in ('failure', 'partial')").withColumn("m", m).where("1 - m >= 1e-6")
    return x.withColumn("p", F.least(F.greatest((F.col("r") - F.col("m")) / (1 - F.col("m")), F.lit(0.0)), F.lit(1.0)))


def attribute_epochs(edges: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``src, dst, edge_type, alpha, beta, n_records``: successes and routed failures attributed epoch by epoch.

    ``edges`` has the edge, ``chain_id, outcome, branch, w`` and the epoch. An epoch's failures
    read what all epochs before have left and the epoch's own successes; epochs are few (years),
    each is one aggregation, and what they leave is written, so a lost executor costs one epoch.
    """
    key = ["src", "dst", "edge_type"]
    held = cut(edges)
    state = None
    sums = lambda x: x.groupBy(*key).agg(F.sum(exact(F.col("n") * F.col("p"))).alias("up"), F.sum(exact(F.col("n") * (1 - F.col("p")))).alias("down"), F.count("*").alias("n"))
    add = lambda a, b: b if a is None else a.unionByName(b).groupBy(*key).agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.sum("n").alias("n"))
    for row in held.select(epoch).distinct().orderBy(epoch).collect():
        now = held.where(F.col(epoch).eqNullSafe(F.lit(row[epoch])))
        good = add(state, sums(success_updates(now)))
        r = good.select(*key, ((1 + F.col("up").cast("double")) / (2 + (F.col("up") + F.col("down")).cast("double"))).alias("b"))
        e = cut(now.join(r, key, "left").withColumn("r", F.coalesce("b", F.lit(0.5))).drop("b"))
        blame = explain_away(e).select(*key, (F.col("w") * F.col("share")).alias("n"), "p")
        own = responsibility(e).select(*key, F.col("w").alias("n"), "p")
        before, state = state, cut(add(good, sums(blame.unionByName(own))))
        release(*([e] if before is None else [e, before]))
    if state is None:
        return held.select(*key, F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta"), F.lit(0).cast("long").alias("n_records"))
    return state.select(*key, (1 + F.col("up").cast("double")).alias("alpha"), (1 + F.col("down").cast("double")).alias("beta"), F.col("n").alias("n_records"))


def subset_pairs(arms: DataFrame) -> DataFrame:
    """Arms of one trial whose compounds are a strict subset of another's; ``gain`` is the outcome's change of grade."""
    # joined on the smaller arm's first compound, so arms without a common compound never meet
    a, b = arms.withColumn("key", F.col("compounds")[0]).alias("a"), arms.withColumn("key", F.explode("compounds")).alias("b")
    strict = (F.size("a.compounds") < F.size("b.compounds")) & (F.size(F.array_except("a.compounds", "b.compounds")) == 0)
    x = a.join(b, (F.col("a.trial_id") == F.col("b.trial_id")) & (F.col("a.key") == F.col("b.key"))).where(strict)
    gain = F.col("b.grade") - F.col("a.grade")
    bucket = F.when(gain >= 2, "strong_support").when(gain == 1, "moderate_support").when(gain == 0, "ambiguous").when(gain == -1, "moderate_contradict").otherwise("strong_contradict")
    return x.select(F.col("a.trial_id").alias("trial_id"), F.col("a.arm_id").alias("base_arm"), F.col("b.arm_id").alias("combo_arm"), F.array_join(F.array_except("b.compounds", "a.compounds"), "+").alias("added"), bucket.alias("bucket"))


def ae_bucket(treated: Column, control: Column, n: Column) -> Column:
    """Bucket of an adverse event from its rates in per cent and the arm's size."""
    c = F.coalesce(control, F.lit(0.0))
    delta, rr = treated - c, treated / F.greatest(c, F.lit(0.5))
    k = F.bround(treated * n / 100, 0)
    kc = F.bround(c * n / 100, 0)
    down = F.when((delta >= 20) | (rr >= 3), "strong_support").when((delta >= 10) | (rr >= 2), "moderate_support").when((delta >= 5) | (rr >= 1.5), "weak_support").when(delta <= -5, "weak_contradict").otherwise("ambiguous")
    gated = (
        F.when(treated.isNull(), "ambiguous")
        .when(n.isNull(), down)
        .when(down.isin("strong_support", "moderate_support"), F.when(k >= 5, down).when(k >= 3, "weak_support").otherwise("ambiguous"))
        .when(down == "weak_support", F.when(k >= 3, down).otherwise("ambiguous"))
        .when(down == "weak_contradict", F.when(kc >= 3, down).otherwise("ambiguous"))
    )
    return gated.otherwise(down)


def hazard_bucket(hr: Column, low: Column, high: Column) -> Column:
    """Bucket of a hazard ratio with its interval; an interval over 1 or none says nothing."""
    vague = low.isNull() | high.isNull() | ((low <= 1) & (high >= 1))
    c = F.when(hr.isNull(), F.lit(None).cast("string")).when(vague, "ambiguous")
    return c.when(hr >= 1.5, "strong_support").when(hr >= 1.25, "moderate_support").when(hr >= 1, "weak_support").when(hr <= 0.67, "strong_contradict").when(hr <= 0.80, "moderate_contradict").otherwise("weak_contradict")


def class_votes(p: Column) -> Column:
    """A sibling compound's vote on an adverse event of its target."""
    return F.when(p >= 0.75, "strong_support").when(p >= 0.55, "moderate_support").when(p >= 0.40, "weak_support").when(p <= 0.25, "weak_contradict").otherwise("ambiguous")
