"""Online estimates and state machines, as aggregations where order does not matter and ordered folds where it does.

A fold sorts one key's outcomes and steps through them inside the JVM; its
streaming form in ``sightline.streaming`` keeps the same state between batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(rows: DataFrame, by: Sequence[str], seq: str, *values: Column | str) -> DataFrame:
    """(by..., s): the group's values in order of ``seq``."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_seq"), *values))).alias("s"))


def adaptive_blend(outcomes: DataFrame, kind: str = "query_class", won: str = "quality_won", prior: tuple[float, float] = (7.0, 3.0), default: float = 0.7, least: int = 50) -> DataFrame:
    """(kind, alpha): mean of a Beta posterior per class, of all classes where one has too few outcomes, else the default."""
    a, b = prior
    mean = lambda wins, n: (a + wins) / (a + b + n)
    per = outcomes.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(won)).alias("w"))
    all_n, all_w = F.sum("n").over(Window.partitionBy()), F.sum("w").over(Window.partitionBy())  # a row a class
    alpha = F.when(F.col("n") >= least, mean(F.col("w"), F.col("n"))).when(all_n >= least, mean(all_w, all_n)).otherwise(F.lit(default))
    return per.select(kind, F.least(F.greatest(alpha, F.lit(0.1)), F.lit(0.95)).alias("alpha"))


def blend_state(outcomes: DataFrame, before: DataFrame | None = None, kind: str = "query_class", won: str = "quality_won") -> DataFrame:
    """(kind, n, w): outcomes and wins of each class so far, to be stored; adds to the state ``before``, whatever the order of batches."""
    new = outcomes.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col(won)).alias("w"))
    return new if before is None else before.select(kind, "n", "w").unionByName(new).groupBy(kind).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def blend_evidence(state: DataFrame, kind: str = "query_class", prior: tuple[float, float] = (7.0, 3.0), least: int = 50) -> DataFrame:
    """(kind, n, w, a, b, mean, warm): the posterior a state stands for, and whether its class decides for itself yet."""
    a, b = prior
    return state.select(kind, "n", "w", (F.lit(a) + F.col("w")).alias("a"), (F.lit(b) + F.col("n") - F.col("w")).alias("b"), ((a + F.col("w")) / (a + b + F.col("n"))).alias("mean"), (F.col("n") >= least).alias("warm"))


def adaptive_k(observations: DataFrame, value: str = "k", by: Sequence[str] = (), mean: float = 60.0, variance: float = 100.0, noise: float = 225.0) -> DataFrame:
    """(by..., k): mean of a normal posterior, held to [1, 200]."""
    agg = observations.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    post = (mean / variance + F.col("s") / noise) / (1 / variance + F.col("n") / noise)
    return agg.select(*by, F.least(F.greatest(post, F.lit(1.0)), F.lit(200.0)).alias("k"))


def phase_gate(observations: DataFrame, by: Sequence[str], seq: str, factor: str, alpha: float = 0.05, timeout: int = 500) -> DataFrame:
    """(by..., decision, at): an e-value product; >= 1/alpha refine always, <= alpha skip, after ``timeout`` the majority.

    Factors are held to [0.01, 100]; the first crossing decides and nothing later matters.
    """
    held = F.least(F.greatest(F.col(factor).cast("double"), F.lit(0.01)), F.lit(100.0))
    w = Window.partitionBy(*by).orderBy(seq)
    rows = observations.withColumn("_n", F.row_number().over(w)).withColumn("_e", F.sum(F.ln(held)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_up", F.avg((held > 1).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    import math

    edge = math.log(1 / alpha) - 1e-12
    decision = F.when(F.col("_e") >= edge, "always_refine").when(F.col("_e") <= -edge, "skip_quality").when(F.col("_n") >= timeout, F.when(F.col("_up") >= 0.5, "always_refine").otherwise("skip_quality"))
    first = rows.withColumn("_d", decision).groupBy(*by).agg(F.min(F.when(F.col("_d").isNotNull(), F.struct("_n", "_d"))).alias("f"))
    return first.select(*by, F.coalesce("f._d", F.lit("undecided")).alias("decision"), F.col("f._n").alias("at"))


def circuit_breaker(outcomes: DataFrame, by: Sequence[str], seq: str, ok: str, at_ms: str, failures: int = 5, probe_ms: int = 30_000, successes: int = 3) -> DataFrame:
    """(by..., state, skipped): closed, open after ``failures`` in a row, half open ``probe_ms`` later, closed after ``successes``.

    Outcomes that fall while it is open are skipped.
    """
    lists = _ordered(outcomes, by, seq, F.col(ok).alias("ok"), F.col(at_ms).alias("ms"))
    make = lambda state, bad, good, since, skipped: F.struct(state.alias("state"), bad.alias("bad"), good.alias("good"), since.cast("bigint").alias("since"), skipped.alias("skipped"))
    zero = F.lit(0)

    def step(a: Column, x: Column) -> Column:
        state = F.when((a["state"] == "open") & (x["ms"] - a["since"] >= probe_ms), "half_open").otherwise(a["state"])
        bad, good = a["bad"] + 1, a["good"] + 1
        closed = F.when(x["ok"], make(F.lit("closed"), zero, zero, a["since"], a["skipped"])).when(bad >= failures, make(F.lit("open"), zero, zero, x["ms"], a["skipped"])).otherwise(make(F.lit("closed"), bad, zero, a["since"], a["skipped"]))
        half = F.when(~x["ok"], make(F.lit("open"), zero, zero, x["ms"], a["skipped"])).when(good >= successes, make(F.lit("closed"), zero, zero, a["since"], a["skipped"])).otherwise(make(F.lit("half_open"), zero, good, a["since"], a["skipped"]))
        return F.when(state == "closed", closed).when(state == "half_open", half).otherwise(make(F.lit("open"), a["bad"], a["good"], a["since"], a["skipped"] + 1))

    start = make(F.lit("closed"), zero, zero, zero, zero)
    return lists.select(*by, F.aggregate("s", start, step).alias("f")).select(*by, "f.state", "f.skipped")


def ewma(rows: DataFrame, by: Sequence[str], seq: str, value: str, alpha: float = 0.3) -> DataFrame:
    """(by..., ewma): exponentially weighted mean; the first value starts it, a non-finite alpha is 0.3."""
    import math

    a = alpha if math.isfinite(alpha) and 0 < alpha <= 1 else 0.3
    lists = _ordered(rows.where(F.col(value).isNotNull()), by, seq, F.col(value).cast("double").alias("v"))
    return lists.select(*by, F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.element_at("s", 1)["v"], lambda e, x: a * x["v"] + (1 - a) * e).alias("ewma"))


# Smoothed scores from which each pressure state holds, by profile.
PRESSURE = """
profile      constrained  degraded  emergency
strict       60           75        90
performance  70           85        95
degraded     80           90        98
"""
STATES = ["normal", "constrained", "degraded", "emergency"]

# Readings in a row that make the mode worse, and better, by profile.
CONFIRMATIONS = """
profile      worse  better
strict       1      3
performance  2      3
degraded     2      5
"""
MODES = ["normal", "embed_deferred", "lexical_only", "metadata_only", "paused"]

# The mode aimed at, by pressure state and by what else is wrong.
TARGETS = """
state        none            circuit_open    high_watermark  saturated
normal       normal          embed_deferred  embed_deferred  lexical_only
constrained  embed_deferred  lexical_only    embed_deferred  lexical_only
degraded     lexical_only    metadata_only   lexical_only    metadata_only
emergency    metadata_only   metadata_only   metadata_only   paused
"""


def _rows_of(text: str) -> dict[str, dict[str, str]]:
    head, *lines = [line.split() for line in text.strip().split("\n")]
    return {line[0]: dict(zip(head[1:], line[1:])) for line in lines}


def _confirmed(held: Column, wanted: Column, needed: Column) -> Column:
    """The next (at, pending, run) of a machine that moves to ``wanted`` once it was wanted ``needed`` times in a row."""
    run = F.when(held["pending"] == wanted, held["run"] + 1).otherwise(F.lit(1))

    def state(at: Column, pending: Column, n: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), pending.cast("int").alias("pending"), n.cast("int").alias("run"))

    still = state(held["at"], F.lit(-1), F.lit(0))
    return F.when(wanted == held["at"], still).when(run >= needed, state(wanted, F.lit(-1), F.lit(0))).otherwise(state(held["at"], wanted, run))


def pressure_states(rows: DataFrame, by: Sequence[str], seq: str, score: str, profile: str = "performance", alpha: float = 0.3, hysteresis: float = 5.0, needed: int = 3) -> DataFrame:
    """(by..., state): the pressure state after all readings (0 to 100), from normal.

    Readings are smoothed. A smoothed score asks for a worse state by its threshold, for a better one
    only once it is ``hysteresis`` below; a state is taken once it was asked for ``needed`` times in a row. Null readings are none.
    """
    lists = _ordered(rows.where(F.col(score).isNotNull()), by, seq, F.col(score).cast("double").alias("v"))
    limits = [float(x) for x in _rows_of(PRESSURE)[profile].values()]

    def state(e: Column, margin: float) -> Column:
        out = F.lit(0)
        for n, limit in enumerate(limits, 1):
            out = F.when(e >= max(0.0, limit - margin), n).otherwise(out)
        return out

    def step(a: Column, x: Column) -> Column:
        e = F.when(a["e"].isNull(), x["v"]).otherwise(alpha * x["v"] + (1 - alpha) * a["e"])
        up = state(e, 0.0)
        wanted = F.when(up > a["m"]["at"], up).when(up < a["m"]["at"], state(e, hysteresis)).otherwise(a["m"]["at"])
        return F.struct(e.alias("e"), _confirmed(a["m"], wanted, F.lit(needed)).alias("m"))

    start = F.struct(F.lit(None).cast("double").alias("e"), F.struct(F.lit(0).alias("at"), F.lit(-1).alias("pending"), F.lit(0).alias("run")).alias("m"))
    names = F.array(*[F.lit(n) for n in STATES])
    return lists.select(*by, F.element_at(names, F.aggregate("s", start, step)["m"]["at"] + 1).alias("state"))


def degradation(rows: DataFrame, by: Sequence[str], seq: str, state: str, backpressure: str | None = None, circuit_open: str | None = None, profile: str = "performance", override: str | None = None) -> DataFrame:
    """(by..., mode): the mode after all signals, from normal, one step at a time.

    Signals: the pressure ``state``; ``backpressure`` (saturated, high_watermark or other); whether the quality
    circuit is open. They aim at a mode; the mode moves one step towards it once that was so for
    as many signals in a row as the profile asks, more to get better than to get worse. ``override`` forces a mode.
    Unknown and null states count as normal.
    """
    lists = _ordered(rows, by, seq, F.col(state).alias("state"), (F.col(backpressure) if backpressure else F.lit("normal")).alias("back"), F.coalesce(F.col(circuit_open) if circuit_open else F.lit(False), F.lit(False)).alias("open"))
    policy, targets = _rows_of(CONFIRMATIONS)[profile], _rows_of(TARGETS)

    def aim(x: Column) -> Column:
        def of(name: str) -> Column:
            row = {k: F.lit(MODES.index(v)) for k, v in targets[name].items()}
            return F.when(x["back"] == "saturated", row["saturated"]).when(x["open"], row["circuit_open"]).when(x["back"] == "high_watermark", row["high_watermark"]).otherwise(row["none"])

        out = of("normal")
        for name in STATES[1:]:
            out = F.when(x["state"] == name, of(name)).otherwise(out)
        return out

    def step(a: Column, x: Column) -> Column:
        wanted = a["at"] + F.signum(aim(x) - a["at"]).cast("int")
        return _confirmed(a, wanted, F.when(wanted > a["at"], int(policy["worse"])).otherwise(int(policy["better"])))

    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("pending"), F.lit(0).alias("run"))
    mode = F.element_at(F.array(*[F.lit(n) for n in MODES]), F.aggregate("s", start, step)["at"] + 1)
    return lists.select(*by, (F.lit(override) if override else mode).alias("mode"))


def calibration_guard(rows: DataFrame, by: Sequence[str], seq: str, error: str, limit: float, least: int = 30, breaches: int = 3) -> DataFrame:
    """(by..., state): watching until ``least`` samples, fallback after ``breaches`` errors over ``limit`` in a row, else trusted."""
    lists = _ordered(rows, by, seq, F.col(error).cast("double").alias("e"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(False).alias("fell"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        run = F.when((n > least) & (x["e"] > limit), a["run"] + 1).otherwise(F.lit(0))
        return F.struct(n.alias("n"), run.alias("run"), (a["fell"] | (run >= breaches)).alias("fell"))

    out = F.aggregate("s", start, step)
    return lists.select(*by, out.alias("f")).select(*by, F.when(F.col("f.fell"), "fallback").when(F.col("f.n") < least, "watching").otherwise("trusted").alias("state"))


def typing_plan(keystrokes: DataFrame, session: str = "session", ts: str = "ts_ms", query: str = "query", pause_ms: int = 300) -> DataFrame:
    """Adds action (skip / lexical_prefix / lexical_hash / hybrid_fast), reuse of the pool when the query extends the last, refine after a pause."""
    w = Window.partitionBy(session).orderBy(ts)
    n = F.length(F.trim(query))
    action = F.when(n < 2, "skip").when(n == 2, "lexical_prefix").when(n <= 4, "lexical_hash").otherwise("hybrid_fast")
    last, following = F.lag(query).over(w), F.lead(ts).over(w)
    reuse = F.coalesce(F.startswith(F.col(query), last) & (F.length(last) >= 2), F.lit(False))
    return keystrokes.withColumn("action", action).withColumn("reuse", reuse).withColumn("refine", (n >= 2) & F.coalesce(following - F.col(ts) >= pause_ms, F.lit(True)))


def least_expected_loss(rows: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Adds ``action``: of the columns loss_<action> the least; uncalibrated rows fall back to the first."""
    least = F.least(*[F.col(f"loss_{a}") for a in actions])
    pick = F.coalesce(*[F.when(F.col(f"loss_{a}") == least, F.lit(a)) for a in actions])
    return rows.withColumn("action", F.when(F.col("calibrated"), pick).otherwise(F.lit(actions[0])))
