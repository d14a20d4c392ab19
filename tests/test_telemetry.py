import math
import random

import pytest

from sightline.operators import telemetry as M
from sightline.plans import telemetry_queries as Q


def chain(n, order, at=""):
    return [(f"s{at}{order[i]:04d}", f"k{at}{j}") for i in range(n) for j in (i, i + 1)]


@pytest.mark.parametrize("kind", ["random", "falling"])
def test_long_chains_are_one_instance(spark, kind):
    order = list(range(300))[::-1]
    if kind == "random":
        random.Random(1).shuffle(order)
    links = chain(300, order) + chain(3, [2, 0, 1], "x") + [("alone", None)]
    df = spark.createDataFrame(links * 2, "sighting string, key string")
    got = [tuple(r) for r in M.reconcile_instances(df).collect()]
    assert len(got) == len(set(got)) == 304
    assert {b for a, b in got if a[:2] != "sx" and a != "alone"} == {"s0000"}
    assert {b for a, b in got if a[:2] == "sx"} == {"sx0000"} and ("alone", "alone") in got
    with pytest.raises(RuntimeError):
        M.reconcile_instances(df, rounds=1)


COLUMNS = "event_id string, project_key string, instance_id string, phase string, latency_us bigint, result_count bigint, memory_bytes bigint, ts_ms bigint"


def days_of_events(spark, tmp_path):
    """Two projects over four days; failing searches carry no latency; p's last day fails often, q's is slow."""
    rng, rows = random.Random(2), []
    for day in range(4):
        for project in "pq":
            for n in range(40):
                failed = n < (24 if (day, project) == (3, "p") else 4)
                latency = rng.choice([None, 0, -1]) if failed else rng.randrange(100_000, 140_000) * (4 if (day, project) == (3, "q") else 1)
                rows.append((f"e{len(rows)}", project, "i", rng.choice(["Refinement_Failed ", "refinement_failed"]) if failed else rng.choice(["initial", None]), latency, n, 1, day * M.DAY + n))
    spark.createDataFrame(rows + rows[::7], COLUMNS).write.parquet(f"{tmp_path}/search_events.parquet")
    return rows


def cells(rows):
    """Events by scope, project and day."""
    out = {}
    for r in rows:
        for key in (("project", r[1]), ("fleet", None)):
            out.setdefault((*key, r[7] // M.DAY * M.DAY), []).append(r)
    return out


def nearest(values, p):
    return sorted(values)[math.ceil(p * len(values)) - 1]


def test_failures_count_without_a_latency(spark, tmp_path):
    rows = days_of_events(spark, tmp_path)
    rates = {k: sum("fail" in (r[3] or "").lower() for r in rs) / len(rs) for k, rs in cells(rows).items()}
    got = {(r.scope, r.project_key, r.window_start): (r.total, r.error_rate) for r in Q.tele_slo(spark, str(tmp_path)).collect()}
    assert got == {k: (len(rs), pytest.approx(rates[k])) for k, rs in cells(rows).items()}
    found = {(r.scope, r.project_key, r.window_start) for r in Q.tele_anomalies(spark, str(tmp_path)).where("observed > 0").collect()}
    assert ("project", "p", 3 * M.DAY) in found
    for r in Q.tele_summaries(spark, str(tmp_path)).where("window = '24h'").collect():
        mine = cells(rows)["project", r.project_key, r.window_start]
        assert (r.events, r.avg_results) == (40, 19.5) and r.p95_us == nearest([x[4] for x in mine if (x[4] or 0) > 0], 0.95)


def test_latency_counts_in_health_and_anomalies(spark, tmp_path):
    by = cells(days_of_events(spark, tmp_path))
    p95 = {k: nearest([x[4] for x in rs if (x[4] or 0) > 0], 0.95) for k, rs in by.items()}
    got = {(r.scope, r.project_key, r.window_start): r for r in Q.tele_slo(spark, str(tmp_path)).collect()}
    assert {k: (r.p95_us, r.latency_ratio) for k, r in got.items()} == {k: (v, pytest.approx(v / 150_000)) for k, v in p95.items()}
    slow = got["project", "q", 3 * M.DAY]
    assert (slow.failed, slow.health) == (4, "critical") and slow.latency_ratio >= 2
    found = {(r.scope, r.project_key, r.window_start): r.observed for r in Q.tele_anomalies(spark, str(tmp_path)).where("metric = 'p95_latency'").collect()}
    want = {k: v for k, v in p95.items() if (earlier := [p95[o] for o in p95 if o[:2] == k[:2] and o[2] < k[2]]) and v >= 2 * sum(earlier) / len(earlier)}
    assert found == want and ("project", "q", 3 * M.DAY) in want
