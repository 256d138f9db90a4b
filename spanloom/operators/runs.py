"""Runs of units over a ledger: what is current, what is left to do, caps, approvals and stop rules. Driver-side, a row a unit."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.sinks import append_ledger, read_ledger


class CapReached(RuntimeError):
    pass


def payload(ledger: DataFrame, *fields: str) -> DataFrame:
    return ledger.select("ts", "revision", "version", *[F.get_json_object("payload", f"$.{f}").alias(f) for f in fields])


def verified(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions (system, weights_sha, ..) whose model hash is the manifest's."""
    return predictions.join(manifest.select("system", "weights_sha"), ["system", "weights_sha"], "left_semi")


def current(ledger: DataFrame, version: str, key: str) -> DataFrame:
    """(unit): units done under this version with this key of inputs, and as many rows as they said."""
    p = payload(ledger, "unit", "status", "key", "rows", "expected").where((F.col("version") == version) & (F.col("key") == key))
    return p.where((F.col("status") == "done") & (F.col("rows").isNull() | F.col("rows").eqNullSafe(F.col("expected")))).select("unit").distinct()


def hours(ledger: DataFrame) -> DataFrame:
    """(stage, hours), failed units too."""
    return payload(ledger, "stage", "hours").where("hours is not null").groupBy("stage").agg(F.sum(F.col("hours").cast("double")).alias("hours"))


def archive_name(taken: set[str], name: str) -> str:
    """A name that nothing has yet."""
    n = 1
    while f"{name}.{n}" in taken:
        n += 1
    return f"{name}.{n}"


def run_states(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(run, state, archive) of runs (run, hashes map<string, string>, done, present) against expected (run, name, value).

    new: nothing is there. reuse: done, and its manifest has every expected hash. resume: the hashes agree, but it isn't
    done. archive: what is there has other hashes, or no manifest; archive then is the name to move it to: the run's with
    .stale- and the first 12 characters of its questions hash (nohash), and -1, -2, .. if another run has that name.
    """
    want = expected.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_want"))
    d = runs.join(want, "run", "left")
    same = F.coalesce(F.forall(F.map_entries(F.coalesce("_want", F.create_map().cast("map<string,string>"))), lambda e: F.element_at("hashes", e["key"]).eqNullSafe(e["value"])), F.lit(True)) & F.col("hashes").isNotNull()
    state = F.when(~F.col("present"), "new").when(same & F.col("done"), "reuse").when(same, "resume").otherwise("archive")
    tag = F.substring(F.coalesce(F.element_at("hashes", "questions"), F.lit("nohash")), 1, 12)
    d = d.withColumn("state", state).withColumn("_base", F.when(F.col("state") == "archive", F.concat("run", F.lit(".stale-"), tag)))
    # names that are taken are runs themselves; the first free number is among as many as there are names, and one more
    taken = runs.select(F.col("run").alias("_taken"))
    near = d.where("_base is not null").select("run", "_base").join(taken, F.col("_taken").startswith(F.col("_base"))).groupBy("run").agg(F.collect_set("_taken").alias("_names"))
    d = d.join(near, "run", "left")
    free = F.filter(F.transform(F.sequence(F.lit(0), F.size(F.coalesce("_names", F.array().cast("array<string>")))), lambda n: F.when(n == 0, F.col("_base")).otherwise(F.concat("_base", F.lit("-"), n))), lambda x: ~F.array_contains(F.coalesce("_names", F.array().cast("array<string>")), x))
    return d.select("run", "state", F.when(F.col("_base").isNotNull(), F.get(free, F.lit(0))).alias("archive"))


def run_units(spark: SparkSession, path: str, stage: str, units: dict[str, Callable[[], int]], key: str, version: str, cap_hours: float, stop: Callable[[], bool] = lambda: False) -> list[str]:
    """Runs the units that aren't current, in order; returns those it ran.

    Before each the cap is checked and the control asked. Time counts whether a unit succeeds or fails; only success is
    marked done, so a run that broke off goes on where it stopped.
    """
    try:
        led = read_ledger(spark, path)
        have = {r.unit for r in current(led, version, key).collect()}
        spent = sum(r.hours for r in hours(led).where(F.col("stage") == stage).collect())
    except Exception as e:  # noqa: BLE001  no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have, spent = set(), 0.0
    ran = []
    for name, f in units.items():
        if name in have or stop():
            continue
        if spent >= cap_hours:
            raise CapReached(f"{stage}: {spent:.3f} of {cap_hours} hours used before {name}")
        t, row = time.monotonic(), {"unit": name, "stage": stage, "key": key, "status": "failed"}
        try:
            n = f()
            row |= {"status": "done", "rows": n, "expected": n}
            ran.append(name)
        finally:
            row["hours"] = (time.monotonic() - t) / 3600
            spent += row["hours"]
            append_ledger(spark, path, row)
    return ran


def may_run(stage: str, order: list[str], approvals: set[str], results: dict[str, dict], chance: float) -> tuple[bool, str]:
    """Whether a stage may run: those before it have results, it is approved, and no stop rule holds."""
    for s in order[:order.index(stage)]:
        if s not in results:
            return False, f"{s} has no result"
        if results[s].get("partial"):
            return False, f"{s} is partial"
    if stage not in approvals:
        return False, f"{stage} is not approved"
    base = [r["accuracy"] for r in results.values() if r.get("kind") == "baseline"]
    if base and all(a < 2 * chance for a in base):
        return False, "all baselines are under twice chance"
    trained, prompted = ([r["accuracy"] for r in results.values() if r.get("kind") == k] for k in ("trained", "prompted"))
    if trained and prompted and max(trained) < max(prompted):
        return False, "training is below prompting"
    return True, ""
