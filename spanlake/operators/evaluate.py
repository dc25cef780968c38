"""Evaluation rules: mechanical checks, adjudication that fails closed, gates, success tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabularies.
CATEGORIES = ["local_bug", "cross_file", "api_tests", "configuration"]
SPLITS = ["smoke", "pilot", "holdout"]
PATCH_FAULTS = ["patch_regression", "apply_failed", "empty_patch"]
ENVIRONMENTAL = ["env_blocked", "acceptance_timeout", "deps_missing", "no_base", "acceptance_error"]
ENV_EXIT = 3


def task_violations(tasks: DataFrame) -> DataFrame:
    """id and what is wrong with each task: its vocabulary, its fields, a repeated id."""
    n = tasks.groupBy("id").agg(F.count("*").alias("_n"))
    checks = F.array_compact(F.array(
        F.when(~F.col("split").isin(SPLITS), "split"), F.when(~F.col("category").isin(CATEGORIES), "category"), F.when(F.coalesce(F.length("statement"), F.lit(0)) == 0, "statement"),
        F.when(F.coalesce(F.size("allowed_paths"), F.lit(0)) <= 0, "allowed_paths"), F.when(F.col("_n") > 1, "duplicate_id"),
    ))
    return tasks.join(n, "id").select("id", "row", F.array_join(checks, ",").alias("violations"))


def failure_class(state: Column, applied: Column, exit_code: Column) -> Column:
    ok = F.coalesce(applied, F.lit(False)) & F.coalesce(exit_code == 0, F.lit(False))
    return (
        F.when(state == "passed", F.lit(None).cast("string")).when(state.isin(PATCH_FAULTS), "patch_fault").when(state.isin(ENVIRONMENTAL), "environmental")
        .when(state.isNull(), F.when(~ok, "patch_fault")).otherwise("patch_fault")
    )


def mechanical_check(attempts: DataFrame) -> DataFrame:
    """attempt_id, failure_class, failed items M1..M6 and the verdict.

    Columns: attempt_id, state, applied, exit_code, patch_bytes, out_of_scope
    (number of paths), immutable_touched, stopped.  A failure that only the
    environment explains is undetermined, never accepted.
    """
    applied, code = F.coalesce("applied", F.lit(False)), F.coalesce(F.col("exit_code") == 0, F.lit(False))
    items = F.array_compact(F.array(
        F.when(~applied, "M1"), F.when(~(applied & code), "M2"), F.when(F.coalesce("patch_bytes", F.lit(0)) == 0, "M3"),
        F.when(F.col("out_of_scope") > 0, "M4"), F.when(F.col("immutable_touched") > 0, "M5"), F.when(F.coalesce("stopped", F.lit(False)), "M6"),
    ))
    out = attempts.select("attempt_id", failure_class(F.col("state"), F.col("applied"), F.col("exit_code")).alias("failure_class"), items.alias("_i"))
    blocked = (F.col("failure_class") == "environmental") & (F.size(F.array_except("_i", F.array(F.lit("M1"), F.lit("M2")))) == 0)
    verdict = F.when(F.size("_i") == 0, "accepted").when(F.coalesce(blocked, F.lit(False)), "undetermined").otherwise("rejected")
    return out.select("attempt_id", "failure_class", F.array_join("_i", ",").alias("failed_items"), verdict.alias("verdict"))


def adjudicate(items: DataFrame) -> DataFrame:
    """item_id, status, state.  Everything that isn't clearly decided is undetermined.

    Columns: item_id, mechanical, scored, first_kind, first_verdict,
    second_verdict, adjudication, sampled.
    """
    first, second = F.col("first_verdict"), F.col("second_verdict")
    needs = first.isin("rejected", "undetermined") | F.col("sampled")
    differs = F.coalesce(second != first, F.lit(False))
    rules = [
        (~F.col("scored"), "no_score", F.lit("undetermined")),
        (F.col("mechanical") == "rejected", "mechanical_fail", F.lit("rejected")),
        (F.col("first_kind") != "human", "llm_triage", F.lit("undetermined")),
        (needs & second.isNull(), "second_reviewer_missing", F.lit("undetermined")),
        (first == "undetermined", "reviewer_undetermined", F.lit("undetermined")),
        (differs & F.col("adjudication").isNotNull(), "adjudicated", F.col("adjudication")),
        (differs, "disputed", F.lit("undetermined")),
    ]
    status, state = F.lit("judged"), first
    for when, name, what in reversed(rules):
        status, state = F.when(when, name).otherwise(status), F.when(when, what).otherwise(state)
    return items.select("item_id", status.alias("status"), state.alias("state"))


def gate_merge(gates: DataFrame) -> DataFrame:
    """id, final, failure_class, reason: a public and a private gate; a green public gate alone never accepts."""
    rules = []
    for side in ("public", "private"):
        c = lambda n, side=side: F.col(f"{side}_{n}")
        if side == "public":
            rules.append((c("empty"), "rejected", "patch_fault", "public_empty"))
        else:
            rules.append((~F.col("has_private"), "undetermined", "environmental", "private_missing"))
        rules += [(c("timeout"), "undetermined", "environmental", f"{side}_timeout"), (c("error").isNotNull(), "undetermined", "environmental", f"{side}_error"),
                  (c("exit_code") == ENV_EXIT, "undetermined", "environmental", f"{side}_environment"), (F.coalesce(c("exit_code") != 0, F.lit(True)), "rejected", "patch_fault", f"{side}_failed")]
    out = F.struct(F.lit("accepted").alias("final"), F.lit(None).cast("string").alias("failure_class"), F.lit("green").alias("reason"))
    for when, final, fault, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(final).alias("final"), F.lit(fault).alias("failure_class"), F.lit(reason).alias("reason"))).otherwise(out)
    return gates.select("id", out.alias("o")).select("id", "o.*")


def success_table(attempts: DataFrame) -> DataFrame:
    """Per condition: attempts, accepted, rates per attempt and per task, states, and cost per success.

    Columns: condition, task, accepted, state, cost.  Tasks are pre-aggregated;
    the cost is null, with a reason, if any attempt's cost is unknown or nothing
    was accepted.
    """
    task = attempts.groupBy("condition", "task").agg(
        F.count("*").alias("n"), F.count_if("accepted").alias("ok"), F.bool_or("accepted").alias("solved"), F.sum(F.col("cost").cast("decimal(20,2)")).alias("cost"), F.count_if(F.col("cost").isNull()).alias("free")
    )
    t = task.groupBy("condition").agg(F.sum("n").alias("attempts"), F.sum("ok").alias("accepted"), F.count("*").alias("tasks"), F.count_if("solved").alias("tasks_solved"), F.sum("cost").alias("_c"), F.sum("free").alias("_f"))
    states = attempts.groupBy("condition", "state").agg(F.count("*").alias("n")).groupBy("condition").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "state", F.col("n").cast("string")))), ",").alias("states"))
    known = (F.col("_f") == 0) & (F.col("accepted") > 0)
    return t.join(states, "condition").select(
        "condition", "attempts", "accepted", "tasks", "tasks_solved", F.round(F.col("accepted") / F.col("attempts"), 6).alias("rate_attempt"), F.round(F.col("tasks_solved") / F.col("tasks"), 6).alias("rate_task"), "states",
        F.when(known, F.round((F.col("_c") / F.col("accepted")).cast("double"), 4)).alias("cost_per_success"), F.when(F.col("_f") > 0, "cost_unknown").when(F.col("accepted") == 0, "no_success").alias("cost_reason"),
    )


def blinding(guesses: DataFrame, n_conditions: int) -> DataFrame:
    """One row: guesses of the condition, correct ones, accuracy and what chance gives."""
    g = guesses.where("guess is not null")
    return g.agg(F.count("*").alias("guesses"), F.count_if(F.col("guess") == F.col("condition")).alias("correct")).select(
        "guesses", "correct", F.round(F.col("correct") / F.nullif(F.col("guesses"), F.lit(0)), 6).alias("accuracy"), F.round(F.lit(1.0 / n_conditions), 6).alias("base_rate"))


def unblind(bundle: DataFrame, key: DataFrame, scores: DataFrame, by: str = "item_id") -> DataFrame:
    """Items of the bundle with what the key tells and their score, null where there is none.

    ``by`` identifies an item in all three; opaque ids of ten digits repeat among some
    hundred thousand items, so these need their own key.
    """
    return bundle.join(key, by, "left").join(scores, by, "left")
