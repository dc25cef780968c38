"""Verification of references, symbols and requests: each check is kept, null where it doesn't apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text as T

#: Closed vocabularies of requests.
INTENTS = ["explain", "edit", "test"]
POLICIES = ["LEX", "CTX"]
EVIDENCE = ["context", "references", "tests"]


def request_violations() -> Column:
    """Codes of what is wrong with a request; empty if nothing is.

    Columns: schema_version, intent, policy, budget_tokens, query, evidence_wanted, reserve_pct.
    """
    search = F.coalesce(F.col("evidence_wanted").isin("references", "tests"), F.lit(False))
    checks = [
        F.when(F.col("schema_version") != 1, "schema_version"),
        F.when(~F.col("intent").isin(INTENTS), "intent"),
        F.when(~F.col("policy").isin(POLICIES), "policy"),
        F.when(F.col("budget_tokens") <= 0, "budget_tokens"),
        F.when(~F.col("evidence_wanted").isin(EVIDENCE), "evidence_wanted"),
        F.when(F.col("reserve_pct") > 100, "reserve_range").when((F.col("reserve_pct") > 0) & ~search, "reserve_needs_search"),
        F.when(F.size(T.tokens(F.col("query"))) == 0, "no_terms"),
    ]
    return F.array_compact(F.array(*checks))


def response_state(stale: Column, omitted: Column, truncated: Column) -> Column:
    """stale before partial before ok."""
    return F.when(stale, "stale").when((omitted > 0) | truncated, "partial").otherwise("ok")


def verify_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, each check, the reasons of failing ones and the verdict.

    ``refs``: ref_id, file, line, end_line, hash (null: not given); ``files``:
    path, current_hash (null: not on disk), index_hash, n_lines.
    """
    j = refs.join(files, refs["file"] == files["path"], "left")
    exists = F.col("current_hash").isNotNull()
    checks = {
        "inside_root": T.path_safe(F.col("file")),
        "exists": exists,
        "registered": F.col("index_hash").isNotNull(),
        "matches_index": F.when(exists & F.col("index_hash").isNotNull(), F.col("current_hash") == F.col("index_hash")),
        "matches_given": F.when(exists & F.col("hash").isNotNull(), F.col("current_hash") == F.lower("hash")),
        "in_range": F.when(exists, (F.col("line") >= 1) & (F.col("end_line") >= F.col("line")) & (F.col("end_line") <= F.col("n_lines"))),
    }
    out = j.select("ref_id", *[c.alias(n) for n, c in checks.items()])
    reasons = F.array_compact(F.array(*[F.when(~F.col(n), n) for n in checks]))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("verified", F.col("reasons") == "")


def verify_symbols(symbols: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """name, file, line and the first check that fails (or ``ok``): exists, hash, range, name on its line.

    ``files``: file, current_hash, n_lines; ``lines``: file, line, text.
    """
    j = symbols.join(files, "file", "left").join(lines.select("file", "line", F.col("text").alias("_t")), ["file", "line"], "left")
    state = (
        F.when(F.col("current_hash").isNull(), "missing_file").when(F.col("current_hash") != F.col("content_hash"), "hash_changed")
        .when(F.col("line") > F.col("n_lines"), "line_out_of_range").when(~F.contains(F.col("_t"), F.col("name")), "name_not_on_line").otherwise("ok")
    )
    return j.select("name", "file", "line", state.alias("state"))


#: Fields of a result document.
IDENTITY = ["provider", "id", "version"]
USAGE = ["model_calls", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "tool_calls_declared", "turns"]
COVERAGE = ["model_identity", "tokens", "cost", "tool_calls", "turns"]
RESULT = "executor-result/1"


def result_violations(v: Column) -> Column:
    """Codes of what is wrong with a result document, a column of parsed JSON (null: unreadable); empty if nothing is.

    Types count: a number as text is no number, and a blank text is none.
    """
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))
    text = lambda path: (kind(path) == "STRING") & (F.length(F.trim(F.try_variant_get(v, path, "string"))) > 0)
    number = lambda path: kind(path).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    low = lambda path: ~number(path) | (F.try_variant_get(v, path, "double") < 0)
    there = lambda path: ~kind(path).isin("ABSENT", "VOID")
    is_object = lambda path: kind(path).startswith("OBJECT")
    missing = F.array_join(F.array_compact(F.array(*[F.when(~text(f"$.model.{f}"), f) for f in IDENTITY])), ",")
    checks = [
        F.when(~text("$.schema") | (F.try_variant_get(v, "$.schema", "string") != RESULT), "schema"),
        F.when(~is_object("$.model"), "model_missing").when(missing != "", F.concat(F.lit("model:"), missing)), F.when(is_object("$.model") & ~text("$.model.verified_by"), "model_unverified"),
        F.when(~is_object("$.usage"), "usage_missing"), *[F.when(is_object("$.usage") & there(f"$.usage.{f}") & low(f"$.usage.{f}"), f"usage:{f}") for f in USAGE],
        F.when(there("$.cost") & ~is_object("$.cost"), "cost_no_object"), F.when(is_object("$.cost") & low("$.cost.provider_billed"), "cost:provider_billed"), *[F.when(is_object("$.cost") & ~text(f"$.cost.{f}"), f"cost:{f}") for f in ("currency", "source")],
        F.when(~text("$.stop.reason"), "stop"), F.when(~is_object("$.coverage"), "coverage_missing"),
    ]
    for m in COVERAGE:
        at = f"$.coverage.{m}"
        unseen = (kind(f"{at}.observed") == "BOOLEAN") & ~F.coalesce(F.try_variant_get(v, f"{at}.observed", "boolean"), F.lit(True))
        checks.append(F.when(is_object("$.coverage"), F.when(~is_object(at), f"coverage:{m}").when(kind(f"{at}.observed") == "ABSENT", f"coverage_unobserved:{m}").when(unseen & ~text(f"{at}.reason"), f"coverage_unexplained:{m}")))
    return F.when(v.isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.array(*checks)))
