"""Accounting over an append-only folder of JSON events, as Structured Streaming with state for each attempt.

The state of an attempt is one row of numbers, a count for each name of a tool, an
error class, a stop reason or a currency, and the ids of its requests; ids are
forgotten ``TTL_MS`` after they came, which bounds the state of a long attempt (a
request that is repeated later than that counts again).  Events carry no event
time, so there is no watermark; events of a batch are taken in order of their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from spanlake.operators import accounting as A

TTL_MS = 7 * 24 * 3600 * 1000
SUMS = ["events", "unattributed", "calls", "ok", "failed", "errors", "retries", "tools", "bytes", "turns", "duplicates", "bad", "latency_n", "priced", "unpriced"]
FLOATS = ["latency", "latency_max", "cost", *A.TOKENS]
NUMBERS = ", ".join([*(f"{x} long" for x in SUMS), *(f"{x} double" for x in FLOATS), "names string"])
REPORT = (
    "attempt long, events long, unattributed long, model_calls long, calls_ok long, calls_error long, errors long, retries long, " + ", ".join(f"{x}_tokens double" for x in A.TOKENS)
    + ", latency_total double, latency_max double, latency_n long, cost double, currency string, calls_with_cost long, calls_without_cost long, tool_calls long, delivered_bytes long, turns long, "
    "stop_reason string, duplicates long, violations long, tools string, error_classes string, stop_reasons string"
)


def text(x) -> str:
    """A text of a pandas frame, empty if there is none."""
    return x if isinstance(x, str) else ""


def number(x) -> float | None:
    return None if x is None or x != x else float(x)


class Accounting(StatefulProcessor):
    """One row of counters for an attempt after each batch that has events of it."""

    def init(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", NUMBERS)
        self.requests = handle.getMapState("requests", "id string", "event_id long", ttlDurationMs=TTL_MS)

    def handleInputRows(self, key, rows, timerValues):
        import json

        import pandas as pd

        held = self.numbers.get() if self.numbers.exists() else None
        n = dict(zip([*SUMS, *FLOATS], held, strict=False)) if held else {x: 0 for x in SUMS} | {x: None for x in FLOATS}
        names = {(f, x): (c, a, b) for f, x, c, a, b in json.loads(held[-1])} if held else {}
        add = lambda field, x: n.update({field: x + (n[field] or 0)})

        def name(facet, value, at):
            c, first, last = names.get((facet, value), (0, at, at))
            names[facet, value] = (c + 1, int(min(first, at)), int(max(last, at)))

        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            reserved, impersonated = r.kind in A.RESERVED_KINDS, r.tool in A.RESERVED_TOOLS
            if r.source == "shim":
                continue
            if reserved or impersonated:
                n["bad"] += 1
                continue
            n["events"] += 1
            n["unattributed"] += r.source != "executor"
            if r.kind == "model_call":
                if text(r.request_id).strip():
                    if self.requests.containsKey((r.request_id,)):
                        n["duplicates"] += 1
                        continue
                    self.requests.updateValue((r.request_id,), (int(r.event_id),))
                n["calls"] += 1
                n["failed" if r.status == "error" else "ok"] += 1
                if r.status == "error":
                    name("error", text(r.error_class) or "unclassed", r.event_id)
                for field in A.TOKENS:
                    if (x := number(getattr(r, field))) is not None:
                        add(field, x)
                if (x := number(r.latency_ms)) is not None:
                    add("latency", x)
                    n["latency_max"] = max(x, n["latency_max"] or x)
                    n["latency_n"] += 1
                if (x := number(r.amount)) is not None:
                    add("cost", x)
                    n["priced"] += 1
                    if text(r.currency).strip():
                        name("currency", r.currency, r.event_id)
                else:
                    n["unpriced"] += 1
            elif r.kind == "tool_call":
                n["tools"] += 1
                name("tool", text(r.tool) or "unnamed", r.event_id)
                n["bytes"] += int(number(r.stdout_bytes) or 0)
            elif r.kind in ("turn", "retry", "error"):
                n[{"turn": "turns", "retry": "retries", "error": "errors"}[r.kind]] += 1
                if r.kind == "error":
                    name("error", text(r.error_class) or "unclassed", r.event_id)
            elif r.kind == "stop":
                if text(r.reason).strip():
                    name("stop", r.reason, r.event_id)
            else:
                n["bad"] += 1
        self.numbers.update((*(int(n[x]) for x in SUMS), *(n[x] for x in FLOATS), json.dumps([[*k, *v] for k, v in names.items()])))
        yield pd.DataFrame([self.report(int(key[0]), n, names)], columns=[c.strip().split(" ")[0] for c in REPORT.split(",")])

    @staticmethod
    def report(attempt: int, n: dict, names: dict) -> tuple:
        of = lambda facet: {k[1]: v for k, v in names.items() if k[0] == facet}
        listed = lambda facet: ",".join(sorted(f"{k}={v[0]}" for k, v in of(facet).items()))
        money, stops = of("currency"), of("stop")
        first = min(money, key=lambda k: money[k][1], default=None)
        mixed = sum(v[0] for v in money.values()) - (money[first][0] if money else 0)
        seen = lambda x: x if n["calls"] else None
        return (
            attempt, n["events"], n["unattributed"], seen(n["calls"]), seen(n["ok"]), seen(n["failed"]), seen(n["errors"] + n["failed"]), seen(n["retries"]), *(n[x] for x in A.TOKENS),
            None if n["latency"] is None else round(n["latency"] + 1e-9, 1), n["latency_max"], n["latency_n"] or None, None if n["cost"] is None else round(n["cost"], 8), first if n["priced"] else None, n["priced"] or None,
            n["unpriced"] if n["priced"] else None, n["tools"] if n["events"] else None, n["bytes"] if n["tools"] else None, n["turns"] if n["turns"] or n["calls"] else None,
            max(stops, key=lambda k: stops[k][2], default=None), n["duplicates"], n["bad"] + mixed, listed("tool"), seen(listed("error")), listed("stop") if stops else None,
        )

    def close(self) -> None:
        pass


class Ceilings(StatefulProcessor):
    """One stop row for an attempt, at the event that first exceeds a ceiling; the state is four numbers."""

    def __init__(self, wall_s: float, tool_calls: int, turns: int):
        self.limits = (wall_s, tool_calls, turns)

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "first double, calls long, turns long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        wall_s, tool_calls, turns = self.limits
        first, calls, turn, stopped = self.run.get() if self.run.exists() else (None, 0, 0, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("event_id").itertuples():
            if stopped:
                break
            first = r.seconds if first is None else min(first, r.seconds)
            calls += r.kind == "tool_call"
            turn += r.kind == "turn"
            reason = "wall_s" if r.seconds - first > wall_s else "tool_calls" if calls > tool_calls else "turns" if turn > turns else None
            if reason:
                stopped = True
                out.append((int(key[0]), r.event_id, reason))
        self.run.update((first, int(calls), int(turn), bool(stopped)))
        yield pd.DataFrame(out, columns=["attempt", "event_id", "reason"])

    def close(self) -> None:
        pass


def with_state(spark: SparkSession) -> None:
    """Maps and expiry need the state store that keeps its state outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def accounted(stream: DataFrame) -> DataFrame:
    """The totals of each attempt that has new events."""
    with_state(stream.sparkSession)
    flat = stream.select("attempt", "event_id", "source", "kind", "tool", "request_id", "status", "error_class", "reason", "latency_ms", "stdout_bytes", "tokens.*", "cost.*")
    return flat.groupBy("attempt").transformWithStateInPandas(statefulProcessor=Accounting(), outputStructType=REPORT, outputMode="Update", timeMode="ProcessingTime")


def ceilings(stream: DataFrame, wall_s: float, tool_calls: int, turns: int) -> DataFrame:
    """(attempt, event_id, reason) of each attempt that exceeds a ceiling, once."""
    with_state(stream.sparkSession)
    return stream.select("attempt", "event_id", "seconds", "kind").groupBy("attempt").transformWithStateInPandas(statefulProcessor=Ceilings(wall_s, tool_calls, turns), outputStructType="attempt long, event_id long, reason string", outputMode="Append", timeMode="None")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder of JSON lines that grows by files; malformed lines (an incomplete last one too) are left out."""
    return spark.readStream.schema(A.EVENT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", str(files_per_batch)).json(folder)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there; each batch adds a folder of the rows it changed.

    State that expires asks for one batch after another for ever, so all that is
    there is taken as one batch; a lasting query has the usual trigger instead.
    """
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    query = stream.writeStream.outputMode(mode).trigger(once=True).option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last row written for each attempt."""
    from pyspark.sql import functions as F

    rows = spark.read.option("basePath", out).parquet(out)
    cols = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("attempt").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")
