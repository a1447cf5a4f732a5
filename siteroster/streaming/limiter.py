"""Online admission of requests: blocks, page budget and spacing per domain, and the end of the session."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siteroster.functions.fixed_values import MANUAL_BLOCK
from siteroster.operators.budgets import Limits

DECISIONS = "event_id long, ts timestamp, domain string, allowed boolean, reason string"
_STATE = "pages long, failures long, last_micros long, block string"


def _domain_budget(limits: Limits) -> StatefulProcessor:
    """Processor of one domain; its state is four values that only admitted requests and blocks by hand change."""
    # Plain values in a local class travel to the workers as they are, without this package there.
    state_schema, by_hand = _STATE, MANUAL_BLOCK
    max_failures, max_pages = limits.max_retry_attempts, limits.max_pages_per_domain
    delay = round(limits.min_request_delay_seconds * 1e6)

    class DomainBudget(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._state = handle.getValueState("budget", state_schema)

        def handleInputRows(self, key, rows, timerValues):
            # One micro-batch of one domain; its size is set by the source's rate options.
            batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            pages, failures, last, block = self._state.get() if self._state.exists() else (0, 0, -1, "")
            micros = batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            kinds, reason = batch["kind"].to_numpy(), np.full(len(batch), None, object)
            switches = np.flatnonzero(np.isin(kinds, ("block", "unblock")))
            i = 0
            while i < len(kinds):
                if block or pages >= max_pages or last >= 0 and micros[i] - last < delay:
                    # refusals change nothing: all rows up to the next that may change it are answered at once
                    after = np.searchsorted(switches, i)
                    end = switches[after] + 1 if after < len(switches) else len(kinds)
                    if block:
                        reason[i:end] = f"Domain blocked: {block}"
                    elif pages >= max_pages:
                        reason[i:end] = f"Domain page limit reached ({max_pages} pages)"
                    else:
                        end = min(end, max(i + 1, int(np.searchsorted(micros, last + delay))))
                        reason[i:end] = [f"Rate limit: wait {(last + delay - m) / 1e6:.1f}s" for m in micros[i:end]]
                else:
                    end = i + 1
                    if kinds[i] in ("start", "success", "failure"):
                        last, pages, failures = int(micros[i]), pages + (kinds[i] == "success"), failures + (kinds[i] == "failure")
                        if kinds[i] == "failure" and failures >= max_failures:
                            block = f"Too many failures ({failures})"
                if kinds[end - 1] in ("block", "unblock"):
                    block = by_hand if kinds[end - 1] == "block" else ""
                i = end
            self._state.update((int(pages), int(failures), int(last), block))
            yield pd.DataFrame({"event_id": batch["event_id"], "ts": batch["ts"], "domain": key[0], "allowed": pd.isna(reason), "reason": reason})

        def close(self) -> None:
            pass

    return DomainBudget()


def stream_limiter(log: DataFrame, limits: Limits = Limits(), watermark: str = "10 minutes", started: datetime | None = None) -> DataFrame:
    """Admit or deny each logged row in event order; ``log`` streams event_id, ts, domain, kind.

    A denied request leaves no trace, so unlike the audit it does not use up the budget of later
    ones, and neither does one that was refused before (``blocked``). ``block`` and ``unblock`` switch a domain by hand; after an
    ``unblock`` the next failure at or over the limit blocks it again. With ``started`` the session ends after its
    minutes; rows after that are denied without a look at any state. The number of pages of the whole session needs one order
    over all domains and is left to ``budget_check``. Needs the RocksDB state store. Events behind the
    watermark are dropped. One domain is one task, but only rows that change its state cost a step.
    """
    events = (log.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "domain", "kind")
              .withWatermark("ts", watermark))
    over = None
    if started is not None:
        end = F.lit(started).cast("timestamp") + F.expr(f"INTERVAL {int(limits.max_execution_time_minutes)} MINUTES")
        reason = F.lit(f"Execution time limit reached ({limits.max_execution_time_minutes} minutes)")
        over = events.filter(F.col("ts") >= end).select("event_id", "ts", "domain", F.lit(False).alias("allowed"), reason.alias("reason"))
        events = events.filter(F.col("ts") < end)
    decided = events.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=_domain_budget(limits), outputStructType=DECISIONS, outputMode="Append", timeMode="None")
    return decided if over is None else decided.unionByName(over)
