"""Traces of answered prompts: cost, roll-ups by model and tier, histograms, quantiles of buckets, evaluation."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text

# Price of a thousand input and output tokens by model.
PRICES: dict[str, tuple[float, float]] = {
    "ollama/gemma4": (0.0, 0.0), "ollama/gemma4:latest": (0.0, 0.0), "ollama/gemma2": (0.0, 0.0), "sentence-transformers/all-MiniLM-L6-v2": (0.0, 0.0),
    "gemini-2.0-flash": (0.00010, 0.00040), "claude-3-5-sonnet": (0.00300, 0.01500), "gpt-4o-mini": (0.00015, 0.00060),
}
#: Models by this prefix cost what the caller configures, listed or not.
CONFIGURED = "moonshot/"
# Upper edges of the histograms of tools, whole answers and tiers, in milliseconds.
TOOL_EDGES = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 30000.0)
TOTAL_EDGES = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)
TIER_EDGES = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0)
#: The edge that stands for no bound.
UNBOUNDED = 1e9
TRACE = "trace_id string, prompt string, model string, prompt_tokens bigint, completion_tokens bigint, total_ms double, tiers map<string,double>"


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column, configured: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Price of a call as an exact decimal of six digits, halves up; unknown models cost nothing."""
    exact = lambda x: F.lit(str(x)).cast("decimal(12,8)")
    table = F.array(*[F.struct(F.lit(m).alias("m"), exact(a).alias("r0"), exact(b).alias("r1")) for m, (a, b) in PRICES.items()])
    rate = lambda k: F.when(model.startswith(CONFIGURED), exact(configured[k])).otherwise(F.coalesce(F.get(F.transform(F.filter(table, lambda x: x["m"] == model), lambda x: x[f"r{k}"]), F.lit(0)), exact(0)))
    part = lambda tokens, k: tokens.cast("decimal(12,0)") * rate(k)
    return F.round((part(prompt_tokens, 0) + part(completion_tokens, 1)) * F.lit("0.001").cast("decimal(4,3)"), 6).cast("decimal(18,6)")


@dataclass
class Trace:
    """One answered prompt: started, its tiers recorded, and finalised into a row and into spans."""

    prompt: str
    model: str = "ollama/gemma4"
    trace_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    began: float = field(default_factory=time.perf_counter)
    started: float = field(default_factory=time.time)
    tiers: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    backend: dict[str, str] = field(default_factory=dict)
    spans: list[tuple] = field(default_factory=list)
    shown: str | None = None  # the prompt as it's kept: without personal data

    def record(self, tier: str, milliseconds: float, error: str | None = None) -> None:
        """A tier that has just ended after so many milliseconds, and why it failed, if it did."""
        self.tiers[tier] = float(milliseconds)
        if error:
            self.errors[tier] = error
        end = (time.perf_counter() - self.began) * 1000
        self.spans.append((self.trace_id, uuid.uuid4().hex[:16], self.trace_id[:16], tier, max(0.0, end - milliseconds), float(milliseconds), "ERROR" if error else "OK"))

    def finalise(self, response: str) -> tuple:
        tokens = lambda s: 0 if not s else max(1, len(s) // 4)
        kept = self.prompt if self.shown is None else self.shown
        total = (time.perf_counter() - self.began) * 1000
        self.spans.append((self.trace_id, self.trace_id[:16], None, "answer", 0.0, total, "OK"))
        return self.trace_id, kept if len(kept) <= 100 else kept[:100] + "...", self.model, tokens(self.prompt), tokens(response), total, self.tiers


SPAN = "trace_id string, span_id string, parent_id string, name string, start_ms double, ms double, status string"


def span_rows(spark: SparkSession, traces: list[Trace]) -> DataFrame:
    """A row for each span of finalised traces: the answer's, and under it one for each tier; start_ms counts from the trace's start."""
    return spark.createDataFrame([s for t in traces for s in t.spans], SPAN)


def write_spans(spans: DataFrame, folder: str) -> None:
    """Append spans to a table; one that can't be written is no reason to lose the answer, so callers may ignore what this raises."""
    spans.write.mode("append").parquet(folder)


def slow_tiers(spans: DataFrame, threshold_ms: float) -> DataFrame:
    """(name, n, n_failed, p95_ms) of the tiers whose 95th percentile, linear between ranks, is over a threshold."""
    each = spans.where("parent_id is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ERROR").alias("n_failed"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"))
    return each.where(F.col("p95_ms") > threshold_ms)


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, TRACE)


def rollup(traces: DataFrame, by: str = "model", configured: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(by, n_traces, prompt_tokens, completion_tokens, cost_usd, mean_ms): sums are exact, whatever the order of rows."""
    price = cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), configured)
    sums = traces.groupBy(by).agg(F.count(F.lit(1)).alias("n_traces"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(price).cast("double").alias("cost_usd"), F.sum(F.col("total_ms").cast("decimal(18,4)")).cast("double").alias("ms"))
    return sums.withColumn("mean_ms", F.col("ms") / F.col("n_traces")).drop("ms")


def tier_means(traces: DataFrame) -> DataFrame:
    """(tier, n, mean_ms) over the traces that went through each tier."""
    each = traces.select(F.explode("tiers").alias("tier", "ms"))
    return each.groupBy("tier").agg(F.count("ms").alias("n"), (F.sum(F.col("ms").cast("decimal(18,4)")).cast("double") / F.count("ms")).alias("mean_ms"))


def last(traces: DataFrame, time_col: str, n: int = 5) -> DataFrame:
    return traces.orderBy(F.col(time_col).desc_nulls_last(), "trace_id").limit(n)


def histogram(df: DataFrame, value: str, edges: tuple[float, ...], by: str) -> DataFrame:
    """(by, le, n): how many values are at most each edge, and all of them at UNBOUNDED; one pass for all edges."""
    counted = df.groupBy(by).agg(*[F.count_if(F.col(value) <= e).alias(f"e{i}") for i, e in enumerate(edges)], F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"e{i}").alias("n")) for i, e in enumerate(edges)], F.struct(F.lit(UNBOUNDED).alias("le"), F.col("all").alias("n")))
    return counted.select(by, F.inline(rows))


def bucket_quantile(counts: DataFrame, q: float, by: str) -> DataFrame:
    """(by, quantile) from histogram(): linear within the bucket that holds the rank; beyond the last edge, that edge."""
    one = counts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))  # a row for each edge
    one = one.withColumn("rank", F.lit(q) * F.element_at("b", -1)["n"])
    one = one.withColumn("i", F.size(F.filter("b", lambda x: x["n"] < F.col("rank"))))
    low = F.when(F.col("i") > 0, F.get("b", F.col("i") - 1))
    le, n = F.get("b", F.col("i"))["le"], F.get("b", F.col("i"))["n"]
    below, start = F.coalesce(low["n"], F.lit(0)), F.coalesce(low["le"], F.lit(0.0))
    inside = F.when(n == below, le).otherwise(start + (le - start) * (F.col("rank") - below) / (n - below))
    return one.select(by, F.when(F.element_at("b", -1)["n"] == 0, F.lit(None)).when(le >= UNBOUNDED, start).otherwise(inside).alias("quantile"))


def evaluation(results: DataFrame, score: str = "score", passing: float = 80.0, by: str | None = None, latency: str | None = None) -> DataFrame:
    """(by, n, n_passed, pass_rate, mean_score, mean_ms): scores of 0 to 100; null scores count as tried, not passed, and not in the mean.

    mean_ms, of the column latency, is there where that is named.
    """
    exact = F.sum(F.col(score).cast("decimal(18,6)")).cast("double")
    timed = [(F.sum(F.col(latency).cast("decimal(18,4)")).cast("double") / F.count(latency)).alias("mean_ms")] if latency else []
    out = results.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= passing).alias("n_passed"), (exact / F.when(F.count(score) > 0, F.count(score))).alias("mean_score"), *timed)
    return out.withColumn("pass_rate", 100.0 * F.col("n_passed") / F.col("n"))


def judged(prompt: Column, context: Column, response: Column) -> Column:
    """struct(context_relevance, faithfulness, answer_relevance, composite); an empty response scores nothing."""
    empty = F.length(F.trim(F.coalesce(response, F.lit("")))) == 0
    asked = text.keywords(prompt)
    parts = [text.coverage(asked, text.keywords(context)), text.faithfulness(context, response), text.coverage(asked, text.keywords(response))]
    a, b, c = (F.when(empty, 0.0).otherwise(p) for p in parts)
    return F.struct(a.alias("context_relevance"), b.alias("faithfulness"), c.alias("answer_relevance"), text.composite(a, b, c).alias("composite"))
