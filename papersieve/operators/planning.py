"""Planning and judging second opinions: gate volume, sampling, paired results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import ratio
from papersieve.operators.evaluate import confusion_counts, per_value
from papersieve.operators.gate import replays_gate
from papersieve.operators.ordered import first_failing_run

QUARANTINE = K.MALICIOUS_AT


def call_cost(calls: Column) -> Column:
    per_call = (
        K.PLAN_TOKENS_IN / 1_000_000 * K.USD_PER_MILLION_IN
        + K.PLAN_TOKENS_OUT / 1_000_000 * K.USD_PER_MILLION_OUT
    )
    return calls * F.lit(per_call)


def gate_volume(results: DataFrame, low: int = K.GATE_MIN, high: int = K.GATE_MAX) -> DataFrame:
    """How many documents the gate would send, per label, and the cost of all."""
    sent = (F.col("score") >= low) & (F.col("score") < high)
    counted = results.agg(
        F.count_if(sent & (F.col("label") == "clean")).alias("clean_calls"),
        F.count_if(sent & (F.col("label") == "malware")).alias("malware_calls"),
    )
    total = F.col("clean_calls") + F.col("malware_calls")
    return counted.withColumn("calls", total).withColumn("cost_usd", call_cost(total))


def quarantined_false_positives(results: DataFrame, high: int = K.GATE_MAX) -> DataFrame:
    fp = (F.col("label") == "clean") & (F.col("score") >= QUARANTINE)
    return results.agg(
        F.count_if(fp).alias("false_positives"),
        F.count_if(fp & (F.col("score") < high)).alias("visible"),
        F.count_if(fp & (F.col("score") >= high)).alias("invisible"),
    )


def thin_evidence(
    results: DataFrame, limits: Sequence[int] = K.THIN_LIMITS, high: int = K.GATE_MAX
) -> DataFrame:
    fp = (F.col("label") == "clean") & (F.col("score") >= QUARANTINE)
    bad = (F.col("label") == "malware") & (F.col("score") >= high)
    counted = per_value(
        results, limits, "max_indicators",
        lambda n: {
            "fps_reached": F.count_if(fp & (F.col("n_indicators") <= n)),
            "extra_malware_calls": F.count_if(bad & (F.col("n_indicators") <= n)),
        },
    )
    return counted.withColumn(
        "cost_usd", call_cost(F.col("fps_reached") + F.col("extra_malware_calls"))
    )


def indicator_histogram(results: DataFrame) -> DataFrame:
    """Indicators per document at quarantine level, false beside true positives."""
    high = results.where(F.col("score") >= QUARANTINE)
    return high.groupBy("n_indicators").agg(
        F.count_if(F.col("label") == "clean").alias("false_positives"),
        F.count_if(F.col("label") == "malware").alias("true_positives"),
    )


def _bucket_tests() -> list[Column]:
    clean, bad = F.col("label") == "clean", F.col("label") == "malware"
    score = F.col("score")
    return [
        clean & (score >= QUARANTINE),
        bad & (score >= QUARANTINE) & (F.col("n_indicators") <= 3),
        bad & (score >= 90),
        bad & (score >= QUARANTINE) & (score < 90),
        bad & (score >= 50) & (score < QUARANTINE),
        clean & (score >= 20) & (score < QUARANTINE),
    ]


def draw_key(seed: int) -> Column:
    """Reproducible shuffle key of a row within a seed."""
    return F.md5(F.concat(F.col("path"), F.lit(f"|{seed}")))


def stratified_sample(results: DataFrame, max_calls: int = 150, seed: int = 20260803) -> DataFrame:
    """Reserved shares per bucket, then leftovers given to buckets in order.

    A row may sit in two buckets. Only the first ``max_calls`` rows of a bucket
    in draw order can ever be chosen, so the rank filter keeps that many; Spark
    applies it before the shuffle, and a bucket with most rows stays cheap. The
    second pass then works on at most six times ``max_calls`` rows.
    """
    shares = [s for _, s in K.SAMPLE_SHARES]
    quotas = [max(1, round(max_calls * s)) for s in shares]
    member = F.filter(
        F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(_bucket_tests())]),
        lambda b: b.isNotNull(),
    )
    drawn = results.withColumn("bucket", F.explode(member)).withColumn("draw", draw_key(seed))
    order = Window.partitionBy("bucket").orderBy("draw", "path")
    ranked = drawn.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= max_calls)
    quota = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("bucket") + 1)
    # Leftovers: rows past their quota, bucket by bucket, until the budget is spent.
    everywhere = Window.partitionBy(F.lit(0))
    first = F.col("rn") <= F.col("quota")
    later = Window.partitionBy(F.lit(0)).orderBy("bucket", "rn")
    placed = (
        ranked.withColumn("quota", quota)
        .withColumn("spent", F.sum(F.when(first, 1).otherwise(0)).over(everywhere))
        .withColumn("extra", F.sum(F.when(~first, 1).otherwise(0)).over(later))
    )
    return placed.where(
        first | (F.col("spent") + F.col("extra") <= max_calls)
    ).withColumn("redistributed", ~first).drop("quota", "spent", "extra")


def interleaved(sample: DataFrame) -> DataFrame:
    """Round-robin order over buckets; works on the bounded sample."""
    order = Window.partitionBy(F.lit(0)).orderBy("rn", "bucket")
    return sample.withColumn("position", F.row_number().over(order))


def stop_after_failures(
    calls: DataFrame, index: str = "position", limit: int = K.ABORT_AFTER_FAILURES
) -> DataFrame:
    """Drop rows after the first run of ``limit`` consecutive failures."""
    end = first_failing_run(calls, F.col("error") != "", limit, index)
    abort_at = F.coalesce(end.scalar(), F.col(index).cast("long"))
    return calls.where(F.col(index) <= abort_at)


def failure_warning(changes: DataFrame, planned: int | None = None) -> DataFrame:
    counted = changes.agg(
        F.count_if(F.col("error") != "").alias("failed"),
        (F.count("*") if planned is None else F.lit(planned)).alias("planned"),
    )
    return counted.withColumn("warn", F.col("failed") > F.col("planned") * 0.1)


def paired_confusion(changes: DataFrame) -> DataFrame:
    """Counts before and after fusion with the difference, one row per cell."""
    ok = changes.where(F.col("error") == "")
    before = confusion_counts(F.col("static_score") >= QUARANTINE)
    after = confusion_counts(F.col("ai_score") >= QUARANTINE)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("cell"), before[c].alias("before"), after[c].alias("after"))
            for c in ("tp", "fp", "tn", "fn")
        ]
    )
    return (
        ok.agg(cells.alias("c")).select(F.inline("c"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def _crossed(label: str) -> Column:
    return (
        (F.col("label") == label)
        & (F.col("static_score") >= QUARANTINE)
        & (F.col("ai_score") < QUARANTINE)
    )


def corrections(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_if(_crossed("clean")).alias("fps_corrected"),
        F.count_if(_crossed("malware")).alias("tps_lost"),
    )


def clean_drift(changes: DataFrame) -> DataFrame:
    """Mean score change on clean files and how many moved up or near quarantine."""
    ok = changes.where((F.col("label") == "clean") & (F.col("error") == ""))
    pushed = F.col("ai_score") > F.col("static_score")
    return ok.agg(
        F.avg(F.col("ai_score") - F.col("static_score")).alias("drift"),
        F.count_if(pushed).alias("pushed_up"),
        F.count_if(pushed & (F.col("ai_score") >= QUARANTINE - 10)).alias("near_quarantine"),
        F.count("*").alias("clean_files"),
    )


def answered(changes: DataFrame) -> DataFrame:
    return changes.where((F.col("error") == "") & (F.col("model_said") != ""))


def label_counts(changes: DataFrame) -> DataFrame:
    return answered(changes).groupBy("model_said").agg(F.count("*").alias("n"))


def spread(changes: DataFrame, minimum: int = 5) -> DataFrame:
    """Whether the fused scores vary; no row below ``minimum`` answers.

    Scores are grouped first (101 possible values), so the mode needs no sort
    of the answers.
    """
    scored = answered(changes)
    by_score = scored.groupBy("ai_score").agg(F.count("*").alias("n"))
    modal = by_score.agg(
        F.count("*").alias("distinct_scores"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("scored"),
        F.max_by("ai_score", F.struct("n", -F.col("ai_score"))).alias("modal_score"),
        F.max("n").alias("modal_count"),
    )
    labels = label_counts(changes).agg(F.count("*").alias("labels"))
    return (
        modal.withColumn("labels", labels.scalar())
        .where(F.col("scored") >= minimum)
        .withColumn(
            "constant_answer",
            (F.col("modal_count") > F.col("scored") * 0.6) | (F.col("labels") == 1),
        )
    )


def verdict_moves(changes: DataFrame, limit: int = 40) -> DataFrame:
    """Files whose verdict changed, highest static score first."""
    moved = (F.col("static_verdict") != F.col("ai_verdict")) & (F.col("error") == "")
    return changes.where(moved).orderBy(F.desc("static_score"), "file").limit(limit)


def run_totals(changes: DataFrame) -> DataFrame:
    moved = (F.col("static_verdict") != F.col("ai_verdict")) & (F.col("error") == "")
    return changes.agg(
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.count_if(moved).alias("moved"),
    )


def consulted() -> Column:
    return replays_gate(F.col("static_score"), F.col("indicators"))


def gate_modes(changes: DataFrame) -> DataFrame:
    """Confusion of the static, forced and gated modes side by side."""
    ok = changes.where(F.col("error") == "")
    gated = F.when(consulted(), F.col("ai_score")).otherwise(F.col("static_score"))
    modes = {"static": F.col("static_score"), "forced": F.col("ai_score"), "shipped": gated}
    counts = {m: confusion_counts(s >= QUARANTINE) for m, s in modes.items()}
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("cell"), *[counts[m][c].alias(f"{m}_n") for m in modes]
            )
            for c in ("tp", "fp", "tn", "fn")
        ]
    )
    return ok.agg(cells.alias("c")).select(F.inline("c"))


def consulted_share(changes: DataFrame) -> DataFrame:
    counted = changes.where(F.col("error") == "").agg(
        F.count("*").alias("files"), F.count_if(consulted()).alias("consulted")
    )
    return counted.withColumn("share", ratio(F.col("consulted"), F.col("files")))


def gate_effect(changes: DataFrame) -> DataFrame:
    ok = changes.where(F.col("error") == "")
    gained = (
        (F.col("label") == "malware")
        & (F.col("static_score") < QUARANTINE)
        & (F.col("ai_score") >= QUARANTINE)
    )
    return ok.agg(
        F.count_if(consulted() & _crossed("clean")).alias("corrected"),
        F.count_if(consulted() & _crossed("malware")).alias("lost"),
        F.count_if(consulted() & gained).alias("recovered"),
        F.count_if(~consulted() & _crossed("clean")).alias("missed"),
    )


def missed_corrections(changes: DataFrame, limit: int = 15) -> DataFrame:
    """Correctable false positives the gate never sends, highest score first."""
    ok = changes.where((F.col("error") == "") & _crossed("clean") & ~consulted())
    return ok.orderBy(F.desc("static_score"), "file").limit(limit)
