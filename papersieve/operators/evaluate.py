"""Labelled evaluation of scores: confusion, rates, discrimination.

Threshold tables are evaluated as conditional counts in one aggregation and
turned into rows afterwards, so no row is replicated per threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.text import literals, ratio


def label_of(dataset: Column) -> Column:
    """Ground truth from a dataset name; malware wins over clean."""
    name = F.upper(dataset)
    return F.when(F.contains(name, F.lit("MALWARE")), "malware").when(
        F.contains(name, F.lit("CLEAN")), "clean"
    )


def scored_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("is_pdf") & (F.col("error") == ""))


def parse_failure_only(codes: Column) -> Column:
    return (F.size(codes) > 0) & (
        F.size(F.array_except(codes, literals(K.PARSE_ONLY_CODES))) == 0
    )


def per_value(
    rows: DataFrame,
    values: Sequence,
    name: str,
    measures: Callable[[Column], dict[str, Column]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per value with its measures, from a single aggregation."""
    names = list(measures(F.lit(values[0])))
    packed = F.array(
        *[
            F.struct(F.lit(v).alias(name), *[c.alias(n) for n, c in measures(F.lit(v)).items()])
            for v in values
        ]
    )
    return (
        rows.groupBy(*keys).agg(packed.alias("_rows"))
        .select(*keys, F.explode("_rows").alias("r"))
        .select(*keys, f"r.{name}", *[f"r.{n}" for n in names])
    )


def confusion_counts(flagged: Column, label: Column = None) -> dict[str, Column]:
    bad = (F.col("label") if label is None else label) == "malware"
    return {
        "tp": F.count_if(bad & flagged),
        "fp": F.count_if(~bad & flagged),
        "tn": F.count_if(~bad & ~flagged),
        "fn": F.count_if(bad & ~flagged),
    }


def confusion(
    results: DataFrame, thresholds: Sequence[int] = K.THRESHOLDS, strict: bool = False
) -> DataFrame:
    """Confusion matrix per threshold over scored rows.

    With ``strict`` a file whose only finding is a parse failure is not flagged.
    """
    def measures(t: Column) -> dict[str, Column]:
        flagged = F.col("score") >= t
        if strict:
            flagged = flagged & ~parse_failure_only(F.col("indicators"))
        return confusion_counts(flagged)

    return per_value(scored_rows(results), thresholds, "threshold", measures)


def with_rates(matrix: DataFrame) -> DataFrame:
    """Precision, recall, specificity, FPR, accuracy and F1; 0 when undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return matrix.withColumns(
        {
            "precision": p,
            "recall": r,
            "specificity": ratio(tn, tn + fp),
            "fpr": ratio(fp, tn + fp),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)),
        }
    )


def product_bands(results: DataFrame, bands: Sequence[int] = K.PRODUCT_BANDS) -> DataFrame:
    """Clean documents flagged at the shipped thresholds."""
    clean = scored_rows(results).where(F.col("label") == "clean")
    counted = per_value(
        clean, bands, "threshold",
        lambda t: {"flagged": F.count_if(F.col("score") >= t), "clean": F.count("*")},
    )
    return counted.withColumn("rate", ratio(F.col("flagged"), F.col("clean")))


def corpus_counts(results: DataFrame) -> DataFrame:
    """Files per dataset and label, with the grand total."""
    counted = scored_rows(results).groupBy("dataset", "label").agg(F.count("*").alias("files"))
    total = counted.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files")).select(
        F.lit("(total)").alias("dataset"), F.lit("(all)").alias("label"), "files"
    )
    return counted.unionByName(total)


def exclusions(results: DataFrame) -> DataFrame:
    """Counts of excluded rows and of text sources among scored ones."""
    ok = F.col("is_pdf") & (F.col("error") == "")
    return results.agg(
        F.count_if(~F.col("is_pdf")).alias("non_pdf"),
        F.count_if(F.col("error") != "").alias("errors"),
        *[
            F.count_if(ok & (F.col("text_source") == s)).alias(f"text_{s}")
            for s in ("ocr", "extracted", "none")
        ],
    )


def parse_only_share(results: DataFrame) -> DataFrame:
    bad = scored_rows(results).where(F.col("label") == "malware")
    counted = bad.agg(
        F.count_if(parse_failure_only(F.col("indicators"))).alias("parse_only"),
        F.count("*").alias("malware"),
    )
    return counted.withColumn("share", ratio(F.col("parse_only"), F.col("malware")))


def indicator_rates(results: DataFrame) -> DataFrame:
    """Documents per label and code with the label's total; small after grouping."""
    scored = scored_rows(results)
    totals = scored.groupBy("label").agg(F.count("*").alias("label_total"))
    hits = (
        scored.select("label", F.explode(F.array_distinct("indicators")).alias("code"))
        .groupBy("label", "code")
        .agg(F.count("*").alias("docs"))
    )
    return hits.join(totals, "label").withColumn(
        "rate", ratio(F.col("docs"), F.col("label_total"))
    )


def top_codes(results: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent codes per label. Ranks the counted codes, not the documents."""
    order = Window.partitionBy("label").orderBy(F.desc("docs"), "code")
    return (
        indicator_rates(results)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
    )


def discrimination(results: DataFrame) -> DataFrame:
    """Malware rate over clean rate per code; infinite when clean never shows it."""
    counted = (
        indicator_rates(results)
        .groupBy("code")
        .agg(
            F.coalesce(F.max(F.when(F.col("label") == "malware", F.col("rate"))), F.lit(0.0)).alias("malware_rate"),
            F.coalesce(F.max(F.when(F.col("label") == "clean", F.col("rate"))), F.lit(0.0)).alias("clean_rate"),
        )
    )
    return counted.withColumn(
        "discrimination",
        F.coalesce(
            F.try_divide(F.col("malware_rate"), F.col("clean_rate")), F.lit(float("inf"))
        ),
    )


def worst_clean(results: DataFrame, threshold: int = 80, limit: int = 40) -> DataFrame:
    """Highest-scoring clean documents, with how many more there are."""
    bad = scored_rows(results).where((F.col("label") == "clean") & (F.col("score") >= threshold))
    total = bad.agg(F.greatest(F.lit(0), F.count("*") - limit).alias("not_shown"))
    shown = bad.orderBy(F.desc("score"), "path").limit(limit)
    return shown.withColumn("not_shown", total.scalar())


def escape_cutoffs(results: DataFrame, cutoffs: Sequence[int] = K.ESCAPE_CUTOFFS) -> DataFrame:
    """Documents with at least so many escaped names, per label, and the ratio."""
    bad = F.col("label") == "malware"
    clean = F.col("label") == "clean"
    counted = per_value(
        scored_rows(results), cutoffs, "cutoff",
        lambda c: {
            "malware": F.count_if(bad & (F.col("obfuscated_names") >= c)),
            "benign": F.count_if(clean & (F.col("obfuscated_names") >= c)),
            "malware_total": F.count_if(bad),
            "benign_total": F.count_if(clean),
        },
    )
    rates = counted.withColumn("malware_rate", ratio(F.col("malware"), F.col("malware_total"))).withColumn(
        "benign_rate", ratio(F.col("benign"), F.col("benign_total"))
    )
    return rates.withColumn("rate_ratio", F.try_divide("malware_rate", "benign_rate")).drop(
        "malware_total", "benign_total"
    )


def throughput(results: DataFrame, seconds: float) -> DataFrame:
    return results.agg(F.count("*").alias("files")).withColumn(
        "files_per_second", F.try_divide(F.col("files"), F.lit(float(seconds)))
    )


def report(results: DataFrame) -> DataFrame:
    """The evaluation as one long table ``section, key, metric, value``."""
    def long(df: DataFrame, section: str, key: Column, metrics: Sequence[str]) -> DataFrame:
        pairs = F.map_from_arrays(
            literals(metrics), F.array(*[F.col(m).cast("double") for m in metrics])
        )
        return df.select(
            F.lit(section).alias("section"),
            key.cast("string").alias("key"),
            F.explode(pairs).alias("metric", "value"),
        )

    rates = ["tp", "fp", "tn", "fn", "precision", "recall", "specificity", "fpr", "f1"]
    threshold = F.col("threshold")
    place = F.concat_ws("/", "dataset", "label")
    code = F.concat_ws("/", "label", "code")
    parts = [
        long(corpus_counts(results), "corpus", place, ["files"]),
        long(exclusions(results), "excluded", F.lit("all"), ["non_pdf", "errors", "text_ocr", "text_extracted", "text_none"]),
        long(product_bands(results), "bands", threshold, ["flagged", "clean", "rate"]),
        long(with_rates(confusion(results)), "detection", threshold, rates),
        long(with_rates(confusion(results, strict=True)), "detection_strict", threshold, rates),
        long(parse_only_share(results), "parse_only", F.lit("malware"), ["parse_only", "malware", "share"]),
        long(top_codes(results), "indicators", code, ["docs", "rate"]),
        long(escape_cutoffs(results), "escapes", F.col("cutoff"), ["malware", "benign", "malware_rate", "benign_rate", "rate_ratio"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
