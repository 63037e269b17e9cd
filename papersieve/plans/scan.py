"""The whole scan: files in, findings, indicators and outcomes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papersieve.functions import links, scripts as js
from papersieve.functions.bytescan import byte_features
from papersieve.operators import objects as og
from papersieve.operators.patterns import indexed_hits, split_rules
from papersieve.operators.rules import Evidence, Rule, evaluated, failures, fired, registered_rules
from papersieve.operators.scoring import active_documents, outcomes
from papersieve.operators.signatures import BUNDLED, Signature, explode_hits, hit_array, require_rules
from papersieve.session import checkpoint_dir, once, staged, together, unbroadcast


def collect_scripts(w: og.Walk, budget: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Deduplicated and enriched scripts of every document, and what a budget left out.

    Without ``budget`` every script is kept whole. With one, a script that starts
    after so many characters of earlier ones is dropped and a longer one is cut;
    the second table then has a ``parse_errors`` row for each document concerned.
    """
    found = staged(og.script_findings(w), "doc_id")
    kept = js.drop_repeated_sweeps(found).withColumn("length", F.length("code"))
    if budget is None:
        return js.enrich_scripts(kept.withColumn("truncated", F.lit(False))), None
    place = ["doc_id", "ord", "location"]
    whole = staged(kept, "doc_id")
    budgeted = staged(js.apply_script_budget(whole, budget, place[1:]), "doc_id")
    dropped = whole.select(*place).join(budgeted.select(*place), place, "left_anti")
    bitten = budgeted.where("truncated").select("doc_id").unionByName(dropped.select("doc_id"))
    return js.enrich_scripts(budgeted), og.exhausted(bitten, "javascript extraction", "scripts")


def read_bytes(files: DataFrame, signatures: Sequence[Signature]) -> DataFrame:
    """Everything that comes from the raw bytes alone, in one narrow pass."""
    return byte_features(
        files,
        lambda text, low: {
            "swept": links.sweep(text), "hits": hit_array(text, low, signatures),
        },
    )


def collect_urls(read: DataFrame, w: og.Walk, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs from actions, scripts and the raw bytes, one row per document and URL.

    The second table has the error rows of documents that a limit on links bites.
    """
    per_script, per_file = w.limits.script_urls, w.limits.urls
    targets = og.uri_targets(w).withColumn("u", links.classify(F.col("target"))).where("u IS NOT NULL")
    acted = targets.select("doc_id", "ord", "u.*", "source", F.lit(0).alias("group_rank"))
    scripted = scripts.select(
        "doc_id",
        F.col("ord").alias("script_ord"),
        F.posexplode(links.sweep(F.col("code"), None, False)).alias("i", "u"),
    )
    no_errors = w.entries.sparkSession.createDataFrame([], "doc_id bigint, stage string, message string")
    errors = no_errors
    if per_script is not None:
        errors = errors.unionByName(
            og.exhausted(scripted.where(F.col("i") >= per_script), "script link", "urls")
        )
        scripted = scripted.where(F.col("i") < per_script)
    # Places follow the scripts' order; a script's links come before the next one's.
    place = F.struct("script_ord", "i")
    scripted = scripted.withColumn(
        "script_place", F.row_number().over(Window.partitionBy("doc_id").orderBy(place))
    ).select(
        "doc_id",
        F.col("script_place").cast("bigint").alias("ord"),
        "u.*",
        F.lit("javascript").alias("source"),
        F.lit(1).alias("group_rank"),
    )
    raw = read.select("doc_id", F.posexplode("swept").alias("ord", "u")).select(
        "doc_id", "ord", "u.*", F.lit("raw").alias("source"), F.lit(2).alias("group_rank")
    )
    merged = links.merge_urls(acted.unionByName(scripted).unionByName(raw))
    if per_file is not None:
        merged = staged(merged, "doc_id")
        errors = errors.unionByName(og.exhausted(merged.where(F.col("ord") > per_file), "link", "urls"))
        merged = merged.where(F.col("ord") <= per_file)
    return merged, errors


def structure_table(
    features: DataFrame, w: og.Walk, scripts: DataFrame, actions: DataFrame
) -> DataFrame:
    """One wide row per document: byte features, graph flags, text facts.

    All joins use ``doc_id``, so each side is shuffled once and the joins are
    co-partitioned.
    """
    active = active_documents(scripts, actions).withColumn("has_active_content", F.lit(True))
    text = og.excerpts(w)
    flags = og.structure_flags(w)
    joined = (
        features.join(unbroadcast(flags), "doc_id", "left")
        .join(unbroadcast(text), "doc_id", "left")
        .join(unbroadcast(active), "doc_id", "left")
    )
    chars = F.length(F.trim("text_excerpt"))
    off = F.lit(False)
    return joined.select(
        *[F.col(c) for c in features.columns],
        *[F.coalesce(c, off).alias(c) for c in (
            "is_encrypted", "is_linearized", "has_xref_stream", "has_object_streams",
            "has_acroform", "has_xfa", "has_openaction", "has_names_javascript",
            "has_active_content",
        )],
        "trailer_keys",
        "page_count",
        F.coalesce("text_excerpt", F.lit("")).alias("text_excerpt"),
        F.when(chars > 0, "extracted").otherwise("none").alias("text_source"),
        F.coalesce(chars, F.lit(0)).alias("text_chars"),
    )


class Scan:
    """What is found in files. Each table is made when it is first asked for, with those
    it comes from: written once under the checkpoint folder, and read back pruned by
    whoever needs a few of its columns."""

    def __init__(
        self, files: DataFrame, signatures: Sequence[Signature], rules: Sequence[Rule], limits: og.Limits
    ):
        self.files, self.rules, self.limits = files, list(rules), limits
        self.n_signatures = len(signatures)
        self.inline, self.more = split_rules(require_rules(signatures))

    @once
    def walk(self) -> og.Walk:
        return og.walk(og.stage_entries(self.files), self.limits)

    @once
    def read(self) -> DataFrame:
        # Without a rule of its own the byte pass has no array of outcomes to explode.
        return staged(read_bytes(self.files, self.inline or BUNDLED), "doc_id")

    @property
    def features(self) -> DataFrame:
        return self.read.drop("swept", "hits")

    @once
    def hits(self) -> DataFrame:
        loaded = F.lit(self.n_signatures)
        hits = explode_hits(self.read, self.inline or BUNDLED).withColumn("rules_loaded", loaded)
        if not self.more:
            return hits
        own = indexed_hits(self.files, self.more, len(self.inline), self.n_signatures)
        return staged(hits.unionByName(own) if self.inline else own, "doc_id")

    @once
    def _scripts(self) -> tuple[DataFrame, DataFrame | None]:
        return collect_scripts(self.walk, self.limits.script_chars)

    @once
    def scripts(self) -> DataFrame:
        return staged(self._scripts[0], "doc_id")

    @once
    def actions(self) -> DataFrame:
        return staged(og.actions(self.walk), "doc_id")

    @once
    def attachments(self) -> DataFrame:
        return staged(og.attachments(self.walk), "doc_id")

    @once
    def _links(self) -> tuple[DataFrame, DataFrame]:
        return collect_urls(self.read, self.walk, self.scripts)

    @once
    def urls(self) -> DataFrame:
        return staged(self._links[0], "doc_id")

    @once
    def structure(self) -> DataFrame:
        together(lambda: self.scripts, lambda: self.actions)
        return staged(structure_table(self.features, self.walk, self.scripts, self.actions), "doc_id")

    @once
    def errors(self) -> DataFrame:
        """Problems met before any rule ran. Read by rules and by whoever asks for errors."""
        errors = og.parse_errors(self.files, self.walk, self.features)
        if self.limits.urls is not None or self.limits.script_urls is not None:
            errors = errors.unionByName(self._links[1])
        if self.limits.script_chars is not None:
            errors = errors.unionByName(self._scripts[1])
        return staged(errors, "doc_id")

    @once
    def judged(self) -> Evidence:
        """What the rules read."""
        return Evidence(
            features=lambda: self.features,
            structure=lambda: self.structure,
            scripts=lambda: self.scripts,
            actions=lambda: self.actions,
            attachments=lambda: self.attachments,
            urls=lambda: self.urls,
            hits=lambda: self.hits,
            errors=lambda: self.errors,
        )

    @once
    def _said(self) -> DataFrame:
        # All tables are needed: what does not wait for each other runs side by side.
        together(lambda: self.read, lambda: self.walk)
        w = self.walk
        together(lambda: w.edges, lambda: w.roots, lambda: w.attributes, lambda: w.scripts)
        w.notes  # noqa: B018 - the next two start from it
        together(lambda: w.added, lambda: w.linked)
        together(lambda: self.scripts, lambda: self.actions, lambda: self.attachments)
        together(lambda: self.structure, lambda: self.urls)
        return staged(evaluated(self.judged, self.rules), "doc_id")

    @once
    def evidence(self) -> Evidence:
        """The findings, with the rules that failed among the errors."""
        return Evidence(
            features=lambda: self.features,
            structure=lambda: self.structure,
            scripts=lambda: self.scripts,
            actions=lambda: self.actions,
            attachments=lambda: self.attachments,
            urls=lambda: self.urls,
            hits=lambda: self.hits,
            errors=lambda: self._errors,
        )

    @once
    def _errors(self) -> DataFrame:
        failed = failures(self._said)
        return self.errors.unionByName(failed)

    @once
    def indicators(self) -> DataFrame:
        return fired(self._said)

    @once
    def outcomes(self) -> DataFrame:
        return outcomes(self.indicators, self.files)


def scan_files(
    files: DataFrame,
    signatures: tuple[Signature, ...] = BUNDLED,
    rules: list[Rule] | None = None,
    limits: og.Limits = og.Limits(),
) -> Scan:
    """Scan ``files(doc_id, content)``.

    The leading bundled rules of ``signatures`` are tested in the byte pass; any
    others, up to thousands, by an index of their patterns and one more narrow pass.
    ``limits`` bounds what is taken from one document, nothing by default; each
    document that a limit bites has a ``parse_errors`` row saying so.

    Runs nothing yet: each findings table is written once under the checkpoint folder
    when it is first asked for, with the tables it comes from and no others. ``content``
    is read by two narrow passes (byte features with URL sweep and signatures; object
    entries) and never shuffled.
    """
    checkpoint_dir(files.sparkSession)  # A scratch folder must exist before threads ask for one.
    return Scan(files, signatures, registered_rules() if rules is None else rules, limits)
