"""Document object graph: actions, scripts, attachments and flags by joins.

Input everywhere is the entry table of :mod:`papersieve.functions.entries`.
Rows of one file are bounded by the upload and object caps, so per-document
groups and ranks below are bounded whatever the corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersieve import constants as K
from papersieve.functions.arrow import entropy_4dp
from papersieve.functions.bytescan import magic_type, sha256_hex, text_excerpts
from papersieve.functions.entries import ENTRY_SCHEMA, explode_files
from papersieve.functions.text import case_map, safe_text
from papersieve.operators.trees import labelled, preorder
from papersieve.session import once, staged, together, unbroadcast

_ID = ["doc_id", "node"]


@dataclass(frozen=True)
class Limits:
    """How much of one document is taken; None takes all.

    Each document that a limit bites has one ``parse_errors`` row for that limit.
    ``text_pages`` is no such limit: an excerpt comes from the first pages.
    """

    pages: int | None = None
    annotations: int | None = None
    urls: int | None = None
    script_urls: int | None = None
    script_chars: int | None = None
    text_pages: int = K.MAX_TEXT_PAGES


def _is_edge() -> Column:
    return F.col("kind").isin("ref", "node")


def object_entries(files: DataFrame) -> DataFrame:
    """Entry table of ``files(doc_id, content)``, lazily."""
    return files.select("doc_id", "content").mapInArrow(explode_files, ENTRY_SCHEMA)


def stage_entries(files: DataFrame) -> DataFrame:
    """Entry table written once; the walks below each read a few keys of it."""
    return staged(object_entries(files), "key", "doc_id")


def objects(entries: DataFrame, cap: int = K.MAX_OBJECTS) -> DataFrame:
    """Distinct indirect objects per document within the scan cap."""
    return (
        entries.where((F.col("obj") >= 0) & (F.col("obj_index") < cap))
        .select("doc_id", "obj", "obj_index")
        .distinct()
    )


# Keys some walk follows; edges under other keys are not kept.
FOLLOWED = (
    "/A", "/AA", "/AcroForm", "/Annots", "/Contents", "/EF", "/EmbeddedFiles", "/F",
    "/JavaScript", "/Kids", "/Metadata", "/Names", "/Pages",
)


def resolved_edges(entries: DataFrame) -> DataFrame:
    """``doc_id, node, key, pos, child`` for the followed keys.

    A reference to an array object is replaced by one edge per item, so that
    every later step is a single join.
    """
    named = entries.where(_is_edge() & F.col("key").isin(*FOLLOWED)).select(
        "doc_id", "node", "key", "pos", F.col("value").alias("child")
    )
    items = entries.where(_is_edge() & (F.col("key") == "[]")).select(
        "doc_id", F.col("node").alias("child"), F.col("pos").alias("_p"), F.col("value").alias("_c")
    )
    return named.join(items, ["doc_id", "child"], "left").select(
        "doc_id",
        "node",
        "key",
        F.coalesce("_p", "pos").alias("pos"),
        F.coalesce("_c", "child").alias("child"),
    )


def follow(frontier: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Replace ``node`` by each child under ``key``; adds the item position."""
    wanted = edges.where(F.col("key") == key).drop("key")
    kept = frontier.drop("pos")
    return kept.join(wanted, _ID).drop("node").withColumnRenamed("child", "node")


def catalogs(entries: DataFrame) -> DataFrame:
    """The catalog node per document: the trailer's root, else a typed catalog."""
    named = entries.where(
        (F.col("node") == "trailer") & (F.col("key") == "/Root") & (F.col("kind") == "ref")
    ).select("doc_id", F.col("value").alias("node"))
    defined = entries.where(F.col("key") == "/Type").select("doc_id", "node", "value")
    typed = defined.where(F.col("value") == "/Catalog").select("doc_id", "node")
    present = entries.where(F.col("key").isin("/Pages", "/Type")).select(_ID).distinct()
    found = named.join(present, _ID, "left_semi").withColumn("_rank", F.lit(0)).unionByName(
        typed.withColumn("_rank", F.lit(1))
    )
    return found.groupBy("doc_id").agg(F.min_by("node", F.struct("_rank", "node")).alias("node"))


def tree_nodes(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the page, script-name and attachment-name trees with their place.

    Trees start at the catalog and go on along ``/Kids``. Also returns the
    documents whose trees could not be followed to their end.
    """
    named = staged(follow(roots.select(_ID), edges, "/Names"), "doc_id")
    starts = labelled(
        [
            ("pages", follow(roots.select(_ID), edges, "/Pages")),
            ("scripts", follow(named, edges, "/JavaScript")),
            ("files", follow(named, edges, "/EmbeddedFiles")),
        ]
    ).withColumnRenamed("pos", "slot")
    starts = staged(starts, "doc_id")
    kids = edges.where(F.col("key") == "/Kids").select("doc_id", "node", F.col("pos").alias("slot"), "child")
    # A tree's edges are those of its document; which of them it reaches is found out there.
    trees = starts.select("doc_id", "tree").distinct()
    return preorder(kids.join(unbroadcast(trees), "doc_id"), starts)


def page_nodes(trees: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages with their 0-based index in tree order."""
    inner = entries.where(F.col("key") == "/Kids").select(_ID).distinct()
    leaves = trees.where(F.col("tree") == "pages").join(inner, _ID, "left_anti")
    order = Window.partitionBy("doc_id").orderBy("place", "node")
    return leaves.select(
        "doc_id", "node", (F.row_number().over(order) - 1).alias("page")
    )


def action_attributes(entries: DataFrame) -> DataFrame:
    """One row per dictionary that could be an action, its keys as columns."""
    keys = ("/S", "/URI", "/F", "/Win", "/D", "/JS", "/Subtype", "/FS")

    def first(key: str) -> Column:
        return F.min_by(
            F.when(F.col("key") == key, F.col("value")),
            F.when(F.col("key") == key, F.col("pos")),
        )

    flat = (
        entries.where(F.col("key").isin(*keys))
        .groupBy(_ID)
        .agg(
            *[first(k).alias(k.strip("/").lower()) for k in keys],
            F.max(F.when((F.col("key") == "/JS") & _is_edge(), F.col("value"))).alias("js_node"),
            F.max(F.when((F.col("key") == "/Win") & _is_edge(), F.col("value"))).alias("win_node"),
        )
    )
    program = (
        entries.where((F.col("key") == "/F") & (F.col("kind") == "string"))
        .groupBy("doc_id", F.col("node").alias("win_node"))
        .agg(F.min("value").alias("win_file"))
    )
    # An action's target is the first of these keys it has.
    return flat.join(program, ["doc_id", "win_node"], "left").withColumn(
        "target",
        F.coalesce(
            F.col("uri"),
            F.col("f"),
            F.coalesce("win_file", "win"),
            F.col("d"),
            F.when(F.col("js").isNotNull(), "<javascript>"),
        ),
    )


def script_sources(entries: DataFrame) -> DataFrame:
    """Script text per dictionary holding ``/JS``, inline or through a reference."""
    holders = entries.where(F.col("key") == "/JS").select(
        "doc_id", "node", "obj_index", "kind", "value"
    )
    inline = holders.where(~_is_edge()).select(
        "doc_id", "node", "obj_index", F.col("value").alias("code")
    )
    replaced = F.make_valid_utf8(F.col("payload").cast("string"))
    stored = entries.where(
        (F.col("kind") == "stream") | ((F.col("key") == "") & (F.col("kind") == "string"))
    ).select(
        "doc_id", F.col("node").alias("value"), F.coalesce(replaced, F.col("value")).alias("code")
    )
    indirect = holders.where(_is_edge()).join(stored, ["doc_id", "value"]).select(
        "doc_id", "node", "obj_index", "code"
    )
    return inline.unionByName(indirect).where(F.length("code") > 0)


class Walk:
    """The relations every finding below starts from, each staged when it is first asked for.

    A finding runs the steps it comes from and no others. The relations are staged
    because several findings start from them; unstaged, each plan repeats their joins,
    and what the driver holds while it plans grows with the joins of a plan and the
    number of plans, not with the data.
    """

    def __init__(self, entries: DataFrame, limits: Limits = Limits()):
        self.entries, self.limits = entries, limits

    @once
    def edges(self) -> DataFrame:
        return staged(resolved_edges(self.entries), "key", "doc_id")

    @once
    def roots(self) -> DataFrame:
        return staged(catalogs(self.entries), "doc_id")

    @once
    def attributes(self) -> DataFrame:
        return staged(action_attributes(self.entries), "doc_id")

    @once
    def scripts(self) -> DataFrame:
        return staged(script_sources(self.entries), "doc_id")

    @once
    def _followed(self) -> tuple[DataFrame, DataFrame]:
        together(lambda: self.edges, lambda: self.roots)
        return tree_nodes(self.edges, self.roots)

    @property
    def trees(self) -> DataFrame:
        return self._followed[0]

    @property
    def cut_trees(self) -> DataFrame:
        return self._followed[1]

    @once
    def pages(self) -> DataFrame:
        return staged(page_nodes(self.trees, self.entries), "doc_id")

    @once
    def notes(self) -> DataFrame:
        return staged(annotations(self), "doc_id")

    @once
    def added(self) -> DataFrame:
        return staged(additional_actions(self), "doc_id")

    @once
    def linked(self) -> DataFrame:
        return staged(link_actions(self), "doc_id")


def walk(entries: DataFrame, limits: Limits = Limits()) -> Walk:
    """The walk over staged ``entries``; runs nothing yet."""
    return Walk(entries, limits)


def _order(stage: int, *parts: Column) -> Column:
    """Position of a finding: stage, then up to three bounded local numbers."""
    total = F.lit(stage).cast("long")
    for part in (list(parts) + [F.lit(0)] * 3)[:3]:
        total = total * 100_000 + part
    return total


def open_actions(w: Walk) -> DataFrame:
    """``/OpenAction`` entries of the catalog; a bare destination counts too."""
    held = (
        w.entries.where((F.col("key") == "/OpenAction") & (F.col("pos") <= 0))
        .join(w.roots, _ID, "left_semi")
        .select("doc_id", "kind", "pos", "value")
    )
    return held.select(
        "doc_id",
        F.when(_is_edge() & (F.col("pos") < 0), F.col("value")).alias("node"),
        F.lit("/OpenAction").alias("location"),
        _order(0).alias("ord"),
    )


def walked_pages(w: Walk) -> DataFrame:
    most = w.limits.pages
    return w.pages if most is None else w.pages.where(F.col("page") < most)


def annotations(w: Walk) -> DataFrame:
    """Annotations of the pages, within the limits on both."""
    found = follow(walked_pages(w), w.edges, "/Annots")
    if w.limits.annotations is not None:
        found = found.where(F.col("pos") < w.limits.annotations)
    return (
        found.join(w.attributes.select(*_ID, "subtype", "fs"), _ID, "left")
        .withColumn("subtype", F.coalesce("subtype", F.lit("")))
    )


def additional_actions(w: Walk) -> DataFrame:
    """Entries of every ``/AA`` dictionary at document, page and annotation level."""
    at_root = follow(w.roots.select(_ID), w.edges, "/AA").select(
        *_ID, F.lit("/Root/AA").alias("location"), _order(1).alias("base")
    )
    place = F.format_string("/Page[%d]", F.col("page"))
    at_page = follow(walked_pages(w), w.edges, "/AA").select(
        *_ID, F.concat(place, F.lit("/AA")).alias("location"), _order(3, F.col("page")).alias("base")
    )
    notes = w.notes.select("doc_id", "node", "page", F.col("pos").alias("slot"))
    at_note = follow(notes, w.edges, "/AA").select(
        *_ID,
        F.concat(place, F.lit("/Annot/AA")).alias("location"),
        _order(3, F.col("page"), F.col("slot") + 1, F.lit(50)).alias("base"),
    )
    holders = at_root.unionByName(at_page).unionByName(at_note)
    held = w.entries.where(F.startswith("key", F.lit("/"))).select(
        "doc_id", "node", "key", "kind", "value"
    )
    order = Window.partitionBy("doc_id", "location", "base").orderBy("key")
    return (
        holders.join(held, _ID)
        .withColumn("trigger", case_map(F.col("key"), K.AA_TRIGGERS, F.col("key")))
        .select(
            "doc_id",
            F.when(_is_edge(), F.col("value")).alias("node"),
            "location",
            "key",
            "trigger",
            (F.col("base") + F.row_number().over(order)).alias("ord"),
        )
    )


def link_actions(w: Walk) -> DataFrame:
    """``/A`` actions of annotations."""
    notes = w.notes.select(
        "doc_id", "node", "page", F.col("pos").alias("slot"), "subtype"
    )
    place = F.format_string("/Page[%d]", F.col("page"))
    return follow(notes, w.edges, "/A").select(
        *_ID,
        F.concat(place, F.lit("/Annot"), F.col("subtype")).alias("location"),
        _order(3, F.col("page"), F.col("slot") + 1).alias("ord"),
    )


_ACTION_COLUMNS = (
    "doc_id", "ord", "kind", "trigger", "target", "object_id", "auto_executes", "details",
)


def _action(kind: Column, trigger: Column, target: Column, auto: Column, **details: Column):
    pairs = [c for k, v in details.items() for c in (F.lit(k), v)]
    empty = F.create_map().cast("map<string,string>")
    return [
        "doc_id",
        "ord",
        kind.alias("kind"),
        trigger.alias("trigger"),
        target.alias("target"),
        F.lit(None).cast("string").alias("object_id"),
        auto.alias("auto_executes"),
        (F.create_map(*pairs) if pairs else empty).alias("details"),
    ]


def recorded_kinds(w: Walk, whole: bool = False) -> DataFrame:
    """Launch, URI, form-submit, go-to and media actions below ``/AA`` and ``/A``.

    Targets are clipped as they are shown, unless ``whole`` asks for all of them.
    """
    nested = w.added.select("doc_id", "node", "location", "ord").unionByName(w.linked)
    subtype = F.col("s")
    return (
        nested.join(w.attributes, _ID)
        .where(subtype.isin(*K.ACTION_KINDS))
        .withColumn("ord", F.col("ord") + 20)
        .select(
            *_action(
                subtype,
                F.col("location"),
                safe_text(F.col("target"), None if whole else 512),
                subtype.isin("/Launch", "/GoToE"),
                location=F.col("location"),
            )
        )
    )


def swept_objects(w: Walk) -> DataFrame:
    """Top-level dictionaries within the scan cap, with their action attributes."""
    top = w.entries.where(
        (F.col("obj_index") < K.MAX_OBJECTS)
        & F.col("key").isin("/Launch", "/S", "/URI", "/JS")
        & (F.col("node") == F.col("obj").cast("string"))
    )
    flags = top.groupBy("doc_id", "node", "obj_index").agg(
        F.max(F.col("key") == "/Launch").alias("has_launch")
    )
    return flags.join(w.attributes, _ID, "left")


def actions(w: Walk) -> DataFrame:
    """All action findings in walk order."""
    attrs = w.attributes.select(*_ID, "s", "target")
    subtype = safe_text(F.col("s"))
    opened = open_actions(w).join(attrs, _ID, "left").select(
        *_action(
            F.lit("/OpenAction"),
            F.lit("DocumentOpen"),
            safe_text(F.col("target")),
            F.lit(True),
            subtype=subtype,
        )
    )
    added = w.added.join(attrs, _ID, "left").select(
        *_action(
            F.lit("/AA"),
            F.col("trigger"),
            safe_text(F.col("target")),
            F.col("trigger").isin(*K.AA_AUTO_TRIGGERS),
            location=F.col("location"),
            subtype=subtype,
        )
    )
    place = F.format_string("/Page[%d]", F.col("page"))
    notes = w.notes.withColumn(
        "ord", _order(3, F.col("page"), F.col("pos") + 1, F.lit(90))
    )
    attached = notes.where(F.col("subtype") == "/FileAttachment").select(
        *_action(F.lit("/FileAttachment"), place, safe_text(F.col("fs")), F.lit(False))
    )
    media = notes.where(F.col("subtype").isin(*K.RICH_MEDIA_SUBTYPES)).select(
        *_action(F.col("subtype"), place, F.lit(None).cast("string"), F.lit(False))
    )
    swept = (
        swept_objects(w)
        .where(F.col("has_launch") | (F.col("s") == "/Launch"))
        .withColumn("ord", _order(5, F.col("obj_index")))
        .select(
            *_action(
                F.lit("/Launch"),
                F.format_string("/Object[%d]", F.col("obj_index")),
                safe_text(F.col("f")),
                F.lit(True),
            ),
            F.col("obj_index").cast("string").alias("_oid"),
        )
        .withColumn("object_id", F.col("_oid"))
        .drop("_oid")
    )
    parts = (opened, added, recorded_kinds(w), attached, media, swept)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*_ACTION_COLUMNS)


def script_findings(w: Walk) -> DataFrame:
    """Script payloads with location, stage and order; not yet deduplicated."""
    code = w.scripts.select(*_ID, "code")
    opened = open_actions(w).select(*_ID, "location", "ord")
    added = w.added.select(
        *_ID, F.concat("location", "key").alias("location"), "ord"
    )
    linked = w.linked.select(
        *_ID, F.concat("location", F.lit("/A")).alias("location"), "ord"
    )
    leaves = (
        w.trees.where(F.col("tree") == "scripts")
        .join(w.edges.where((F.col("key") == "/Names") & (F.col("pos") % 2 == 1)).drop("key"), _ID)
        .select("doc_id", F.col("child").alias("node"), "place", "pos")
    )
    order = Window.partitionBy("doc_id").orderBy("place", "pos")
    named = leaves.select(
        *_ID,
        F.lit("/Names/JavaScript").alias("location"),
        _order(2, F.row_number().over(order)).alias("ord"),
    )
    targeted = opened.unionByName(added).unionByName(linked).unionByName(named)
    hit = targeted.join(code, _ID).select(
        "doc_id", "ord", "location", "code", F.lit("targeted").alias("stage"),
        F.lit(None).cast("string").alias("object_id"),
    )
    swept = w.scripts.where(~F.contains("node", F.lit("/"))).select(
        "doc_id",
        _order(5, F.col("obj_index")).alias("ord"),
        F.format_string("/Object[%d]", F.col("obj_index")).alias("location"),
        "code",
        F.lit("sweep").alias("stage"),
        F.col("obj_index").cast("string").alias("object_id"),
    )
    return hit.unionByName(swept).withColumn(
        "sha256", F.sha2(F.encode("code", "UTF-8"), 256)
    )


def uri_targets(w: Walk) -> DataFrame:
    """Link targets found in actions and objects: ``doc_id, ord, target, source``.

    Whole targets: what a link is gets decided before anything is clipped.
    """
    from_actions = (
        recorded_kinds(w, whole=True)
        .where(F.col("kind").isin("/URI", "/SubmitForm", "/GoToR") & (F.col("target") != ""))
        .select("doc_id", "ord", "target", F.concat(F.lit("action:"), "kind").alias("source"))
    )
    from_objects = (
        swept_objects(w)
        .where(F.length("uri") > 0)
        .select(
            "doc_id",
            _order(5, F.col("obj_index")).alias("ord"),
            safe_text(F.col("uri"), None).alias("target"),
            F.lit("object").alias("source"),
        )
    )
    return from_actions.unionByName(from_objects)


def attachments(w: Walk) -> DataFrame:
    """Embedded files reached through the attachment name tree."""
    pairs = w.entries.where(F.col("key") == "/Names").select(
        "doc_id", "node", "pos", "kind", "value"
    )
    names = pairs.where(F.col("kind") == "string").select(
        *_ID, (F.col("pos") + 1).alias("pos"), F.col("value").alias("name")
    )
    specs = pairs.where(_is_edge()).select(*_ID, "pos", F.col("value").alias("spec"))
    named = (
        w.trees.where(F.col("tree") == "files")
        .join(names.join(specs, [*_ID, "pos"]), _ID)
        .select("doc_id", "name", F.col("spec").alias("node"))
    )
    streams = (
        follow(follow(named, w.edges, "/EF"), w.edges, "/F")
        .select("doc_id", "name", "node")
        .join(
            w.entries.where(F.col("kind") == "stream").select(*_ID, "payload"), _ID
        )
        .join(
            w.entries.where((F.col("key") == "/Subtype") & (F.col("kind") == "name")).select(
                *_ID, F.col("value").alias("mime_type")
            ),
            _ID,
            "left",
        )
    )
    sample = F.substring("payload", 1, K.EMBEDDED_SAMPLE_BYTES)
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    order = Window.partitionBy("doc_id").orderBy("name")
    return streams.select(
        "doc_id",
        F.row_number().over(order).alias("ord"),
        "name",
        F.left(F.regexp_replace("mime_type", "^/", ""), F.lit(128)).alias("mime_type"),
        F.octet_length("payload").cast("long").alias("size"),
        sha256_hex(F.col("payload")).alias("sha256"),
        F.nullif(F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)), F.lit("")).alias(
            "extension"
        ),
        magic_type(sample).alias("magic_bytes"),
        entropy_4dp(sample).alias("entropy"),
    )


def metadata(w: Walk) -> DataFrame:
    """Known document-info keys as columns, the rest and XMP values in ``extra``."""
    info = (
        w.entries.where((F.col("node") == "trailer") & (F.col("key") == "/Info") & _is_edge())
        .select("doc_id", F.col("value").alias("node"))
        .join(
            w.entries.where(F.startswith("key", F.lit("/")) & ~_is_edge()).select(
                *_ID, "key", "value"
            ),
            _ID,
        )
        .select("doc_id", "key", safe_text(F.col("value")).alias("value"))
    )
    xmp = (
        follow(w.roots.select(_ID), w.edges, "/Metadata")
        .join(w.entries.where(F.col("kind") == "stream").select(*_ID, "payload"), _ID)
        .select(
            "doc_id",
            F.explode(
                F.regexp_extract_all(
                    F.make_valid_utf8(F.col("payload").cast("string")),
                    F.lit(r"<([A-Za-z]+:[A-Za-z]+)>[^<]*</"),
                    F.lit(0),
                )
            ).alias("tag"),
        )
        .select(
            "doc_id",
            F.concat(F.lit("xmp:"), F.regexp_extract("tag", r"^<([^>]+)>", 1)).alias("key"),
            safe_text(F.regexp_extract("tag", r">([^<]*)<", 1), 256).alias("value"),
        )
    )
    known = dict(K.INFO_FIELDS)
    pairs = info.unionByName(xmp).groupBy("doc_id", "key").agg(F.min("value").alias("value"))
    extra = ~F.col("key").isin(*known)
    return pairs.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for k, n in K.INFO_FIELDS],
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(extra, F.struct("key", "value"))))
        ).alias("extra"),
    )


def structure_flags(w: Walk) -> DataFrame:
    """Per-document flags by one aggregation over the few entries that decide them."""
    root = w.roots.select("doc_id", F.col("node").alias("root_node"))
    trailer = F.col("node") == "trailer"
    base = (
        w.entries.where(
            trailer
            | F.col("key").isin("/Linearized", "/AcroForm", "/XFA", "/OpenAction")
            | ((F.col("key") == "/Type") & (F.col("value") == "/ObjStm"))
        )
        .join(root, "doc_id", "left")
        .groupBy("doc_id")
        .agg(
            F.coalesce(F.bool_or(trailer & (F.col("key") == "/Encrypt")), F.lit(False)).alias(
                "is_encrypted"
            ),
            F.bool_or(F.col("key") == "/Linearized").alias("is_linearized"),
            F.bool_or(trailer & F.col("key").isin("/XRefStm", "/Type")).alias("has_xref_stream"),
            F.bool_or((F.col("key") == "/Type") & (F.col("value") == "/ObjStm")).alias(
                "has_object_streams"
            ),
            F.array_sort(F.collect_set(F.when(trailer, F.col("key")))).alias("trailer_keys"),
            F.coalesce(
                F.bool_or((F.col("key") == "/AcroForm") & (F.col("node") == F.col("root_node"))),
                F.lit(False),
            ).alias("has_acroform"),
            F.coalesce(
                F.bool_or((F.col("key") == "/OpenAction") & (F.col("node") == F.col("root_node"))),
                F.lit(False),
            ).alias("has_openaction"),
        )
    )
    named = (
        w.trees.where(F.col("tree") == "scripts")
        .select("doc_id").distinct().withColumn("has_names_javascript", F.lit(True))
    )
    forms = follow(w.roots.select(_ID), w.edges, "/AcroForm").select(_ID)
    xfa = (
        w.entries.where(F.col("key") == "/XFA").join(forms, _ID, "left_semi")
        .select("doc_id").distinct().withColumn("has_xfa", F.lit(True))
    )
    counted = w.pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    return (
        base.join(unbroadcast(xfa), "doc_id", "left")
        .join(counted, "doc_id", "left")
        .join(named, "doc_id", "left")
        .withColumn("has_xfa", F.coalesce("has_xfa", F.lit(False)))
        .withColumn("has_names_javascript", F.coalesce("has_names_javascript", F.lit(False)))
    )


def page_texts(w: Walk) -> DataFrame:
    """Shown text of the first pages: ``doc_id, page, text``."""
    shown = w.entries.where(F.col("kind") == "text").select(*_ID, F.col("value").alias("text"))
    first = w.pages.where(F.col("page") < w.limits.text_pages)
    parts = follow(first, w.edges, "/Contents").join(shown, _ID)
    return parts.groupBy("doc_id", "page").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]
            ),
            "",
        ).alias("text")
    )


def excerpts(w: Walk) -> DataFrame:
    return text_excerpts(page_texts(w))


def exhausted(rows: DataFrame, what: str, stage: str = "objects") -> DataFrame:
    """One error row per document of ``rows``: a limit was met."""
    return rows.select(
        "doc_id", F.lit(stage).alias("stage"), F.lit(f"{what} budget exhausted").alias("message")
    ).distinct()


def walk_limits_met(w: Walk) -> DataFrame:
    """Error rows of the documents whose trees, pages or annotations were not all taken."""
    out = exhausted(w.cut_trees, "tree walk")
    if w.limits.pages is not None:
        out = out.unionByName(exhausted(w.pages.where(F.col("page") >= w.limits.pages), "page walk"))
    if w.limits.annotations is not None:
        found = follow(walked_pages(w), w.edges, "/Annots")
        out = out.unionByName(exhausted(found.where(F.col("pos") >= w.limits.annotations), "annotation"))
    return out


def parse_errors(files: DataFrame, w: Walk, features: DataFrame) -> DataFrame:
    """Problems as rows: ``doc_id, stage, message``; nothing aborts the job."""
    unread = F.col("message").startswith("open failed")
    notes = (
        w.entries.where(F.col("kind") == "error")
        .select("doc_id", F.col("value").alias("message"))
        .select("doc_id", F.when(unread, "open").otherwise("objects").alias("stage"), "message")
    )
    known = w.roots.select("doc_id").unionByName(notes.where(unread).select("doc_id"))
    unresolved = files.select("doc_id").join(unbroadcast(known), "doc_id", "left_anti").select(
        "doc_id",
        F.lit("open").alias("stage"),
        F.lit("open failed: no resolvable catalog").alias("message"),
    )
    headless = features.where(~F.col("has_header")).select(
        "doc_id",
        F.lit("header").alias("stage"),
        F.lit("missing %PDF- header").alias("message"),
    )
    # What is encrypted is not decrypted: its strings and streams are read as they stand.
    locked = (
        w.entries.where((F.col("node") == "trailer") & (F.col("key") == "/Encrypt"))
        .select("doc_id", F.lit("open").alias("stage"), F.lit("encrypted: contents are not decrypted").alias("message"))
        .distinct()
    )
    parts = (notes, headless, locked, walk_limits_met(w))
    out = unresolved
    for part in parts:
        out = out.unionByName(part)
    return out
