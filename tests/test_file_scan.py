"""Whole files through the scan: expectations pinned per document kind."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import urlparse

import pytest
from documents import ALL, Writer
from pyspark.sql import functions as F

from papersieve.operators import evidence
from papersieve.operators import objects as og
from papersieve.operators import rules
from papersieve.operators.objects import Limits
from papersieve.plans.scan import scan_files
from papersieve.session import checkpoint_dir, once, staged

NAMES = list(ALL)


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, bytearray(ALL[n])) for i, n in enumerate(NAMES)]
    files = spark.createDataFrame(rows, "doc_id bigint, content binary")
    return scan_files(files)


@pytest.fixture(scope="module")
def outcome(scanned):
    return {NAMES[r.doc_id]: r for r in scanned.outcomes.collect()}


@pytest.fixture(scope="module")
def codes(scanned):
    found: dict[str, dict[str, int]] = {n: {} for n in NAMES}
    for r in scanned.indicators.collect():
        found[NAMES[r.doc_id]][r.code] = r.weight
    return found


def static_codes(codes, name):
    return {c: w for c, w in codes[name].items() if not c.startswith("YARA_")}


def test_benign_is_clean(outcome, codes):
    assert outcome["report"].score == 0
    assert outcome["report"].is_conclusive_clean
    assert codes["report"] == {}


def test_every_document_has_an_outcome(outcome):
    assert set(outcome) == set(NAMES)
    assert all(0 <= r.score <= 100 for r in outcome.values())


def test_document_level_script(codes):
    assert static_codes(codes, "tree_script") == {
        "PDF_JS_PRESENT": 30, "PDF_JS_AUTO_EXEC": 55, "PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT": 50,
    }


def test_open_action_script(outcome, codes):
    found = static_codes(codes, "exploit_script")
    assert found["PDF_JS_PRESENT"] == 30
    assert found["PDF_JS_AUTO_EXEC"] == 55
    assert found["PDF_JS_EXPLOIT_API"] == 85
    assert found["PDF_AUTO_ACTION"] == 15
    assert found["PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT"] == 50
    assert outcome["exploit_script"].verdict == "malicious"


def test_launch(outcome, codes):
    assert static_codes(codes, "program_start") == {
        "PDF_LAUNCH_ACTION": 85, "PDF_AUTO_ACTION": 15, "PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT": 50,
    }
    assert outcome["program_start"].score >= 75


def test_escaped_names_are_resolved(codes):
    assert "PDF_NAME_OBFUSCATION" in codes["hex_names"]
    assert "PDF_JS_AUTO_EXEC" in codes["hex_names"]
    assert "YARA_NAME_OBFUSCATION" in codes["hex_names"]


def test_interactive_form_stays_below_quarantine_without_signatures(codes):
    found = static_codes(codes, "order_form")
    assert "PDF_NAME_OBFUSCATION" not in found
    assert found["PDF_XFA_FORM"] == 0
    assert "PDF_MINIMAL_DOC_WITH_ACTIVE_CONTENT" not in found
    surviving = 1.0
    for weight in found.values():
        surviving *= 1 - weight / 100
    assert round(100 * (1 - surviving)) < 80


def test_phishing_link(scanned, codes):
    assert codes["lure"]["PDF_RISKY_URL"] == 25
    assert "YARA_CREDENTIAL_PHISH_LURE" in codes["lure"]
    urls = scanned.evidence.urls.where(f"doc_id = {NAMES.index('lure')}").collect()
    assert [(u.url, u.is_ip_literal, u.source) for u in urls] == [
        ("http://192.0.2.44/login", True, "action:/URI")
    ]


def test_embedded_executable(scanned, codes):
    assert codes["carrier"]["PDF_EMBEDDED_EXECUTABLE"] == 90
    assert "YARA_EMBEDDED_EXECUTABLE" in codes["carrier"]
    row = scanned.evidence.attachments.where(
        f"doc_id = {NAMES.index('carrier')}"
    ).first()
    assert (row.name, row.extension, row.magic_bytes) == ("setup.exe", ".exe", "dos/pe-executable")


def test_trailing_data_and_shifted_header(scanned, codes):
    features = {NAMES[r.doc_id]: r for r in scanned.features.collect()}
    assert features["tail_data"].eof_trailing_bytes > 4000
    assert "PDF_DATA_AFTER_EOF" in codes["tail_data"]
    assert features["late_header"].header_offset == 80
    assert {"PDF_HEADER_OFFSET", "YARA_HEADER_ANOMALY"} <= set(codes["late_header"])


def test_corrupt_is_reported_not_dropped(outcome, codes):
    assert static_codes(codes, "noise") == {"PDF_PARSE_FAILURE": 40}
    assert outcome["noise"].score == 40


@pytest.mark.parametrize(
    ("name", "code"),
    [("deflated", "var x = 1;"), ("redefined", "new();"), ("object_stream", "inner();"),
     ("chained", "var x = 1;")],
)
def test_script_text_is_recovered(scanned, name, code):
    rows = scanned.evidence.scripts.where(f"doc_id = {NAMES.index(name)}").collect()
    assert [(r.location, r.code) for r in rows] == [("/OpenAction", code)]


def test_annotation_actions(scanned):
    rows = scanned.evidence.scripts.where(f"doc_id = {NAMES.index('note_action')}").collect()
    assert [r.code for r in rows] == ["hover();"]


def test_damage_and_odd_bytes_are_rows(scanned, outcome):
    found: dict[str, list[str]] = {n: [] for n in NAMES}
    for r in scanned.evidence.errors.collect():
        found[NAMES[r.doc_id]].append(r.message)
    assert found["hostile octal"] == found["hostile long trailer"] == found["report"] == []
    assert found["hostile large number"] == found["hostile many digits"] == ["object number out of range"]
    assert found["hostile bad header"] == ["object stream without a usable header"]
    assert found["hostile unknown filter"] == ["unsupported stream filter /MysteryDecode"]
    assert found["cut_deflate"] == ["damaged deflate data"]
    where = f"doc_id = {NAMES.index('cut_deflate')}"
    code = scanned.evidence.scripts.where(where).first().code
    assert code.startswith("step0();step1();step2();") and len(code) > 500
    pages = {NAMES[r.doc_id]: r.page_count for r in scanned.evidence.structure.collect()}
    assert all(pages[n] == 1 for n in NAMES if n.startswith("hostile"))


def test_ordering_of_severity(outcome):
    scores = [outcome[n].score for n in ("report", "tree_script", "program_start")]
    assert scores == sorted(scores) and scores[0] < scores[1]


def test_evidence_never_carries_payloads(scanned):
    bundles = evidence.evidence_bundles(scanned)
    row = bundles.where(f"doc_id = {NAMES.index('carrier')}").first()
    assert "harmless filler" not in row.bundle
    assert row.tokens == int(len(row.bundle) / 3.6)


def test_scripts_are_cut_before_they_are_sorted(spark, capsys):
    """Sorting whole scripts took memory that followed the code of a task's rows."""
    rows = [(d, i, "/A", "x" * (300 * i), None if i == 5 else 0.1 * (i % 3)) for d in range(3) for i in range(9)]
    scripts = spark.createDataFrame(rows, "doc_id int, ord int, location string, code string, obfuscation_score double")
    scripts = scripts.withColumns({
        "length": F.length("code"), "truncated": F.lit(False),
        "suspicious_tokens": F.when(F.col("ord") != 7, F.array().cast("array<string>")),
    })
    sizes = spark.createDataFrame([(0, 0), (1, 6_000), (2, 8_900)], "doc_id int, bundle_chars int")
    fitted = evidence.fit_scripts(scripts, sizes, 9_000)
    placed = {(r.doc_id, r.place, r.ord, len(r.code), r.cut) for r in fitted.collect()}
    order = [8, 2, 4, 1, 7, 6]  # By score, tokens (a missing list counts least) and length; no score is last.
    assert placed == {
        (d, n, i, min(300 * i, most), 300 * i > most)
        for d, most in ((0, 1_500), (1, 500)) for n, i in enumerate(order, 1)
    }
    fitted.explain()
    assert "ShuffledHashJoin" in capsys.readouterr().out


def test_prompt_withholds_the_score_unless_asked(scanned):
    bundles = evidence.evidence_bundles(scanned)
    where = f"doc_id = {NAMES.index('exploit_script')}"
    plain = evidence.prompts(bundles).where(where).first().prompt
    told = evidence.prompts(bundles, share_score=True).where(where).first().prompt
    assert "Assessment by rules" not in plain
    assert "Assessment by rules" in told
    assert plain.startswith("## File\n") and "## Scripts in the file" in plain


def test_scripts_behind_long_ones_are_taken_and_a_budget_says_what_it_left_out(spark):
    w = Writer()
    w.script("var quiet = 1; " * 15_000, filters="Flate")
    late = w.put("<< /S /JavaScript /JS (eval\\(unescape\\('x'\\)\\);) >>")
    w.page(f"/AA << /O {late} 0 R >>")
    rows = [(0, bytearray(w.done())), (1, bytearray(ALL["report"])), (2, bytearray(ALL["deflated"]))]
    files = spark.createDataFrame(rows, "doc_id bigint, content binary")
    spent = "message = 'javascript extraction budget exhausted'"
    whole = scan_files(files)
    taken = {(r.doc_id, len(r.code), r.truncated) for r in whole.evidence.scripts.collect()}
    assert taken == {(0, 225_000, False), (0, 20, False), (2, 10, False)}
    assert whole.evidence.errors.where(spent).count() == 0
    capped = scan_files(files, limits=Limits(script_chars=200_000))
    taken = {(r.doc_id, len(r.code), r.truncated) for r in capped.evidence.scripts.collect()}
    assert taken == {(0, 200_000, True), (2, 10, False)}
    assert [r.doc_id for r in capped.evidence.errors.where(spent).collect()] == [0]


def test_findings_are_not_broadcast(scanned, capsys):
    """Findings repeat themselves: files of a few MB may unpack to what fills a driver."""
    w = scanned.walk
    for rows in (
        scanned.evidence.errors, scanned.outcomes, og.actions(w), og.attachments(w), og.metadata(w),
        og.structure_flags(w), og.uri_targets(w), evidence.evidence_bundles(scanned),
    ):
        rows.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_staged_rows_are_joined_by_merging(spark, capsys):
    small = staged(spark.range(1000).withColumn("same", F.lit("x" * 1000)))
    for rows in (
        spark.range(1000).join(small, "id"),
        spark.range(1000).join(small.groupBy("id").count(), "id", "left"),
    ):
        rows.explain()
        assert "SortMergeJoin" in capsys.readouterr().out


def test_plans_of_findings_stay_short(scanned, capsys):
    """What the driver holds while it plans follows the joins of a plan; shared steps are staged."""
    for rows, most in (
        (scanned.evidence.errors, 0), (og.actions(scanned.walk), 6), (scanned.walk.trees, 0),
        (og.recorded_kinds(scanned.walk), 1), (og.script_findings(scanned.walk), 4),
    ):
        rows.explain()
        assert capsys.readouterr().out.count("SortMergeJoin") <= most


def test_a_finding_runs_only_the_steps_it_comes_from(spark):
    """The driver's memory follows the number of plans too: what is not asked for is not run."""
    files = spark.createDataFrame([(i, bytearray(ALL[n])) for i, n in enumerate(NAMES)], "doc_id bigint, content binary")
    folder = Path(urlparse(checkpoint_dir(spark)).path)
    written = lambda: set(folder.glob("staged-*"))
    before = written()
    scan = scan_files(files)
    assert written() == before
    og.metadata(scan.walk)
    assert len(written() - before) == 3  # Entries, edges and catalogs.
    assert scan.judged.summary("attachments").count() > 0
    assert not {"scripts", "actions", "urls", "structure", "read"} & set(vars(scan))
    before = written()
    og.metadata(scan.walk), scan.judged.summary("attachments")
    assert written() == before


def test_rules_on_bytes_need_no_object_graph(spark):
    """Rules that read what one pass over the bytes gives walked every file's objects."""
    files = spark.createDataFrame([(i, bytearray(ALL[n])) for i, n in enumerate(NAMES)], "doc_id bigint, content binary")
    folder = Path(urlparse(checkpoint_dir(spark)).path)
    codes = {
        "PDF_NAME_OBFUSCATION", "PDF_MANY_INCREMENTAL_UPDATES", "PDF_DATA_AFTER_EOF", "PDF_HEADER_OFFSET",
        "PDF_JBIG2_FILTER",
    }
    before = set(folder.glob("staged-*"))
    scan = scan_files(files)
    for rule in [r for r in rules.BUNDLED if r.code in codes]:
        rules.apply_rules(scan.judged.summary(rule.source), [(1, rule)]).count()
    assert len(set(folder.glob("staged-*")) - before) == 1
    assert "walk" not in vars(scan)


def test_what_is_made_once_is_made_once_by_threads():
    class Held:
        made = 0

        @once
        def table(self):
            time.sleep(0.05)
            self.made += 1
            return self.made

    held = Held()
    with ThreadPoolExecutor(4) as pool:
        assert [f.result() for f in [pool.submit(lambda: held.table) for _ in range(4)]] == [1] * 4
