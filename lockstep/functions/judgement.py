"""What a path or a coupling is worth: noise, partner labels, evidence classes, and the sentences that say so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import THIN_SUPPORT
from ..sources.manifests import LOCK_FILES, MANIFEST_FILES
from .text import basename, directory

# Paths that describe a build or a release, and documentation or CI.
GENERATED_TREES = r"(^|/)(vendor|node_modules|third_party|dist|generated|gen|__pycache__)/|(_gen|\.pb|_auto_test)\.go$|\.min\.(js|css)$"
RELEASE_FILES = (
    r"(^|/)(CHANGELOG|CHANGES|HISTORY|VERSION|version|version\.txt)(\.(md|txt))?$|(^|/)\.release-please-manifest\.json$"
    r"|(^|/)(release-please-config|\.releaserc|\.versionrc|lerna)\.(json|js|ya?ml|cjs)$|(^|/)\.changeset/"
)
AUXILIARY = (
    r"(^|/)docs?/|(^|/)(README|CONTRIBUTING|SECURITY|CODE_OF_CONDUCT)(\.[a-z]+)?$|\.(md|mdx|rst)$"
    r"|(^|/)\.github/|(^|/)\.gitlab-ci\.ya?ml$|(^|/)Jenkinsfile$|(^|/)\.circleci/|(^|/)azure-pipelines\.ya?ml$|(^|/)\.buildkite/"
)
WORKSPACE_FILES = ("go.work", "go.work.sum")
# What marks a partner as generated.
GENERATED_FOLDERS = ("gen", "generated", "vendor", "node_modules", "mocks", ".gen", "dist", "__generated__")
GENERATED_PARTS = ("zz_generated", ".pb.go", "_pb2.py", ".gen.go", ".generated.", ".min.js", "embedded_spec.go", "swagger.json", "swagger.yaml", "openapi.json")
GENERATED_LOCKS = ("go.sum", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock")
GENERATED_HEADS = ("mock_", "mocks_")
# Thresholds.
STALE_AFTER_DAYS = 270
MIN_REPORTABLE_SUPPORT = 3
STRONG_SUPPORT, MODERATE_SUPPORT = 10, 5
GOOD_CONFIDENCE, GOOD_ASSOCIATION, GOOD_LIKELIHOOD = 0.5, 0.2, 2


def is_noise(path: Column) -> Column:
    """Manifests, lock files, generated trees and release files: they say nothing about how code is put together."""
    return basename(path).isin(*MANIFEST_FILES, *LOCK_FILES, *WORKSPACE_FILES) | path.rlike(GENERATED_TREES) | path.rlike(RELEASE_FILES)


def is_auxiliary(path: Column) -> Column:
    """Noise, or documentation and CI."""
    return is_noise(path) | path.rlike(AUXILIARY)


def partner_labels(path: Column, own: Column, n_ab: Column) -> tuple[Column, Column]:
    """(labels, informative) of the partner path of the file own."""
    base, low = basename(path), F.lower(basename(path))
    folders = F.split(F.lower(F.regexp_replace(path, "[^/]*$", "")), "/")
    generated = base.isin(*GENERATED_LOCKS) | F.arrays_overlap(folders, F.array(*map(F.lit, GENERATED_FOLDERS)))
    for part in GENERATED_PARTS:
        generated = generated | low.contains(part)
    for head in GENERATED_HEADS:
        generated = generated | low.startswith(head)
    stem = F.regexp_replace(basename(own), r"\.[^.]*$", "")
    own_test = F.lit(False)
    for head, tail in (("", "_test."), ("test_", "."), ("", ".test."), ("", ".spec.")):
        own_test = own_test | F.startswith(base, F.concat(F.lit(head), stem, F.lit(tail)))
    own_test = own_test & (stem != "")
    sibling = (base == basename(own)) & (base != "") & (directory(path) != directory(own))
    told = {"generated": generated, "own_test": own_test, "thin_support": n_ab < THIN_SUPPORT, "sibling_variant": sibling}
    return F.array_compact(F.array(*[F.when(c, name) for name, c in told.items()])), ~(generated | own_test) & (n_ab >= MIN_REPORTABLE_SUPPORT)


def evidence_card(support: Column, confidence: Column, npmi: Column, jaccard: Column, likelihood: Column, labels: Column, informative: Column) -> dict[str, Column]:
    """evidence, agreement, summary, and (grade, positive) to rank by; a null measure is no signal."""
    signals = [
        F.when(confidence.isNotNull(), confidence >= GOOD_CONFIDENCE),
        F.when(npmi.isNotNull() | jaccard.isNotNull(), (F.coalesce(npmi, F.lit(0.0)) >= GOOD_ASSOCIATION) | (F.coalesce(jaccard, F.lit(0.0)) >= GOOD_ASSOCIATION)),
        F.when(likelihood.isNotNull(), likelihood > GOOD_LIKELIHOOD),
    ]
    number = lambda x: x.cast("int")
    positive = sum((F.coalesce(number(s), F.lit(0)) for s in signals), F.lit(0))
    available = sum((number(s.isNotNull()) for s in signals), F.lit(0))
    strong, moderate = (support >= STRONG_SUPPORT) & (positive >= 2), (support >= MODERATE_SUPPORT) & (positive >= 1)
    grade = F.when(~informative | (support < MIN_REPORTABLE_SUPPORT), 0).when(strong, 2).when(moderate, 1).otherwise(0)
    agreement = F.when(available == 0, "insufficient signals").when((positive == available) | (positive == 0), "signals agree").otherwise("mixed signals")
    flagged = F.concat(F.lit("Flagged as "), F.replace(F.array_join(labels, ", "), F.lit("_"), F.lit(" ")), F.lit("; verify before editing."))
    summary = F.when(F.size(labels) > 0, flagged).when(~informative, "Likely structural noise; verify before editing.")
    summary = summary.when(grade == 2, "Strong evidence that this file is meaningfully related.").when(grade == 1, "Moderate evidence of a meaningful relationship.")
    evidence = F.when(grade == 2, "strong").when(grade == 1, "moderate").otherwise("weak")
    return {"evidence": evidence, "agreement": agreement, "summary": summary.otherwise("Limited evidence; treat this relationship cautiously."), "grade": grade, "positive": positive}


def currency(days: Column, trend: Column, deleted: Column) -> Column:
    """Whether a coupling still seems to hold, by days since the last common change."""
    since = days.cast("string")
    return (
        F.when(deleted, "DELETED -- this file no longer exists at HEAD. The coupling is historical; do not try to edit it. If the behaviour moved, find where it moved to.")
        .when(days > STALE_AFTER_DAYS, F.concat(F.lit("STALE -- last co-changed "), since, F.lit(" days ago; treat as historical, verify the path still exists")))
        .when(trend == "decaying", "DECAYING -- weaker lately than historically; likely a finished refactor")
        .when(trend == "emerging", "emerging -- stronger lately than historically")
        .when(days <= 30, F.concat(F.lit("current -- co-changed "), since, F.lit(" days ago")))
        .when(days.isNotNull(), F.concat(F.lit("co-changed "), since, F.lit(" days ago")))
    )


def confidence_sentence(confidence: Column, n_ab: Column) -> Column:
    share = F.concat(F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))
    thin = n_ab < THIN_SUPPORT
    hedge = F.when(thin, F.concat(F.lit(" (on "), n_ab.cast("string"), F.lit(" shared commits, so treat as provisional)"))).otherwise("")
    verdict = F.when(confidence >= 0.7, F.when(thin, "may need updating too").otherwise("very likely needs updating too")).when(confidence >= 0.4, "worth checking").otherwise("occasional")
    weak = F.concat(share, F.lit(" of the time, but on only "), n_ab.cast("string"), F.lit(" shared commits -- weak evidence"))
    said = F.concat(F.lit("changes together "), share, F.lit(" of the time -- "), verdict, hedge)
    return F.when(F.coalesce(confidence, F.lit(0.0)) == 0, "no directional signal").when(n_ab < MIN_REPORTABLE_SUPPORT, weak).otherwise(said)
