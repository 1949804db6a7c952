"""Schemas of the tables that operators take and make, declared once and never inferred."""

from __future__ import annotations

COMMITS = "repo string, commit_id long, author_id long, committed_at timestamp, is_merge boolean, is_replay boolean, n_files long"
CHANGES = "repo string, commit_id long, file_id long, insertions double, deletions double, change_type string"
FILES = "repo string, file_id long, path string"
CALLS = "id long, at timestamp, surface string, name string, status string, duration_ms double, client string"
BUMPS = "id long, consumer string, dep string, consumer_at timestamp, upstream_at timestamp, version string, tier string"
DECLARED = "consumer string, dep string, manifest string"

#: What changes answers: the defaults of the operators.
MAX_FILES_PER_COMMIT = 60
MIN_PAIR_SUPPORT = 2
HALF_LIFE_DAYS = 365
DEFAULT_LIMIT, MAX_LIMIT = 50, 1000
LABEL_ROUNDS, CLUSTER_MIN_SUPPORT, DRIFT_WINDOW_DAYS, RISK_EVIDENCE = 10, 3, 365, 25
MAX_FILES_PER_SIDE, MAX_PAIRS_PER_BUMP = 200, 5000
WARMUP_COMMITS, MAX_FILES_PER_PROMPT, MIN_PROMPTS = 20, 25, 300
KEEP_DAYS, KEEP_ROWS = 30, 200_000
THIN_SUPPORT = 5


def clamp_limit(limit: int | None, most: int = MAX_LIMIT) -> int:
    return DEFAULT_LIMIT if limit is None else max(1, min(int(limit), most))
