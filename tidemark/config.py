"""Default knobs of the analyses. Weights, thresholds and lists that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

WEIGHTS = {
    "prs_merged": 3.0, "resolved": 1.5, "code_impact": 1.5, "prs_reviewed": 1.0, "prs_created": 0.5, "progressed": 0.5,
    "active_weeks": 0.5, "story_points": 0.5, "created": 0.25, "loc": 0.25, "commits": 0.0,
}
BOTS = ("*[bot]", "dependabot", "renovate", "github-actions", "claude*")
EXCLUDED_ROLES = ("qa", "exec", "excluded")
LONG_LIVED = ("master", "main", "development", "develop", "dev", "staging", "stage", "release/", "hotfix/", "production", "prod", "qa", "uat")
STATUS_RANK = {"To Do": 0, "In Progress": 1, "Code Review": 2, "Ready QA": 3, "In QA": 3, "Done": 4}
ACTIVE_STATUSES = ("In Progress", "Code Review")
QUEUE_STATUSES = ("To Do", "Ready QA")
QA_STATUSES = ("In QA",)
GENERATED_PATHS = ("*.lock", "package-lock.json", "*.min.js", "*/vendor/*", "*/node_modules/*", "*/generated/*", "*.snap")
DATA_EXTENSIONS = ("json", "csv", "tsv", "ndjson", "geojson", "parquet", "snap")
RISK_GLOBS = {"high": ("**/promo/**", "**/auth/**"), "medium": ("**/standard/**",)}
DOC_HINTS = ("confluence", "docs.google", "notion", "example.com")
SEED_TERMS = ("auth", "billing", "payment", "payments", "security", "migration", "crypto")


@dataclass(frozen=True)
class Impact:
    alpha: float = 1.0
    beta: float = 0.5
    gamma: float = 2.0
    deletion_weight: float = 1.0
    churn_floor: float = 0.5
    churn_full_at: int = 4
    bulk_loc: int = 5000
    bulk_add_ratio: float = 0.95
    bulk_files: int = 20
    bulk_weight: float = 0.25
    dump_weight: float = 0.0
    dump_share: float = 0.9
    dump_files: int = 50
    dump_ceiling: int = 2000
    family_members: int = 3
    family_cv: float = 0.25
    family_weight: float = 0.15
    family_token: int = 4
    cap_percentile: float = 0.99
    generated_weight: float = 0.25


@dataclass(frozen=True)
class Effort:
    spam_ratio: float = 1.5
    spam_slope: float = 0.25
    stuff_percentile: float = 0.9
    stuff_slope: float = 0.25
    floor: float = 0.5


@dataclass(frozen=True)
class Elo:
    start: float = 1000.0
    tiers: tuple = ((0, 32.0), (4, 28.0), (9, 28.0), (17, 30.0))
    fallback_k: float = 16.0
    idle_after: int = 3
    idle_step: float = 8.0
    provisional: int = 12
    provisional_loss: float = 0.5
    scale: float = 0.5
    deadzone: float = 0.75


@dataclass(frozen=True)
class Surge:
    recent: int = 2
    baseline: int = 8
    least: int = 3
    hot: float = 2.0
    rising: float = 1.2
    cooling: float = 0.8


@dataclass(frozen=True)
class Integration:
    reship: float = 3.0
    diversity: float = 2.0
    merges: float = 1.0
    no_review: float = 1.0
    key_shape: float = 1.0
    big_diff: float = 1.0
    long_ends: float = 1.5
    keyless: float = 2.0
    title: float = 0.5
    threshold: float = 0.5
    big_loc: int = 1000
    many_keys: int = 5
    factor: float = 0.25
    titles: tuple = ()

    @property
    def total(self) -> float:
        return self.reship + self.diversity + self.merges + self.no_review + self.key_shape + self.big_diff + self.long_ends + self.keyless + self.title


@dataclass(frozen=True)
class Band:
    scale: tuple = (1, 2, 3, 5, 8, 13)
    loc: int = 100
    cycle_days: float = 14.0
    short_low: float = 1.0
    short_high: float = 2.0
    long_low: float = 5.0
    long_high: float = 6.0
    rework: float = 2.0
    rounds: float = 1.0
    threads: float = 2.0
    high_risk: float = 2.0
    medium_risk: float = 1.0
    cross_repo: float = 1.0
    straddle: float = 0.15
    min_thinking: float = 1.0
    thinking_share: float = 0.5
    rework_cap: int = 3
    rounds_cap: int = 4
    small_diff: int = 20
    small_scale: float = 0.5
    split: float = 18.0
    benign_points: int = 8
    deletion_ratio: float = 0.8
    max_thinking: float = 0.0
    dwell_minutes: float = 5.0


@dataclass(frozen=True)
class Spike:
    cycle_days: float = 2.0
    artifacts: int = 2
    comment_cap: int = 3
    short_low: float = 1.5
    short_high: float = 3.0
    long_low: float = 3.0
    long_high: float = 5.0
    spawned: float = 0.5
    breadth: float = 0.25
    breadth_over: int = 3
