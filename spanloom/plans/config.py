"""Versioned scoring parameters, their validation and their identity."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from .errors import InvalidRequest

# Fixed values of the first algorithm.
ALGORITHM, TOKENIZER, NORMALIZATION = "1.1.0", "1.0.0", "1.0.1"
LEVELS = ("letter_exact", "exact_spelling", "normalized")
WEIGHTS = {"jaccard": 0.4, "phrase": 0.2, "rare": 0.15, "order": 0.1, "capitalization": 0.1, "crossReference": 0.05}
PHRASE_MULTIPLIERS = {"caseExact": 1, "caseFolded": 0.8, "normalized": 0.5}
CAPITALIZATION = {"identical": 1, "identicalSentenceStart": 0.5, "differentOnlySentenceStart": 0.25, "different": 0}
TIE_BREAK = ["score_desc", "phrase_desc", "rare_desc", "jaccard_desc", "cross_reference_desc", "canonical_order_asc"]
#: The last book of the first testament.
TESTAMENT_CUT = 39
MOST = 500


@dataclass(frozen=True)
class ScoringConfig:
    match_level: str = "exact_spelling"
    phrase_cap: float = 25
    rare_cap: float = 12
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    phrase_multipliers: dict = field(default_factory=lambda: dict(PHRASE_MULTIPLIERS))
    #: Factors of a token's weight, by normalized form; tokens not named have 1.
    token_multipliers: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.match_level not in LEVELS:
            raise InvalidRequest(f"match level is one of {', '.join(LEVELS)}")
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise InvalidRequest("the weights sum to 1")
        if self.phrase_cap <= 0 or self.rare_cap <= 0:
            raise InvalidRequest("caps are positive")
        if not all(0 <= x <= 1 for x in self.phrase_multipliers.values()):
            raise InvalidRequest("phrase multipliers are between 0 and 1")

    def sha256(self, rare_threshold: int, tokenizer: str = "1.0.0", algorithm: str = ALGORITHM) -> str:
        return stable_sha256(
            {
                "algorithmVersion": algorithm,
                "phraseCap": self.phrase_cap,
                "rareCap": self.rare_cap,
                "rareThresholdPercentile": 20,
                "rareThreshold": rare_threshold,
                "matchLevel": self.match_level,
                "phraseLevelMultipliers": self.phrase_multipliers,
                "capitalizationPositionMultipliers": CAPITALIZATION,
                "weights": self.weights,
                "roundingDecimalPlaces": 6,
                "tokenizerVersion": tokenizer,
                "normalizationVersion": NORMALIZATION,
                "tieBreakOrder": TIE_BREAK,
            }
        )


def stable_json(value) -> str:
    """JSON with sorted keys and no blanks; whole numbers print as such."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stable_sha256(value) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def limit(value: int | None, default: int | None, most: int = MOST) -> int | None:
    """How many rows to give: what was asked for up to `most`, or else the default."""
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise InvalidRequest("a limit is a positive integer")
    return min(value, most)


def within(name: str, value: int, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise InvalidRequest(f"{name} is an integer from {low} to {high}")
    return value
