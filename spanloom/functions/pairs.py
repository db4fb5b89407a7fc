"""The evidence between two verses, from the arrays of their feature rows. Plain Python, for Arrow batches.

A verse is a mapping with equally long lists: surface, folded, normalized, df (of the normalized
form) and starts (whether a token begins a sentence).
"""

from __future__ import annotations

import math
from collections import defaultdict

EPSILON = 2.220446049250313e-16


def round6(x: float) -> float:
    return math.floor((x + EPSILON) * 1e6 + 0.5) / 1e6


def clamp(x: float) -> float:
    return min(1.0, max(0.0, x))


def match_keys(verse, level: str) -> list[str]:
    return verse[{"letter_exact": "surface", "exact_spelling": "folded", "normalized": "normalized"}[level]]


def common_runs(a: list, b: list, least: int = 2) -> list[tuple[int, int, int]]:
    """(length, i, j) of every pair of places from which `least` or more equal tokens follow, each run to its end.

    Run lengths are filled in from the back, and only where tokens are equal.
    """
    places = defaultdict(list)
    for j, token in enumerate(b):
        places[token].append(j)
    later: dict[int, int] = {}
    runs = []
    for i in range(len(a) - 1, -1, -1):
        here = {j: later.get(j + 1, 0) + 1 for j in places.get(a[i], ())}
        runs += [(n, i, j) for j, n in here.items() if n >= least]
        later = here
    return runs


def disjoint(runs: list[tuple], order) -> list[tuple]:
    """Runs taken greedily in an order, none touching a place of either side that is taken; by place in a."""
    used_a, used_b, taken = set(), set(), []
    for run in sorted(runs, key=order):
        n, i, j = run[:3]
        at_a, at_b = range(i, i + n), range(j, j + n)
        if used_a.isdisjoint(at_a) and used_b.isdisjoint(at_b):
            used_a.update(at_a)
            used_b.update(at_b)
            taken.append(run)
    return sorted(taken, key=lambda r: r[1])


def align(a: list, b: list, allowed: set) -> list[tuple[int, int]]:
    """From left to right, each allowed token of a with its first place in b behind the last one taken."""
    places = defaultdict(list)
    for j, token in enumerate(b):
        places[token].append(j)
    cursor, out, seen = 0, [], defaultdict(int)
    for i, token in enumerate(a):
        if token not in allowed:
            continue
        at = places.get(token, ())
        k = seen[token]
        while k < len(at) and at[k] < cursor:
            k += 1
        seen[token] = k
        if k < len(at):
            out.append((i, at[k]))
            cursor = at[k] + 1
    return out


def common_phrases(source, target, config) -> tuple[list[dict], float]:
    """The phrases of both verses and the component that they make."""
    phrases = []
    for length, i, j in disjoint(common_runs(match_keys(source, config.match_level), match_keys(target, config.match_level)), lambda r: (-r[0], r[1], r[2])):
        level = next(
            (name for layer, name in (("surface", "case_exact"), ("folded", "case_folded")) if source[layer][i : i + length] == target[layer][j : j + length]),
            "normalized",
        )
        factor = config.phrase_multipliers[{"case_exact": "caseExact", "case_folded": "caseFolded"}.get(level, "normalized")]
        phrases.append({"tokens": source["surface"][i : i + length], "source_start": i, "target_start": j, "level": level, "multiplier": float(factor)})
    return phrases, clamp(sum((len(p["tokens"]) ** 2 * p["multiplier"] for p in phrases), 0.0) / config.phrase_cap)


def score_pair(source, target, config, n: int, rare_threshold: int, cross_reference: bool = False) -> dict:
    """Score, components and evidence of target for source; see the fields of operators.related.EXPLANATION."""
    a, b = match_keys(source, config.match_level), match_keys(target, config.match_level)
    words_a, words_b = dict.fromkeys(a), dict.fromkeys(b)
    shared = [w for w in words_a if w in words_b]
    form, df = {}, {}
    for verse, keys in ((source, a), (target, b)):
        for key, norm, d in zip(keys, verse["normalized"], verse["df"]):
            form[key] = norm
            df[norm] = d
    frequency = lambda norm: df.get(norm, n)
    idf = lambda d: math.log((n + 1) / (d + 1)) + 1

    def weight(token: str) -> float:
        norm = form.get(token, token)
        return idf(frequency(norm)) * config.token_multipliers.get(norm, 1)

    w_union = sum((weight(w) for w in dict.fromkeys([*words_a, *words_b])), 0.0)
    jaccard = clamp(sum((weight(w) for w in shared), 0.0) / w_union) if w_union else 0.0

    phrases, phrase = common_phrases(source, target, config)

    rare_tokens = [(w, frequency(form[w])) for w in shared if frequency(form[w]) <= rare_threshold]
    rare = clamp(sum((idf(d) for _, d in rare_tokens), 0.0) / config.rare_cap)

    weighty = {w for w in shared if weight(w) > 0}
    pairs = align(a, b, weighty)
    order = _order(pairs, len(weighty), len(a), len(b))
    evidence = [_aligned(source, target, a[i], i, j, weight(source["normalized"][i])) for i, j in pairs]
    w_case = sum((e["weight"] for e in evidence), 0.0)
    capitalization = clamp(sum((e["weight"] * e["multiplier"] for e in evidence), 0.0) / w_case) if w_case else 0.0
    cross = 1.0 if cross_reference else 0.0
    parts = {"jaccard": jaccard, "phrase": phrase, "rare": rare, "order": order, "capitalization": capitalization, "crossReference": cross}
    total = 0.0
    for name, value in parts.items():
        total += config.weights[name] * value
    tiers = [p["level"] for p in phrases]
    reasons = ["shared_nonzero_token"] if weighty else []
    for tier, reason in (("case_exact", "shared_exact_phrase"), ("case_folded", "shared_case_folded_phrase"), ("normalized", "shared_normalized_phrase")):
        if tier in tiers:
            reasons.append(reason)
            break
    if cross:
        reasons.append("configured_cross_reference")
    return {
        "score": round6(total),
        "components": {
            "jaccard": round6(jaccard), "phrase": round6(phrase), "rare": round6(rare), "ordering": round6(order),
            "capitalization": round6(capitalization), "cross_reference": cross,
        },
        "matched_tokens": evidence and [{k: e[k] for k in ("token", "source_position", "target_position", "source_surface", "target_surface", "level")} for e in evidence],
        "matched_surfaces": list(dict.fromkeys(e["source_surface"] for e in evidence if e["level"] == "case_exact")),
        "matched_normalized": shared,
        "phrases": phrases,
        "capitalization": [
            {"token": e["token"], "source_position": e["source_position"], "target_position": e["target_position"],
             "multiplier": e["multiplier"], "weight": round6(e["weight"]), "reason": e["reason"]}
            for e in evidence
        ],
        "rare_tokens": [{"token": w, "document_frequency": d, "idf": round6(idf(d))} for w, d in rare_tokens],
        "reasons": reasons,
    }


def _order(pairs: list[tuple[int, int]], shared: int, len_a: int, len_b: int) -> float:
    """How many shared words keep their order, less where their distances differ."""
    if not shared or not pairs:
        return 0.0
    span_a, span_b = max(1, len_a - 1), max(1, len_b - 1)
    apart = [abs((i - p) / span_a - (j - q) / span_b) for (p, q), (i, j) in zip(pairs, pairs[1:])]
    mean = sum(apart, 0.0) / len(apart) if apart else 0.0
    return clamp(len(pairs) / shared * (1 / (1 + mean)))


def _aligned(source, target, token: str, i: int, j: int, weight: float) -> dict:
    one, other = source["surface"][i], target["surface"][j]
    folded = source["folded"][i] == target["folded"][j]
    starts = bool(source["starts"][i]), bool(target["starts"][j])
    if one == other:
        level = "case_exact"
        multiplier, reason = (0.5, "identical_sentence_start") if any(starts) else (1.0, "identical")
    else:
        level = "normalized" if not folded and source["normalized"][i] == target["normalized"][j] else "case_folded"
        only = folded and starts[0] != starts[1]
        multiplier, reason = (0.25, "different_only_sentence_start") if only else (0.0, "different")
    return {
        "token": token, "source_position": i, "target_position": j, "source_surface": one, "target_surface": other,
        "level": level, "multiplier": multiplier, "weight": weight, "reason": reason,
    }
