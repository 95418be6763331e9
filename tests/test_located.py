"""The approximate matcher with places and ranges against a slow one, text by text and letter by letter."""

from __future__ import annotations

import itertools
import random

import pytest

from quillseek import match


def cost(errors, place, expected, length, distance, ignore_location):
    if ignore_location:
        return errors / length
    if distance == 0:
        return 1.0 if place != expected else errors / length
    return errors / length + abs(expected - place) / distance


def suffixes(pattern, text, place, after, level_below, errors):
    """The lengths of the pattern's ends that match from a place on with so many errors, given those from the place after it (`after`) and those
    with one error less at both places (`level_below`: here, after)."""
    m = len(pattern)
    char = text[place] if place < len(text) else None
    found = {k + 1 for k in after | {0} if k < m and pattern[m - 1 - k] == char}
    if errors:
        here, behind = level_below
        found |= {k + 1 for k in here | behind | {0} if k < m}  # a letter missing or another one
        found |= behind  # a letter too many
    return found


def slow(pattern, text, threshold=0.6, location=0, distance=100, ignore_location=False, find_all=False, least=1):
    """is_match, score and ranges."""
    m, n = len(pattern), len(text)
    if pattern == text:
        return (True, 0.0, [(0, n - 1)]) if m >= least else (False, 1.0, [])
    expected, limit = max(0, min(location, n)), threshold
    marks, at = [False] * n, text.find(pattern, expected)
    while at >= 0:
        limit = min(limit, cost(0, at, expected, m, distance, ignore_location))
        marks[at : at + m] = [True] * m
        at = text.find(pattern, at + m)
    best, score, errors_of_best, reach, below = None, 1.0, 0, n + m, {}
    for errors in range(m):
        low, mid = 0, reach
        high = reach
        while low < mid:  # the farthest place that may still be good enough
            if cost(errors, expected + mid, expected, m, distance, ignore_location) <= limit:
                low = mid
            else:
                high = mid
            mid = (high - low) // 2 + low
        reach = mid
        stop, end = max(1, expected - mid + 1), n if find_all else min(expected + mid, n) + m
        level = {end: {k for k in range(1, errors + 1)}}  # so many letters may be missing at the end
        place = end - 1
        while place >= stop - 1:
            level[place] = suffixes(pattern, text, place, level[place + 1], (below.get(place, set()), below.get(place + 1, set())), errors)
            if m in level[place]:
                score = cost(errors, place, expected, m, distance, ignore_location)
                if score <= limit:
                    limit, best, errors_of_best = score, place, errors
                    if place <= expected:
                        break
                    stop = max(1, 2 * expected - place)
            place -= 1
        if cost(errors + 1, expected, expected, m, distance, ignore_location) > limit:
            break
        below = level
    if best is not None:
        for i in range(best, min(n, best + m + errors_of_best)):
            marks[i] = marks[i] or text[i] in pattern
    runs = [(k, len(list(g))) for k, g in itertools.groupby(marks)]
    ranges, at = [], 0
    for marked, length in runs:
        if marked and length >= least:
            ranges.append((at, at + length - 1))
        at += length
    matched = best is not None and bool(ranges)
    return matched, max(0.001, score) if matched else 1.0, ranges if matched else []


def cases():
    rng = random.Random(17)
    for _ in range(1500):
        pattern = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30)))
        if rng.random() < 0.5:
            place = rng.randint(0, len(text))
            near = list(pattern)
            if rng.random() < 0.6:
                near[rng.randrange(len(near))] = rng.choice(["", "d", "ab"])
            text = text[:place] + "".join(near) + text[place:]
        yield pattern, text, {
            "threshold": rng.choice([0.0, 0.2, 0.34, 0.5, 0.6, 1.0]), "location": rng.choice([0, 0, 3, 10, 40]), "distance": rng.choice([0, 4, 20, 100]),
            "ignore_location": rng.random() < 0.3, "find_all": rng.random() < 0.3, "least": rng.choice([1, 1, 2, 3]),
        }


def test_all_options_against_the_slow_matcher():
    matches = 0
    for pattern, text, options in cases():
        expected = slow(pattern, text, **options)
        plain = {k: v for k, v in options.items() if k not in ("find_all", "least")}
        got = match(pattern, text, is_case_sensitive=True, include_matches=True, find_all_matches=options["find_all"], min_match_char_length=options["least"], **plain)
        found = got["is_match"], got["score"] if got["is_match"] else 1.0, got.get("indices", [])
        assert (found[0], found[2]) == (expected[0], expected[2]) and found[1] == pytest.approx(expected[1], abs=1e-12), (pattern, text, options)
        without = match(pattern, text, is_case_sensitive=True, find_all_matches=options["find_all"], min_match_char_length=options["least"], **plain)
        assert without["is_match"] == got["is_match"] and without["score"] == pytest.approx(got["score"], abs=1e-12), (pattern, text, options)
        matches += found[0]
    assert 300 < matches < 1400
