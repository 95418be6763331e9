from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quillseek import match
from quillseek.functions.kernel import WINDOW, Fuzzy, match_folded, merge_ranges, units
from quillseek.functions.text import fold, is_blank, number_text, strip_diacritics, trim


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def least_distance(pattern: str, text: str) -> int:
    return min([len(pattern)] + [levenshtein(pattern, text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)])


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=7), st.lists(st.text("ab cd", max_size=14), max_size=6), st.sampled_from([0.0, 0.3, 0.6, 1.0]))
def test_without_location_the_score_is_the_least_substring_distance(pattern, texts, threshold):
    matched, scores, _ = match_folded(texts, Fuzzy(pattern, ignore_location=True, threshold=threshold))
    for text, ok, score in zip(texts, matched, scores, strict=True):
        d = least_distance(pattern, text)
        if text == pattern:
            assert ok and score == 0
        else:
            assert ok == (d < len(pattern) and d / len(pattern) <= threshold)
            assert not ok or score == max(0.001, d / len(pattern))


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", min_size=1, max_size=6), st.lists(st.text("abc d", max_size=40), min_size=1, max_size=8), st.integers(0, 20), st.sampled_from([5, 20, 100]))
def test_texts_of_a_batch_do_not_influence_each_other(pattern, texts, location, distance):
    spec = Fuzzy(pattern, location=location, distance=distance, include_matches=True)
    together = match_folded(texts, spec)
    for i, t in enumerate(texts):
        alone = match_folded([t], spec)
        assert (together[0][i], together[1][i], together[2][i]) == (alone[0][0], alone[1][0], alone[2][0])


@settings(max_examples=40, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc d", max_size=700))
def test_text_beyond_the_reach_does_not_matter(pattern, text):
    spec = Fuzzy(pattern, location=3, threshold=0.5, distance=40)
    reach = spec.reach()
    whole, cut = match_folded([text], spec), match_folded([text[:reach]], spec)
    assert (whole[0][0], whole[1][0]) == (cut[0][0], cut[1][0])


def test_long_texts_are_searched_to_their_ends():
    text = "x" * (5 * WINDOW) + "needle" + "y" * 100
    for at in range(0, 2 * WINDOW, 37):
        matched, scores, _ = match_folded([text[at:]], Fuzzy("nedle", ignore_location=True, threshold=0.3))
        assert matched[0] and scores[0] == 1 / 5


def test_ranges():
    def ranges(pattern, text, **options):
        return match(pattern, text, include_matches=True, **options).get("indices")

    # Published examples of ranges.
    assert ranges("olympics", "olympic medical office") == [(0, 6), (8, 8)]
    assert ranges("AAA", "AA BB AAA BBB", ignore_location=True, threshold=0.001) == [(6, 8)]
    assert ranges("ab", "ab XX ab YY ab") == [(0, 1), (6, 7), (12, 13)]
    assert ranges("abc", "abxc") == [(0, 1), (3, 3)]
    assert ranges("test", "t te tes test tes te t") == [(9, 12)]
    assert ranges("test", "t te tes test tes te t", find_all_matches=True) == [(9, 12)]
    assert merge_ranges([(4, 5), (0, 1), (2, 2), (7, 8)]) == [(0, 2), (4, 5), (7, 8)]


def test_the_last_hit_decides_the_score():
    # At level 1 hits left of the accepted one are seen and not accepted; the score is that of the last of them.
    pattern = "bcdefghijklmnopqrstu"
    found = match(pattern, "x" * 8 + pattern + "zz", threshold=0.1)
    assert found["is_match"] and abs(found["score"] - 0.12) < 1e-12


def test_whole_text_and_shortest_match():
    assert match("abc", "ABC") == {"is_match": True, "score": 0.0}
    assert not match("ab", "ab", min_match_char_length=3)["is_match"]
    assert not match("", "abc")["is_match"]
    assert not match("", "")["is_match"]


def test_patterns_of_more_than_32_units():
    text = "the quick brown fox jumps over the lazy dog and runs away"
    assert match(text[:40], text, ignore_location=True, threshold=0)["score"] == 0.001
    half = match(text[:32] + "#" * 32, text, ignore_location=True, threshold=0)
    assert half["is_match"] and half["score"] == (0.001 + 1) / 2
    assert [(len(p), s) for p, s in Fuzzy("x" * 70).chunks] == [(32, 0), (32, 32), (32, 38)]


def test_units_beyond_the_basic_plane():
    assert len(units("a😀b")) == 4
    assert match("b", "😀b", include_matches=True)["indices"] == [(2, 2)]


def test_text_functions():
    assert strip_diacritics("Éléphant łódź straße") == "Elephant lodz strasse"
    assert fold("ÀB", False, True) == "ab" and fold("ÀB", True, False) == "ÀB"
    assert is_blank(" \t ﻿　") and not is_blank("\u0085") and trim("﻿ a \n") == "a"
    shown = {1.0: "1", 1e7: "10000000", 1e21: "1e+21", 1.5e-7: "1.5e-7", 123.456: "123.456", -0.0: "-0", 1e-6: "0.000001", 0.1: "0.1", -2.5: "-2.5", 5e-324: "5e-324", 123456789012345680000.0: "123456789012345680000"}
    assert {v: number_text(v) for v in shown} == shown
    assert [number_text(float(x)) for x in ("nan", "inf", "-inf")] == ["NaN", "Infinity", "-Infinity"] and number_text(None) is None
