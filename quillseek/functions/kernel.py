"""Approximate matching of one pattern against many texts at once.

The matcher is the bit-parallel one of Wu and Manber with a window around the expected location and a threshold
that tightens.  All texts of a batch go through it together: a state is an array with one entry per text, a step
handles one position of all texts, and texts drop out as they are decided.  Positions are UTF-16 units.

Without a location the answer is the least edit distance to any substring, so long texts are cut into overlapping
windows there, and windows are what a batch holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pattern units that one state word holds.
WIDTH = 32
#: Entries of a state matrix, at most about.
CELLS = 2_000_000
#: Length of the windows that long texts are cut into when their location doesn't matter.
WINDOW = 256
FLOOR = 0.001


@dataclass(frozen=True)
class Fuzzy:
    """A folded pattern and the options that matter here."""

    pattern: str
    location: int = 0
    threshold: float = 0.6
    distance: float = 100
    find_all_matches: bool = False
    min_match_char_length: int = 1
    include_matches: bool = False
    ignore_location: bool = False

    @property
    def chunks(self) -> list[tuple[str, int]]:
        """The parts of a pattern and where they start; the last part of a long one overlaps its neighbour."""
        p = units(self.pattern)
        if len(p) <= WIDTH:
            return [(p, 0)] if p else []
        starts = list(range(0, len(p) - len(p) % WIDTH, WIDTH))
        if len(p) % WIDTH:
            starts.append(len(p) - WIDTH)
        return [(p[s : s + WIDTH], s) for s in starts]

    def most_errors(self, length: int) -> int:
        """How many errors a part of this length may have at its expected place."""
        errors = [e for e in range(length) if e / length <= self.threshold]
        return errors[-1] if errors else -1

    def pieces(self) -> list[str] | None:
        """Strings of which every folded text that matches has one; None if that can't be said.

        With k errors one of k + 1 pieces of a pattern is in the text as it is.
        """
        out: list[str] = []
        for part, _ in self.chunks:
            k = self.most_errors(len(part))
            if k + 1 > max(1, len(part) // 2) or any("\ud800" <= c <= "\udfff" for c in part):
                return None
            cuts = [len(part) * i // (k + 1) for i in range(k + 2)] if k >= 0 else []
            out += [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return list(dict.fromkeys([*out, self.pattern]))

    def reach(self) -> int | None:
        """How many units of a text can matter; None if all can."""
        if self.ignore_location or self.include_matches or self.find_all_matches or self.min_match_char_length > 1 or self.distance <= 0:
            return None
        ahead = int(max(self.threshold, 0) * self.distance) + WIDTH + 2
        return max([len(units(self.pattern)) + 1, *(max(0, self.location + start) + ahead + WIDTH for _, start in self.chunks)])


def units(text: str) -> str:
    """The UTF-16 units of a text as characters."""
    if text.isascii() or max(text) < "\U00010000":
        return text
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    return "".join(map(chr, raw.tolist()))


def _score(errors, gap, length: int, distance: float, ignore_location: bool):
    accuracy = errors / length
    if ignore_location:
        return np.full(np.shape(gap), accuracy)
    if not distance:
        return np.where(gap != 0, 1.0, accuracy)
    return accuracy + gap / distance


def _alphabet(texts: list[str], pattern: str, width: int) -> np.ndarray:
    """Bit masks of the pattern places that hold each text's units: (width, texts)."""
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << (len(pattern) - 1 - i)
    table = np.zeros(1 << 16, np.uint32)
    for c, b in bits.items():
        table[ord(c)] = b
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.arange(width)[:, None] < lengths[None, :]
    masks = np.zeros((len(texts), width), np.uint32)
    masks[inside.T] = table[np.frombuffer("".join(texts).encode("utf-16-le", "surrogatepass"), "<u2")]
    return np.ascontiguousarray(masks.T)


def _occurrences(text: str, pattern: str, start: int) -> list[int]:
    out, at = [], text.find(pattern, start)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + len(pattern))
    return out


@dataclass
class _Found:
    best: np.ndarray
    score: np.ndarray
    errors: np.ndarray


def _scan(texts: list[str], hits: list[list[int]], pattern: str, spec: Fuzzy, location: int) -> _Found:
    """Best location (-1: none), last score and errors for texts of similar length."""
    m, rows = len(pattern), len(texts)
    n = np.fromiter(map(len, texts), np.int64, rows)
    width = int(n.max(initial=0))
    masks = _alphabet(texts, pattern, width)
    expected = np.clip(location, 0, n)
    score = lambda errors, gap: _score(errors, gap, m, spec.distance, spec.ignore_location)
    limit = np.full(rows, float(spec.threshold))
    for r, places in enumerate(hits):
        if places:
            limit[r] = min(limit[r], score(0, np.abs(np.array(places) - expected[r])).min())
    out = _Found(np.full(rows, -1), np.ones(rows), np.zeros(rows, np.int64))
    reach = n + m
    top = np.uint32(1 << (m - 1))
    one = np.uint32(1)
    live = np.arange(rows)
    last = None
    for errors in range(m):
        # How far from the expected place a match with so many errors may be: bisection for all texts.
        low, high, mid = np.zeros(len(live), np.int64), reach[live].copy(), reach[live].copy()
        while (todo := low < mid).any():
            near = score(errors, mid) <= limit[live]
            low = np.where(todo & near, mid, low)
            high = np.where(todo & ~near, mid, high)
            mid = np.where(todo, (high - low) // 2 + low, mid)
        reach[live] = mid
        begin = np.maximum(1, expected[live] - mid + 1)
        end = n[live] if spec.find_all_matches else np.minimum(expected[live] + mid, n[live]) + m
        state = np.zeros((width + m + 3, len(live)), np.uint32)
        state[end + 1, np.arange(len(live))] = (1 << errors) - 1
        # Texts that start at the same place step together; `begin` moves up as matches are found.
        for j in range(int(end.max(initial=0)), 0, -1):
            on = (j <= end) & (j >= begin)
            if not on.any():
                if (begin > j).all():
                    break
                continue
            at = masks[j - 1][live] if j <= width else np.uint32(0)
            x = ((state[j + 1] << one) | one) & at
            if errors:
                right = last[j + 1]
                x = x | (((right | last[j]) << one) | one | right)
            state[j] = np.where(on, x, state[j])
            hit = on & ((x & top) != 0)
            if hit.any():
                which = np.flatnonzero(hit)
                rowsids = live[which]
                got = score(errors, np.abs(expected[rowsids] - (j - 1)))
                out.score[rowsids] = got
                better = got <= limit[rowsids]
                which, rowsids = which[better], rowsids[better]
                limit[rowsids] = got[better]
                out.best[rowsids] = j - 1
                out.errors[rowsids] = errors
                passed = j - 1 <= expected[rowsids]
                begin[which] = np.where(passed, width + m + 3, np.maximum(1, 2 * expected[rowsids] - (j - 1)))
        more = score(errors + 1, np.zeros(len(live))) <= limit[live]
        if not more.any():
            break
        live, last = live[more], state[:, more]
    return out


def _batches(texts: list[str], extra: int):
    """Index arrays of texts of similar length whose states fit in CELLS."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    start = 0
    for k, i in enumerate(order):
        if (k + 1 - start) * (len(texts[i]) + extra) > CELLS and k > start:
            yield order[start:k]
            start = k
    if start < len(order):
        yield order[start:]


def _ranges(mask: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(a, b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= shortest]


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _chunk(texts: list[str], pattern: str, start: int, spec: Fuzzy) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Whether and how well each text matches one part of the pattern."""
    location = spec.location + start
    matched, scores = np.zeros(len(texts), bool), np.ones(len(texts))
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    marks = spec.include_matches or spec.min_match_char_length > 1
    letters = set(pattern)
    for some in _batches(texts, len(pattern) + 3):
        part = [texts[i] for i in some]
        hits = [_occurrences(t, pattern, max(0, min(location, len(t)))) for t in part]
        found = _scan(part, hits, pattern, spec, location)
        matched[some] = found.best >= 0
        scores[some] = np.maximum(FLOOR, found.score)
        if marks:
            for k, i in enumerate(some):
                t, mask = part[k], np.zeros(len(part[k]), bool)
                for h in hits[k]:
                    mask[h : h + len(pattern)] = True
                if (best := int(found.best[k])) >= 0:
                    for p in range(best, min(len(t) - 1, best + len(pattern) - 1 + int(found.errors[k])) + 1):
                        mask[p] |= t[p] in letters
                ranges[i] = _ranges(mask, spec.min_match_char_length)
                matched[i] = matched[i] and bool(ranges[i])
    return matched, scores, ranges


def _anywhere(texts: list[str], pattern: str, spec: Fuzzy) -> tuple[np.ndarray, np.ndarray]:
    """As `_chunk` without a location or ranges: long texts as windows that overlap by all that a match can span."""
    overlap = 2 * len(pattern)
    owner, windows = [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - overlap), WINDOW):
            owner.append(i)
            windows.append(t[a : a + WINDOW + overlap])
    matched, scores, _ = _chunk(windows, pattern, 0, spec)
    any_match = np.zeros(len(texts), bool)
    best = np.ones(len(texts))
    np.logical_or.at(any_match, owner, matched)
    np.minimum.at(best, owner, np.where(matched, scores, 1.0))
    return any_match, best


def match_folded(texts: list[str], spec: Fuzzy) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Whether each folded text matches, its score (lower is better) and its ranges if they are wanted."""
    texts = [units(t) for t in texts]
    whole = units(spec.pattern)
    matched, scores = np.zeros(len(texts), bool), np.ones(len(texts))
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    equal = np.fromiter((t == whole for t in texts), bool, len(texts))
    for i in np.flatnonzero(equal):
        if len(whole) >= spec.min_match_char_length:
            matched[i], scores[i] = True, 0.0
            if spec.include_matches:
                ranges[i] = [(0, len(whole) - 1)]
    rest = np.flatnonzero(~equal)
    chunks = spec.chunks
    if not len(rest) or not chunks:
        return matched, scores, ranges
    if (pieces := spec.pieces()) is not None:
        rest = rest[np.fromiter((any(p in texts[i] for p in pieces) for i in rest), bool, len(rest))]
        if not len(rest):
            return matched, scores, ranges
    others = [texts[i] for i in rest]
    plain = spec.ignore_location and not spec.include_matches and spec.min_match_char_length <= 1
    total, hit = np.zeros(len(rest)), np.zeros(len(rest), bool)
    for pattern, start in chunks:
        if plain:
            ok, score = _anywhere(others, pattern, spec)
            found: list[list[tuple[int, int]]] = []
        else:
            ok, score, found = _chunk(others, pattern, start, spec)
        total += score
        hit |= ok
        for k, r in enumerate(found):
            if ok[k]:
                ranges[rest[k]].extend(r)
    matched[rest] = hit
    scores[rest] = np.where(hit, total / len(chunks), 1.0)
    if spec.include_matches:
        for k, i in enumerate(rest):
            ranges[i] = merge_ranges(ranges[i]) if hit[k] else []
    return matched, scores, ranges
