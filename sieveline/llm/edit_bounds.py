"""Bounds of the edit distance of many pairs of lines side by side, exact on both sides.

The second line of a pair is cut into pieces of 64 characters, a machine word each. If the distance is within the limit,
each piece is aligned with a part of the first line that is shifted by no more than the limit allows, so the pieces' least
distances from any part of such a window add up to no more than the limit: pairs with a larger sum aren't alike. The
places where the nearest parts end cut the first line; the distances of the pieces from the parts between these cuts add up
to what one way of editing costs: pairs with a sum within the limit are alike. Pairs between the bounds are left open.
Distances are those of bit vectors (Myers, Hyyro), one step for a character of the window, all pieces at once.
"""

from __future__ import annotations

import numpy as np

#: Characters of a piece.
PIECE = 64
#: Pieces that are compared at a time, and codes of characters: rarer characters share the last one.
LANES, CODES = 8192, 128
ALIKE, UNLIKE, OPEN = 1, 0, -1
ONE, TOP, FULL = np.uint64(1), np.uint64(63), ~np.uint64(0)
#: Scores stand above the step in one number, so that the least one tells where it was first reached.
STEP_BITS = 32


def distances(masks: np.ndarray, rows: np.ndarray, sizes: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece (the start of its row of masks, and its size) the distance from codes[begin:end], and `end`; if not
    whole, the least distance from any part of it and the end of the first such part. Pieces stand in the upper bits; the
    bits below match everything at no cost."""
    order = np.argsort(begin - end, kind="stable")
    rows, at, steps, sizes = rows[order], begin[order], (end - begin)[order], sizes[order]
    floor = ONE << (PIECE - sizes).astype(np.uint64)
    up, down = FULL << (PIECE - sizes).astype(np.uint64), np.zeros(len(order), np.uint64)
    score = sizes.astype(np.int64) << STEP_BITS
    best = score.copy()
    active = np.searchsorted(-steps, -np.arange(steps.max(initial=0)), side="left")
    for step, n in enumerate(active.tolist()):
        match = masks.take(rows[:n] + codes.take(at[:n] + step))
        u, d, s = up[:n], down[:n], score[:n]
        h = match & u
        h += u
        h ^= u
        h |= match
        less = u & h
        h |= u
        more = ~h
        more |= d
        match |= d
        change = more >> TOP
        change -= less >> TOP
        change <<= np.uint64(STEP_BITS)
        s += change.view(np.int64)
        more <<= ONE
        less <<= ONE
        if whole:
            more |= floor[:n]
        else:
            np.minimum(best[:n], s + (step + 1), out=best[:n])
        np.bitwise_and(match, more, out=d)
        match |= more
        np.invert(match, out=match)
        np.bitwise_or(less, match, out=u)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    if whole:
        return (score >> STEP_BITS)[back], end
    return (best >> STEP_BITS)[back], begin + (best & ((1 << STEP_BITS) - 1))[back]


def piece_masks(codes: np.ndarray, width: int, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of `width` masks for each piece: where in it each code stands."""
    masks = np.zeros(len(start) * width, np.uint64)
    base, last = np.arange(len(start)) * width, start + sizes - 1
    for k in range(int(sizes.max(initial=0))):
        if k and (short := sizes <= k).any():
            base, last, sizes = base[~short], last[~short], sizes[~short]
        masks[base + codes.take(last - k)] |= ONE << np.uint64(PIECE - 1 - k)
    return masks


def verdicts(lines: list[str], first: np.ndarray, second: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """ALIKE if lines[first] and lines[second] are within the limit, UNLIKE if they aren't, OPEN if the bounds can't tell."""
    out = np.full(len(first), OPEN, np.int8)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(size) - size
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.cumsum(np.bincount(raw) > 0) - 1 if len(raw) else np.zeros(1, np.int64)
    width = min(int(code[-1]) + 1, CODES)
    codes = np.minimum(code, CODES - 1).astype(np.uint8)[raw]
    folded = np.add.reduceat(np.append(codes == CODES - 1, False).astype(np.int64), start) * (size > 0) > 0 if len(lines) else size > 0
    out[np.abs(size[first] - size[second]) > limits] = UNLIKE
    pieces = (size[second] + PIECE - 1) // PIECE
    todo = np.flatnonzero((out == OPEN) & (pieces > 0))
    ends, at = np.cumsum(pieces[todo]), 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, side="right")))
        some = todo[at:stop]
        x, y = first[some], second[some]
        out[some] = bounded(codes, width, start, size, x, y, pieces[some], limits[some], folded[x] | folded[y])
        at = stop
    return out


def bounded(codes: np.ndarray, width: int, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, pieces: np.ndarray, limits: np.ndarray, folded: np.ndarray) -> np.ndarray:
    """`verdicts` of pairs whose pieces are compared at a time."""
    ys, of = np.unique(y, return_inverse=True)
    n = (size[ys] + PIECE - 1) // PIECE
    first_row = np.cumsum(n) - n
    place = (np.arange(n.sum()) - np.repeat(first_row, n)) * PIECE
    row_size = np.minimum(np.repeat(size[ys], n) - place, PIECE)
    masks = piece_masks(codes, width, np.repeat(start[ys], n) + place, row_size)
    short = np.flatnonzero(row_size < PIECE)
    masks.reshape(-1, width)[short] |= ((ONE << (PIECE - row_size[short]).astype(np.uint64)) - ONE)[:, None]

    pair = np.repeat(np.arange(len(x)), pieces)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    row = first_row[of][pair] + nth
    rows, sizes, place = row * width, row_size[row], nth * PIECE
    x_start, x_size = start[x][pair], size[x][pair]
    longer, limit = (size[x] - size[y])[pair], limits[pair]
    begin = np.clip(place - (limit - longer) // 2, 0, x_size)
    end = np.clip(place + sizes + (limit + longer) // 2, begin, x_size) + x_start
    begin += x_start

    bound, nearest, cuts = np.zeros(len(x), np.int64), np.zeros(len(pair), np.int64), end.copy()
    half = nth < ((pieces + 1) // 2)[pair]
    for now in (half, ~half):  # half of the pieces rule out most pairs
        now = np.flatnonzero(now & (bound <= limits)[pair])
        nearest[now], cuts[now] = distances(masks, rows[now], sizes[now], codes, begin[now], end[now], False)
        bound += np.bincount(pair[now], nearest[now], len(x)).astype(np.int64)
    out = np.where(bound > limits, UNLIKE, OPEN).astype(np.int8)

    last = nth == pieces[pair] - 1
    cuts[last] = (x_start + x_size)[last]
    begin = np.where(nth == 0, x_start, np.roll(cuts, 1))
    ordered = np.bincount(pair, begin > cuts, len(x)) == 0
    ask = (out == OPEN) & ordered & ~folded
    now = np.flatnonzero(ask[pair])
    cost, _ = distances(masks, rows[now], sizes[now], codes, begin[now], cuts[now], True)
    out[ask & (np.bincount(pair[now], cost, len(x)) <= limits)] = ALIKE
    return out
