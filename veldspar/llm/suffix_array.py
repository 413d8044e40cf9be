"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The text is classified into larger (L) and smaller (S) suffixes.  The leftmost smaller (LMS)
substrings are sorted and named, and the text of names, at most half as long, is sorted by
recursion, at every size, until all names differ.  A name that occurs once orders its suffix by
itself, so of a run of such names only the first is kept.  From the sorted LMS suffixes the whole
array is induced in two scans, each linear.

Where the caller knows that common prefixes are short (strings of bounded length), names are sorted by
prefix multiplication instead of recursion: a round orders them by three times as many names, and only
those that are still equal take part.  Both give the same array.

A scan takes many buckets in one step of a few array operations, as long as none of them induces
into another of the step; from the first that does on, the next step begins.  A bucket that
induces into itself (runs of one symbol) takes further turns by itself.
"""

from __future__ import annotations

import numpy as np

#: Places of the array that a scan's first step takes; steps grow and shrink by what they meet.
STEP = 4096


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol must be the least and unique."""
    n = len(t)
    step = np.flatnonzero(t[1:] != t[:-1])
    up = t[step + 1] > t[step]
    s = np.ones(n, bool)
    s[: n - 1] = np.repeat(up, np.diff(step, prepend=-1))[: n - 1]
    return s


def packed(t: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Each position's next symbols in one number, the first one highest (0 beyond the end); their bits, and how many.

    No symbol is all ones in its bits.
    """
    bits = max(8, int(t.max() + 1).bit_length())
    per = 64 // bits
    word, have = np.concatenate([t.astype(np.uint64), np.zeros(per, np.uint64)]), 1
    while have < per:
        more = min(have, per - have)
        word = (word[: len(word) - have] << np.uint64(bits * more)) | (word[have:] >> np.uint64(bits * (have - more)))
        word, have = np.concatenate([word, np.zeros(have, np.uint64)]), have + more
    return word[: len(t)], bits, per


def substring_names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Name of each LMS substring: equal for equal ones, ascending with them, 0 the least.

    A substring goes to the first symbol of the next one.  Of two, of which one goes on where the
    other ends, the one that goes on is smaller (it goes on with an L position), so the end counts
    as the largest symbol.
    """
    word, bits, per = packed(t)
    size = np.append(np.diff(lms) + 1, 1)
    full = (1 << (bits * per)) - 1

    def key(i: np.ndarray, k: int) -> np.ndarray:
        ended = np.minimum(np.maximum(per - size[i] + k, 0), per)
        x = word[np.minimum(lms[i] + k, len(t) - 1)]
        return x | np.array([(1 << (bits * e)) - 1 for e in range(per)] + [full], np.uint64)[ended]

    def ranked(x: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.empty(len(x), bool)
        new[0] = True
        y = x[order]
        np.not_equal(y[1:], y[:-1], out=new[1:])
        return new

    x = key(np.arange(len(lms)), 0)
    order = np.argsort(x, kind="stable")
    new = ranked(x, order)
    k = per
    # Groups of equal beginnings in which some go on are sorted further, within their places.
    while True:
        group = np.cumsum(new) - 1
        many = ~new
        many[:-1] |= ~new[1:]
        at = np.flatnonzero(many)
        at = at[size[order[at]] >= k]
        if not len(at):
            break
        live = order[at]
        x = key(live, k)
        by = np.lexsort((x, group[at]))
        order[at] = live[by]
        g, x = group[at], x[by]
        apart = (g[1:] == g[:-1]) & (x[1:] != x[:-1])
        new[at[1:][apart]] = True
        k += per
    name = np.empty(len(lms), np.int64)
    name[order] = np.cumsum(new) - 1
    return name


def _deal(out: np.ndarray, head: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> None:
    """Append positions to their symbols' buckets in ``out``, keeping their order."""
    if len(at) > 1:
        order = symbol.argsort(kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(symbol[1:], symbol[:-1], out=first[1:])
        edge = first.nonzero()[0]
        size = np.empty(len(edge), np.int64)
        size[:-1] = edge[1:]
        size[-1] = len(at)
        size -= edge
        name = symbol[edge]
        if len(edge) < 16:
            for c, a, n in zip(name.tolist(), edge.tolist(), size.tolist(), strict=True):
                out[head[c] : head[c] + n] = at[a : a + n]
        else:
            out[(head[name] - edge).repeat(size) + np.arange(len(at))] = at
        head[name] += size
    else:
        out[head[symbol[0]]] = at[0]
        head[symbol[0]] += 1


def _scan(out: np.ndarray, start: np.ndarray, half: np.ndarray, head: np.ndarray, both: np.ndarray) -> None:
    """Go through the buckets and put before each position in them the one left of it, if it is of the kind.

    ``out`` is the array with -1 in empty places; bucket c begins at start[c], what is induced
    into it at start[c] (filled up to head[c]), what it was given at half[c].  ``both`` is each
    position's symbol, doubled, plus 1 if it is of the kind that is induced.  Positions are only
    induced into their own or later buckets.
    """
    begins, halves, k = start.tolist(), half.tolist(), len(start) - 1

    def left(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        j = at[at >= 0] - 1
        x = both[j]
        on = (x & 1) == 1
        return j[on], x[on] >> 1

    def deal(at: np.ndarray) -> None:
        j, x = left(at)
        if len(j):
            _deal(out, head, j, x)

    c, step = 0, STEP
    while c < k:
        to = max(c + 1, int(np.searchsorted(start, begins[c] + step, "right")) - 1)
        if to > c + 1:
            at = out[begins[c] : begins[to]]
            j, x = left(at)
            inside = int(x.min()) if len(x) else to
            if inside >= to:
                if len(j):
                    _deal(out, head, j, x)
                c, step = to, step * 2
                continue
            if inside > c:
                deal(out[begins[c] : begins[inside]])
                step = max(1, begins[inside] - begins[c])
                c = inside
                continue
            step = max(1, step // 2)
        at = begins[c]
        # Positions of this bucket come in turns: a turn may induce into the bucket itself.
        while at < halves[c] and (end := int(head[c])) > at:
            deal(out[at:end])
            at = end
        if begins[c + 1] > halves[c]:
            deal(out[halves[c] : begins[c + 1]])
        c += 1


def induce(t: np.ndarray, s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced by the LMS positions in the order of their suffixes."""
    n = len(t)
    count, larger, seeded = (np.bincount(x, minlength=k) for x in (t, t[~s], t[lms]))
    start = np.concatenate([[0], np.cumsum(count)])
    small = np.uint16 if k < 1 << 15 else np.uint32
    out = np.full(n, -1, np.int32)
    symbol = t[lms].astype(small)
    by = np.argsort(symbol, kind="stable")
    seeds = np.arange(len(lms)) + np.repeat(start[1:] - np.cumsum(seeded), seeded)
    out[seeds] = lms[by]
    # Before position 0 stands the end of the text (index -1), which is of neither kind.
    both = (t << 1 | ~s).astype(small)
    _scan(out, start, start[:-1] + larger, start[:-1].copy(), both)
    out[seeds] = -1
    # The smaller ones are filled from each bucket's end: the same scan of the mirrored array.
    mirror = n - start[::-1]
    head = mirror[:-1].copy()
    out[0] = n - 1
    head[-1] += 1
    both = ((k - 1 - t) << 1 | s).astype(small)
    both[-1] &= ~small(1)
    _scan(out[::-1], mirror, mirror[:-1] + (count - larger)[::-1], head, both)
    return out


def suffix_array(t: np.ndarray, k: int, short: bool = False) -> np.ndarray:
    """Suffix array of ``t`` over symbols 0..k-1; ``t`` ends with a 0 that stands nowhere else.

    ``short``: common prefixes are short; longer ones cost rounds, by the logarithm of their length.
    """
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    t = t.astype(np.int64)
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    name = substring_names(t, lms)
    return induce(t, s, k, lms[_order_by_rounds(name) if short else _order(name)])


def _order(name: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text of names (the last one least and unique), by recursion."""
    m = len(name)
    count = np.bincount(name)
    alone = count[name] == 1
    first = np.cumsum(count) - count
    out = np.empty(m, np.int64)
    out[first[name[alone]]] = np.flatnonzero(alone)
    if alone.all():
        return out
    # A comparison ends at a name that occurs once, so of a run of them only the first can matter.
    kept = ~alone
    kept[1:] |= kept[:-1].copy()
    kept[-1] = True
    which = np.flatnonzero(kept)
    used = np.zeros(len(count), bool)
    used[name[which]] = True
    sub = which[suffix_array((np.cumsum(used) - 1)[name[which]], int(used.sum()))]
    out[np.repeat(count > 1, count)] = sub[~alone[sub]]
    return out


def _order_by_rounds(name: np.ndarray) -> np.ndarray:
    """The same order by prefix multiplication: ranks by the first names, then by three such ranks in a row."""
    m = len(name)
    bits = max(1, int(m).bit_length())
    # 0 beyond the end; a rank is the place of the first of its equals, plus 1.
    rank = np.concatenate([name + 1, np.zeros(1, np.int64)])
    width, per = 1, max(2, 63 // max(1, int(name.max() + 1).bit_length()))
    live, order = np.arange(m), np.empty(m, np.int64)
    place = np.zeros(m, np.int64)
    # ``live`` holds those that equal others, by rank, ``place`` where in the order they stand.
    while True:
        word = rank[live].astype(np.uint64)
        step = np.uint64(63 // per)
        for i in range(1, per):
            word = word << step | rank[np.minimum(live + i * width, m)].astype(np.uint64)
        by = np.argsort(word, kind="stable")
        live, word = live[by], word[by]
        if width == 1:
            place = np.arange(m)
        new = np.ones(len(live), bool)
        np.not_equal(word[1:], word[:-1], out=new[1:])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(live))
        order[place] = live
        fresh = np.repeat(place[first] + 1, size)
        many = np.repeat(size > 1, size)
        rank[live] = fresh
        if not many.any():
            return order
        live, place = live[many], place[many]
        width, per = width * per, max(2, 63 // bits)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order.

    Only irreducible positions (other symbol before than the neighbour has) are compared; the
    others follow from the position to their left: one less.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    free = phi >= 0
    free[1:] &= (phi[1:] == 0) | (t[:-1] != t[phi[1:] - 1])
    i = np.flatnonzero(free)
    word, bits, per = packed(t)
    size = np.zeros(len(i), np.int64)
    live, x, y = np.arange(len(i)), i, phi[i]
    while len(live):
        apart = word[x] ^ word[y]
        ends = apart != 0
        rest, done = apart[ends], live[ends]
        for m in range(1, per):
            size[done] += rest >> np.uint64(bits * (per - m)) == 0
        go = ~ends
        live, x, y = live[go], x[go] + per, y[go] + per
        size[live] += per
    reach = np.zeros(n, np.int64)
    reach[i] = i + size
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
