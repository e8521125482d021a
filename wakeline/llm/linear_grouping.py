"""Suffix arrays by linear grouping, for many short strings at once.

Phase 1 sorts suffixes into groups of equal Lyndon prefix. Groups are taken in descending order; each member points to
the previous suffix in a smaller group, and the suffixes pointed to get the group's prefix appended: they leave their group for a new one right
above it, the further up the more pointers came. Pointers are followed through suffixes already grouped, so the work is
linear. A group is an interval of suffix-array slots and its label the first of them, so nothing is ever renamed.

Phase 2 fills the slots in ascending order, a group at a time: after a suffix come, each at the front of its own group,
those whose Lyndon prefix ends where it begins.

All strings take each step together; a step is a few array operations over the current group of every string. Many short
strings so cost little more than the longest of them.
"""

from __future__ import annotations

import numpy as np

from .sorting import packed_order


def _ramps(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] numbers, then starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def suffix_arrays(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix arrays, one after another, as positions in ``flat``.

    ``flat`` holds the strings one after another; each ends with a symbol smaller than all its others. An empty list gives an empty array.
    """
    lengths = np.asarray(lengths, np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64)
    base = np.cumsum(lengths) - lengths
    label, prefix = _lyndon_groups(np.asarray(flat, np.int64), base, lengths, n)
    return _fill(label, prefix, base, lengths, n)


def _lyndon_groups(flat: np.ndarray, base: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    string = np.repeat(np.arange(len(base)), lengths)
    order = packed_order(string, flat)
    new = np.ones(n, bool)
    new[1:] = (flat[order[1:]] != flat[order[:-1]]) | (string[order[1:]] != string[order[:-1]])
    firsts = np.flatnonzero(new)
    counts = np.diff(np.append(firsts, n))
    label = np.empty(n + 1, np.int64)
    label[order] = np.repeat(firsts, counts)
    label[n] = -1  # where pointers out of the string lead
    size, seg_start, seg_count, ends_at = (np.zeros(n, np.int64) for _ in range(4))
    size[firsts], seg_start[firsts], seg_count[firsts], ends_at[firsts + counts - 1] = counts, firsts, counts, firsts
    members = np.empty(2 * n, np.int64)  # as groups were formed; who has moved on is skipped
    members[:n] = order
    top = n
    previous = np.arange(n) - 1
    previous[base] = n
    prefix = np.ones(n, np.int64)
    floor, current = base, ends_at[base + lengths - 1]
    while True:
        open_ = current > floor  # the lowest group is the end symbol alone
        if not open_.all():
            floor, current = floor[open_], current[open_]
        if not len(current):
            return label[:n], prefix
        counts = seg_count.take(current)
        who, mine = members.take(_ramps(seg_start.take(current), counts)), np.repeat(current, counts)
        here = label.take(who) == mine
        if not here.all():
            who, mine = who[here], mine[here]
        to = previous.take(who)
        walking = np.flatnonzero(label.take(to) >= mine)
        if len(walking):
            walker, own, on = who[walking], mine[walking], to[walking]
            while len(walker):
                on = previous.take(on)
                previous[walker] = on
                left = label.take(on) >= own
                walker, own, on = walker[left], own[left], on[left]
            to = previous.take(who)
        pointing = to < n
        if not pointing.all():
            to, who = to[pointing], who[pointing]
        if len(to):
            top = _append(to, prefix.take(who), label, prefix, size, seg_start, seg_count, ends_at, members, top)
        current = np.where(current > floor, ends_at.take(current - 1), floor)


def _append(to, added, label, prefix, size, seg_start, seg_count, ends_at, members, top) -> int:
    """The suffixes ``to`` (with repetitions) get the prefixes of length ``added``, the same for each of one string, appended and move up."""
    bits = len(prefix).bit_length()
    mask = (1 << bits) - 1
    pairs = to << bits | added  # both below 2**31
    pairs.sort()
    at = _changes(pairs)
    times = _lengths(at, len(pairs))
    pairs = pairs[at]
    moved = pairs >> bits
    prefix[moved] += times * (pairs & mask)
    old = label.take(moved)
    if 3 * bits <= 63:
        keys = (old << bits | times) << bits | moved
        keys.sort()
        moved, keys = keys & mask, keys >> bits
        old, group_at = keys >> bits, _changes(keys)
    else:
        order = np.lexsort((times, old))
        moved, old = moved[order], old[order]
        group_at = _changes(old << bits | times[order])
    run_at = _changes(old)
    leaving = _lengths(run_at, len(old))
    group = old[run_at]
    held = size.take(group)
    rest = held - leaving
    names = (np.repeat(group + rest - run_at, leaving))[group_at] + group_at
    group_size = _lengths(group_at, len(old))
    staying = rest > 0
    size[group] = rest
    ends_at[(group + rest - 1)[staying]] = group[staying]
    size[names], seg_count[names], seg_start[names], ends_at[names + group_size - 1] = group_size, group_size, top + group_at, names
    label[moved] = np.repeat(names, group_size)
    members[top : top + len(moved)] = moved
    return top + len(moved)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a number differs from the one before, and the first place."""
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1:] = end - starts[-1:]
    return out


def _fill(label: np.ndarray, prefix: np.ndarray, base: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    last = base + lengths - 1
    after = np.arange(n) + prefix
    after[last] = n  # follows nothing
    by_after = packed_order(after)
    first = np.zeros(n + 2, np.int64)
    np.cumsum(np.bincount(after, minlength=n + 1), out=first[1:])
    size = np.bincount(label, minlength=n)
    found, front = np.empty(n, np.int64), np.arange(n)
    found[base] = last
    front[base] += 1
    group, slot, end = base.copy(), base.copy(), base + lengths
    bits = n.bit_length()
    while len(slot):
        # all that stand in the current groups so far; followers of theirs may come behind them in the same group
        upto = front.take(group)
        here = found.take(_ramps(slot, upto - slot))
        slot = upto
        begin = first.take(here)
        new = by_after.take(_ramps(begin, first.take(here + 1) - begin))
        if len(new):
            keys = label.take(new) << bits
            keys |= np.arange(len(new))
            keys.sort()
            to, new = keys >> bits, new.take(keys & ((1 << bits) - 1))
            at = _changes(to)
            counts = _lengths(at, len(to))
            begin = front[to[at]]
            found[np.repeat(begin - at, counts) + np.arange(len(to))] = new
            front[to[at]] = begin + counts
        group = np.where(slot == group + size.take(group), slot, group)
        left = slot < end
        if not left.all():
            group, slot, end = group[left], slot[left], end[left]
    return found
