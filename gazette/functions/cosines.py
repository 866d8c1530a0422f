"""Cosines of the sparse vectors of two groups of articles, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Products, places of sums (which a processor's cache should hold) and pairs to complete, at a time.
AT_ONCE, CELLS, PAIRS = 1 << 21, 1 << 18, 1 << 16


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places of runs that begin somewhere, one run after another."""
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(begin - (ends - many), many)
    return at


def at_least(x: np.ndarray, least: float) -> np.ndarray:
    """Where a table of a multiple of eight numbers has `least` or more, which is seldom: eight places are looked at in one."""
    hit = x >= least
    some = np.flatnonzero(hit.view(np.uint64))
    k, l = np.nonzero(hit.reshape(-1, 8)[some])  # noqa: E741
    return some[k] * 8 + l


class Part:
    """Some entries of a group, by article and token: whose, t and u, where each article's begin, and what they are looked up by."""

    def __init__(self, owner: np.ndarray, t: np.ndarray, u: np.ndarray, n: int, size: int):
        self.owner, self.t, self.u, self.size = owner, t, u, size
        self.begins, self.keys = np.searchsorted(owner, np.arange(n + 1)), owner * size + t


class Side:
    """The vectors of a group: entries that the join leaves out (rest) apart from the others (kept)."""

    def __init__(self, which: np.ndarray, cuts: np.ndarray, t: np.ndarray, u: np.ndarray, rest: np.ndarray, slack: np.ndarray, size: int):
        many = cuts[which + 1] - cuts[which]
        run, at = np.repeat(np.arange(len(which)), many), spread(cuts[which], many)
        order = np.lexsort((t[at], run))
        run, at = run[order], at[order]
        self.which, self.slack, self.n = which, slack[which], len(which)
        part = lambda w: Part(run[w], t[at[w]], u[at[w]], self.n, size)
        self.every, self.kept, self.rest = part(slice(None)), part(~rest[at]), part(rest[at])


def looked_up(mine: Part, wanted: np.ndarray, theirs: Part, other: np.ndarray) -> np.ndarray:
    """For pairs of articles: the sum of products of one part's entries with the equal tokens of another part."""
    many = mine.begins[wanted + 1] - mine.begins[wanted]
    run, at = np.repeat(np.arange(len(wanted)), many), spread(mine.begins[wanted], many)
    if not len(theirs.keys) or not len(at):
        return np.zeros(len(wanted))
    look = other[run] * theirs.size + mine.t[at]
    place = np.minimum(np.searchsorted(theirs.keys, look), len(theirs.keys) - 1)
    return np.bincount(run, np.where(theirs.keys[place] == look, mine.u[at] * theirs.u[place], 0.0), len(wanted))


def able(x: Side, y: Side, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and the sum over kept entries, of pairs that can have a cosine of `least` or more. The sums of some
    articles of x with all of y stand in a table of CELLS places, to which every product is added by its place."""
    mine, theirs = x.kept, y.kept
    order = np.argsort(theirs.t, kind="stable")
    owner, u = theirs.owner[order].astype(np.int32), theirs.u[order]
    starts = np.searchsorted(theirs.t[order], np.arange(theirs.size + 1))
    begin, many = starts[mine.t], starts[mine.t + 1] - starts[mine.t]
    upto = np.concatenate([[0], np.cumsum(many)])[mine.begins]  # products before each article
    worst = max(least - 1e-9 - max(x.slack.max(initial=0.0), y.slack.max(initial=0.0)), np.finfo(float).tiny)
    a, rows = 0, max(1, CELLS // max(y.n, 1))
    while a < x.n:
        z = min(x.n, max(a + 1, min(int(np.searchsorted(upto, upto[a] + AT_ONCE, "right")) - 1, a + rows)))
        p, q = mine.begins[a], mine.begins[z]
        at = spread(begin[p:q], many[p:q])
        place = np.repeat((mine.owner[p:q] - a) * y.n, many[p:q])
        place += owner.take(at)
        product = np.repeat(mine.u[p:q], many[p:q])
        product *= u.take(at)
        dot = np.bincount(place, product, -(-(z - a) * y.n // 8) * 8)
        found = at_least(dot, worst)
        i, j, dot = found // y.n + a, found % y.n, dot[found]
        good = dot + np.maximum(x.slack[i], y.slack[j]) >= least - 1e-9
        if same:
            good &= i < j
        yield i[good], j[good], dot[good]
        a = z


def similar(x: Side, y: Side, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and the cosine, of pairs of `least` or more; of one group, every pair once."""

    def complete():
        i, j, dot = (np.concatenate(c) for c in zip(*held, strict=True))
        cosine = dot + looked_up(x.rest, i, y.every, j) + looked_up(y.rest, j, x.kept, i)
        good = cosine >= least
        return i[good], j[good], cosine[good]

    held, many = [], 0
    for pairs in able(x, y, same, least):
        held.append(pairs)
        many += len(pairs[0])
        if many >= PAIRS:
            yield complete()
            held, many = [], 0
    if held:
        yield complete()


def of_places(batches, least: float):
    """a, b, similarity of Arrow batches of place, same, first, id, slack, t, u, rest, sorted by place, where two groups meet, or one
    (same) with itself."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def flat(column):
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])

    def met(held: list):
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["id"])).combine_chunks()
        ids, first, same = table["id"].combine_chunks(), table["first"].to_numpy(), table["same"][0].as_py()
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(table["t"]).to_numpy())])
        names, t = np.unique(flat(table["t"]), return_inverse=True)
        entries = (cuts, t, flat(table["u"]), flat(table["rest"]), table["slack"].to_numpy(), len(names))
        x = Side(np.flatnonzero(first), *entries)
        y = x if same else Side(np.flatnonzero(~first), *entries)
        for i, j, cosine in similar(x, y, same, least):
            i, j = x.which[i], y.which[j]
            yield pa.RecordBatch.from_arrays([pa.array(ids.take(pa.array(k))) for k in (np.minimum(i, j), np.maximum(i, j))] + [pa.array(cosine)], ["a", "b", "similarity"])

    held, last = [], None
    for batch in batches:
        place = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a < z:
                if held and place[a] != last:
                    yield from met(held)
                    held = []
                held.append(batch.slice(a, z - a))
                last = place[a]
    if held:
        yield from met(held)
