"""Allocation plans: how many rows of each class every client receives.

A plan is made of integers only (classes x clients), on the driver.  It lists segments
``(label, lo, hi, client)`` of the shuffle order within a class; rows are assigned by
a range join on their rank (:func:`quorumlab.operators.ranking.assign_segments`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

Segment = tuple[int, int, int, int]


def dirichlet_shares(alpha: float, rows: int, columns: int, seed: int) -> list[list[float]]:
    return np.random.default_rng(seed).dirichlet([alpha] * columns, size=rows).tolist()


def client_order(num_clients: int, seed: int) -> list[int]:
    return np.random.default_rng(seed).permutation(num_clients).tolist()


class _Holding:
    """What one client holds: segments in the order it received them."""

    def __init__(self) -> None:
        self.segments: list[list[int]] = []
        self.size = 0

    def add(self, label: int, lo: int, hi: int) -> None:
        if hi <= lo:
            return
        self.size += hi - lo
        last = self.segments[-1] if self.segments else None
        if last and last[0] == label and last[1] == hi:
            last[1] = lo
        elif last and last[0] == label and last[2] == lo:
            last[2] = hi
        else:
            self.segments.append([label, lo, hi])

    def give(self, count: int) -> list[tuple[int, int, int]]:
        """Give up the most recent rows, as stretches of one class."""
        given = []
        while count:
            label, lo, hi = self.segments[-1]
            lo = max(lo, hi - count)
            given.append((label, lo, hi))
            count -= hi - lo
            self.size -= hi - lo
            self.segments[-1][2] = lo
            if self.segments[-1][1] == lo:
                self.segments.pop()
        return given


def _segments(holdings: Sequence[_Holding]) -> list[Segment]:
    return [(label, lo, hi, c) for c, h in enumerate(holdings) for label, lo, hi in h.segments]


def dirichlet_plan(
    class_counts: Mapping[int, int],
    shares: Sequence[Sequence[float]],
    num_clients: int,
    min_per_client: int,
) -> list[Segment]:
    """Quantity and label skew: each class is cut at its cumulative shares, then small
    clients are filled to the floor from whichever client is largest.

    Taking row by row from the largest client cuts all clients above some level down to it;
    the level follows from the sizes, so a client is filled in one step per donor.
    """
    holdings = [_Holding() for _ in range(num_clients)]
    for label, share in zip(sorted(class_counts), shares, strict=True):
        n = class_counts[label]
        bounds = [0, *(np.cumsum(share) * n).astype(int)[:-1].tolist(), n]
        for holding, lo, hi in zip(holdings, bounds, bounds[1:], strict=False):
            holding.add(label, lo, hi)

    floor = min(min_per_client, sum(class_counts.values()) // num_clients)
    for holding in holdings:
        parts = levelled([h.size for h in holdings], floor - holding.size, floor) if holding.size < floor else {}
        for donor, count in parts.items():
            for stretch in holdings[donor].give(count):
                holding.add(*stretch)
    return _segments(holdings)


def levelled(sizes: Sequence[int], need: int, floor: int) -> dict[int, int]:
    """How many rows each client gives, when each of ``need`` rows comes from the largest one.

    Of equal ones the first gives.  Nobody gives below ``floor``.
    """
    spare = np.maximum(np.asarray(sizes, dtype=object) - floor, 0)
    need = min(need, int(spare.sum()))
    # The level is the lowest one to which cutting everybody does not take more than needed.
    order = np.sort(spare)[::-1].tolist()
    level, cut, above = 0, 0, 0
    for above, (size, following) in enumerate(zip(order, [*order[1:], 0], strict=True), 1):
        if cut + above * (size - following) > need:
            level = size - (need - cut) // above
            break
        cut += above * (size - following)
        level = following
    given = {c: int(s) - level for c, s in enumerate(spare) if s > level}
    rest = need - sum(given.values())
    for c, s in enumerate(spare):
        if rest and s >= level and level > 0:
            given[c] = given.get(c, 0) + 1
            rest -= 1
    return given


def label_skew_plan(
    class_counts: Mapping[int, int],
    shares: Sequence[Sequence[float]],
    num_clients: int,
    min_class_frac: float,
    order: Sequence[int],
) -> list[Segment]:
    """Equal sizes, skewed label ratios.

    Every client first reserves its minimum of each class, then clients fill up to the
    quota by their own label shares over the classes that still have rows, and the
    rows left over (fewer than clients) go to the smallest clients.
    """
    labels = sorted(class_counts)
    quota = sum(class_counts.values()) // num_clients
    taken = dict.fromkeys(labels, 0)
    holdings = [_Holding() for _ in range(num_clients)]

    def left(label: int) -> int:
        return class_counts[label] - taken[label]

    def give(client: int, label: int, count: int) -> None:
        holdings[client].add(label, taken[label], taken[label] + count)
        taken[label] += count

    for client in range(num_clients):
        for label in labels:
            reserve = min(int(min_class_frac * quota), class_counts[label] // num_clients)
            give(client, label, min(reserve, left(label)))

    for client in order:
        while (need := quota - holdings[client].size) > 0:
            open_labels = [label for label in labels if left(label)]
            if not open_labels:
                break
            wanted = [shares[client][labels.index(label)] for label in open_labels]
            whole = sum(wanted)
            moved = 0
            for label, share in zip(open_labels, wanted, strict=True):
                part = share / whole if whole > 0 else 1 / len(open_labels)
                count = max(0, min(round(need * part), left(label), need - moved))
                give(client, label, count)
                moved += count
            if not moved:  # every part rounded to nothing
                give(client, open_labels[0], 1)

    for label in labels:
        while left(label):
            give(min(range(num_clients), key=lambda c: holdings[c].size), label, 1)
    return _segments(holdings)
