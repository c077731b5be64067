"""Which node owns which key."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

Key = tuple


def in_key_order(key: Key) -> tuple:
    """Keys compare column by column, null last."""
    return tuple((value is None, 0 if value is None else value) for value in key)


def assign_owners(counts: Mapping[str, Mapping[Key, int]]) -> dict[Key, str]:
    """Owner of each key, from the rows of each key on each node.

    A node wants the keys it has the largest share of, smaller keys first among equals. The node with the fewest
    assigned rows, the smallest name among equals, takes the next free key that it wants, at its whole size; a
    node that wants no more drops out. One node owns everything.
    """
    whole: dict[Key, int] = {}
    for local in counts.values():
        for key, n in local.items():
            whole[key] = whole.get(key, 0) + n
    wishes = {
        node: iter(sorted(local, key=lambda key, local=local: (-local[key] / whole[key], in_key_order(key))))
        for node, local in counts.items()
    }
    owners: dict[Key, str] = {}
    queue = [(0, node) for node in sorted(wishes)]
    while queue:
        load, node = heapq.heappop(queue)
        key = next((k for k in wishes[node] if k not in owners), None)
        if key is not None:
            owners[key] = node
            heapq.heappush(queue, (load + whole[key], node))
    return owners
