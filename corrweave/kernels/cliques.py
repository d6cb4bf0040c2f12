"""Maximal cliques of an undirected graph."""

from __future__ import annotations

from collections.abc import Iterator


def maximal_cliques(neighbours: dict[str, set[str]], chosen: list[str] | None = None, open_: set[str] | None = None, done: set[str] | None = None) -> Iterator[list[str]]:
    """Bron-Kerbosch with pivots, without recursion; members in sorted order.

    With ``chosen``, the maximal cliques that hold those, any of ``open_`` and none of ``done``: the part of the search
    that belongs to one vertex.
    """
    stack = [(chosen or [], set(neighbours) if open_ is None else open_, done or set())]
    while stack:
        chosen, open_, done = stack.pop()
        if not open_ and not done:
            if chosen:
                yield sorted(chosen)
            continue
        if not open_:
            continue
        pivot = max(sorted(open_ | done), key=lambda v: len(neighbours[v] & open_))
        for v in sorted(open_ - neighbours[pivot]):
            stack.append(([*chosen, v], open_ & neighbours[v], done & neighbours[v]))
            open_ = open_ - {v}
            done = done | {v}
