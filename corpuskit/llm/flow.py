"""Minimum-cost flow on small integer networks by successive shortest paths."""

from __future__ import annotations

import heapq


class MinCostFlow:
    """Directed network with integer capacities and non-negative integer costs."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        """Add an arc and return its number; its flow is the capacity of arc number + 1."""
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc + 1]

    def run(self, source: int, sink: int) -> int:
        """Send as much as possible as cheaply as possible; returns the cost."""
        n = len(self.out)
        potential = [0] * n
        total = 0
        while True:
            dist, via = [None] * n, [-1] * n
            dist[source] = 0
            heap = [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    if self.cap[e] > 0:
                        v = self.to[e]
                        nd = d + self.cost[e] + potential[u] - potential[v]
                        if dist[v] is None or nd < dist[v]:
                            dist[v], via[v] = nd, e
                            heapq.heappush(heap, (nd, v))
            if dist[sink] is None:
                return total
            far = max(d for d in dist if d is not None)
            for v in range(n):
                potential[v] += dist[v] if dist[v] is not None else far
            push, v = None, sink
            while v != source:
                push = self.cap[via[v]] if push is None else min(push, self.cap[via[v]])
                v = self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.cap[via[v]] -= push
                self.cap[via[v] ^ 1] += push
                total += push * self.cost[via[v]]
                v = self.to[via[v] ^ 1]
