"""Minimum-weight perfect matching of a complete graph, by the primal-dual blossom method (Edmonds 1965, Galil 1986).

Weights are scaled to integers, so the duals stay exact. Vertices are 1..n, blossoms n+1 and up.
"""

from __future__ import annotations

from collections import deque

SCALE = 1000  # a thousandth of the unit


def min_weight_pairs(weights: list[list[float | None]]) -> list[tuple[int, int]]:
    """Pairs (i < j) of a perfect matching of least total weight; None: no such edge.

    Cardinality comes before weight; if no perfect matching exists, as many as can be are paired.
    """
    n = len(weights)
    if n < 2:
        return []
    whole = [[None if w is None else round(w * SCALE) for w in row] for row in weights]
    top = max((w for row in whole for w in row if w is not None), default=0)
    reward = (top + 1) * (n + 1)  # each pair is worth more than all weights together
    return _Blossoms(n, [[0 if w is None or i == j else reward - w for j, w in enumerate(row)] for i, row in enumerate(whole)]).solve()


class _Blossoms:
    def __init__(self, n: int, value: list[list[int]]) -> None:
        size = n + n // 2 + 2
        self.n = self.used = n
        # edge[a][b]: the real edge (u, v, value) by which a and b, vertices or blossoms, are joined
        self.edge = [[(a, b, value[a - 1][b - 1] if 1 <= a <= n and 1 <= b <= n else 0) for b in range(size)] for a in range(size)]
        best = max(map(max, value))
        self.dual = [best if 1 <= a <= n else 0 for a in range(size)]
        self.mate = [0] * size
        self.near = [0] * size
        self.top = list(range(n + 1)) + [0] * (size - n - 1)
        self.parent = [0] * size
        self.label = [-1] * size  # 0: outer, 1: inner, -1: not in a tree
        self.seen = [0] * size
        self.clock = 0
        self.parts: list[list[int]] = [[] for _ in range(size)]
        self.holder = [[a if a == b and 1 <= a <= n else 0 for b in range(n + 1)] for a in range(size)]
        self.queue: deque[int] = deque()

    def slack(self, e: tuple[int, int, int]) -> int:
        u, v, _ = e
        return self.dual[u] + self.dual[v] - 2 * self.edge[u][v][2]

    def closer(self, u: int, x: int) -> None:
        if not self.near[x] or self.slack(self.edge[u][x]) < self.slack(self.edge[self.near[x]][x]):
            self.near[x] = u

    def renew(self, x: int) -> None:
        self.near[x] = 0
        for u in range(1, self.n + 1):
            if self.edge[u][x][2] > 0 and self.top[u] != x and self.label[self.top[u]] == 0:
                self.closer(u, x)

    def push(self, x: int) -> None:
        if x <= self.n:
            self.queue.append(x)
        else:
            for p in self.parts[x]:
                self.push(p)

    def raise_to(self, x: int, b: int) -> None:
        self.top[x] = b
        if x > self.n:
            for p in self.parts[x]:
                self.raise_to(p, b)

    def place(self, b: int, x: int) -> int:
        """Index of part x in blossom b, counted so that the way to it is even."""
        i = self.parts[b].index(x)
        if i % 2:
            self.parts[b][1:] = self.parts[b][:0:-1]
            i = len(self.parts[b]) - i
        return i

    def marry(self, u: int, v: int) -> None:
        e = self.edge[u][v]
        self.mate[u] = e[1]
        if u > self.n:
            x = self.holder[u][e[0]]
            i = self.place(u, x)
            for k in range(i):
                self.marry(self.parts[u][k], self.parts[u][k ^ 1])
            self.marry(x, v)
            self.parts[u] = self.parts[u][i:] + self.parts[u][:i]

    def flip(self, u: int, v: int) -> None:
        while True:
            w = self.top[self.mate[u]]
            self.marry(u, v)
            if not w:
                return
            self.marry(w, self.top[self.parent[w]])
            u, v = self.top[self.parent[w]], w

    def meet(self, u: int, v: int) -> int:
        self.clock += 1
        while u or v:
            if u:
                if self.seen[u] == self.clock:
                    return u
                self.seen[u] = self.clock
                u = self.top[self.mate[u]]
                if u:
                    u = self.top[self.parent[u]]
            u, v = v, u
        return 0

    def shrink(self, u: int, base: int, v: int) -> None:
        b = self.n + 1
        while b <= self.used and self.top[b]:
            b += 1
        self.used = max(self.used, b)
        self.dual[b] = self.label[b] = 0
        self.mate[b] = self.mate[base]
        parts = [base]
        for end in (u, v):
            x = end
            while x != base:
                y = self.top[self.mate[x]]
                parts += [x, y]
                self.push(y)
                x = self.top[self.parent[y]]
            if end == u:
                parts[1:] = parts[:0:-1]
        self.parts[b] = parts
        self.raise_to(b, b)
        for x in range(1, self.used + 1):
            self.edge[b][x] = (b, x, 0)
            self.edge[x][b] = (x, b, 0)
        self.holder[b] = [0] * (self.n + 1)
        for p in parts:
            for x in range(1, self.used + 1):
                if self.edge[p][x][2] > 0 and (self.edge[b][x][2] == 0 or self.slack(self.edge[p][x]) < self.slack(self.edge[b][x])):
                    self.edge[b][x], self.edge[x][b] = self.edge[p][x], self.edge[x][p]
            for x in range(1, self.n + 1):
                if self.holder[p][x]:
                    self.holder[b][x] = p
        self.renew(b)

    def unfold(self, b: int) -> None:
        for p in self.parts[b]:
            self.raise_to(p, p)
        x = self.holder[b][self.edge[b][self.parent[b]][0]]
        i = self.place(b, x)
        for k in range(0, i, 2):
            a, c = self.parts[b][k], self.parts[b][k + 1]
            self.parent[a] = self.edge[c][a][0]
            self.label[a], self.label[c] = 1, 0
            self.near[a] = 0
            self.renew(c)
            self.push(c)
        self.label[x], self.parent[x] = 1, self.parent[b]
        for p in self.parts[b][i + 1 :]:
            self.label[p] = -1
            self.renew(p)
        self.top[b] = 0

    def tight(self, e: tuple[int, int, int]) -> bool:
        """Use a tight edge; whether that made the matching larger."""
        u, v = self.top[e[0]], self.top[e[1]]
        if self.label[v] == -1:
            self.parent[v], self.label[v] = e[0], 1
            w = self.top[self.mate[v]]
            self.near[v] = self.near[w] = 0
            self.label[w] = 0
            self.push(w)
        elif self.label[v] == 0:
            base = self.meet(u, v)
            if not base:
                self.flip(u, v)
                self.flip(v, u)
                return True
            self.shrink(u, base, v)
        return False

    def grow(self) -> bool:
        for x in range(1, self.used + 1):
            self.label[x], self.near[x] = -1, 0
        self.queue.clear()
        for x in range(1, self.used + 1):
            if self.top[x] == x and not self.mate[x]:
                self.parent[x] = self.label[x] = 0
                self.push(x)
        if not self.queue:
            return False
        while True:
            while self.queue:
                u = self.queue.popleft()
                if self.label[self.top[u]] == 1:
                    continue
                for v in range(1, self.n + 1):
                    if self.edge[u][v][2] > 0 and self.top[u] != self.top[v]:
                        if self.slack(self.edge[u][v]) == 0:
                            if self.tight(self.edge[u][v]):
                                return True
                        else:
                            self.closer(u, self.top[v])
            d: float = float("inf")
            tops = [x for x in range(1, self.used + 1) if self.top[x] == x]
            for x in tops:
                if x > self.n and self.label[x] == 1:
                    d = min(d, self.dual[x] // 2)
                if self.near[x] and self.label[x] < 1:
                    s = self.slack(self.edge[self.near[x]][x])
                    d = min(d, s if self.label[x] == -1 else s // 2)
            for u in range(1, self.n + 1):
                if self.label[self.top[u]] == 0:
                    if self.dual[u] <= d:
                        return False
                    self.dual[u] -= d
                elif self.label[self.top[u]] == 1:
                    self.dual[u] += d
            for x in tops:
                if x > self.n:
                    self.dual[x] += 2 * d * (self.label[x] == 0) - 2 * d * (self.label[x] == 1)
            self.queue.clear()
            for x in range(1, self.used + 1):
                if self.top[x] == x and self.near[x] and self.top[self.near[x]] != x and self.slack(self.edge[self.near[x]][x]) == 0 and self.tight(self.edge[self.near[x]][x]):
                    return True
            for x in range(self.n + 1, self.used + 1):
                if self.top[x] == x and self.label[x] == 1 and self.dual[x] == 0:
                    self.unfold(x)

    def solve(self) -> list[tuple[int, int]]:
        while self.grow():
            pass
        return [(a - 1, self.mate[a] - 1) for a in range(1, self.n + 1) if a < self.mate[a]]
