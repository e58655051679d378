"""One pair's position under the weighted-average-cost rules, trade by trade.

Quantities are whole numbers of 1e-8, so every accept, ignore and remove decision is exact.
Average costs are doubles. So that they do not depend on how a pair's trades are cut into
tasks, their rounding is fixed by the trades' numbers alone: trades are counted in leaves of
``leaf`` and leaves in nodes of ``fan``, nodes in nodes of ``fan`` and so on. Whatever happens in
a leaf, its exit cost is a * entry cost + b: b is the leaf folded from cost 0, a the weight
that its buys leave to the entry cost (0 once the position was removed). At a leaf's end the
cost is taken from that map, at a node's end from the composed maps of its leaves. A task that starts at
a leaf with the leaf's entry state therefore gives the same bits as one that folds all trades.
"""

from __future__ import annotations

#: Quantity steps in one unit (quantities are DECIMAL(18,8)).
UNITS = 100_000_000
#: Trades a leaf, and leaves (or nodes) a node. They fix the last bits of average costs.
LEAF_ROWS, FAN = 4096, 256


class Position:
    """``run`` takes trades in order. ``levels[0]`` is the leaf's (entry cost, a, b), ``levels[i]`` the
    same of the i-th enclosing node, as far as its leaves are done."""

    __slots__ = ("q", "c", "has", "n", "levels", "leaf", "fan")

    def __init__(self, q: int = 0, has: bool = False, c: float = 0.0, n: int = 0, levels=None,
                 leaf: int = LEAF_ROWS, fan: int = FAN):
        self.q, self.has, self.c, self.n = q, has, c, n
        self.levels = levels or [(c, 1.0, 0.0)]
        self.leaf, self.fan = leaf, fan

    def run(self, sides, amounts, prices) -> tuple[list, list, list, list]:
        """Realized amount of each trade, and quantity, average cost and existence of the position after it."""
        out, i = ([], [], [], []), 0
        while i < len(sides):
            j = min(len(sides), i + self.leaf - self.n % self.leaf)
            self._within(sides[i:j], amounts[i:j], prices[i:j], *out)
            if self.n % self.leaf == 0:
                self._turn()
            i = j
        return out

    def _within(self, sides, amounts, prices, deltas, quantities, costs, exist) -> None:
        q, c, has = self.q, self.c, self.has
        entry, a, b = self.levels[0]
        for side, amount, p in zip(sides, amounts, prices):
            x, p = int(amount), float(p)
            delta = 0.0
            if side == "buy":
                after = q + x
                if after > 0:
                    held, paid, whole = q / UNITS, (x / UNITS) * p, after / UNITS
                    c = (held * c + paid) / whole
                    b = (held * b + paid) / whole
                    a *= q / after
                else:
                    a = b = c = 0.0
                q, has = after, True
            elif has and q >= x:
                delta = (p - c) * (x / UNITS)
                q -= x
                if not q > 0:
                    q, has = 0, False
                    a = b = c = 0.0
            elif not has:
                delta = p * (x / UNITS)
            deltas.append(delta)
            quantities.append(q / UNITS)
            costs.append(c)
            exist.append(has)
        self.q, self.c, self.has = q, c, has
        self.levels[0] = entry, a, b
        self.n += len(sides)

    def map(self) -> tuple[float, float]:
        """(a, b) of the leaf so far."""
        return self.levels[0][1:]

    def _turn(self) -> None:
        """A leaf ends: the next entry cost, from the largest node that ends with it."""
        done, level = self.n // self.leaf, 0
        while True:
            entry, a, b = self.levels[level]
            self.c = a * entry + b
            level += 1
            if level == len(self.levels):
                self.levels.append((0.0, 1.0, 0.0))
            e, a1, b1 = self.levels[level]
            self.levels[level] = e, a * a1, a * b1 + b
            if done % self.fan:
                break
            done //= self.fan
        for i in range(level):
            self.levels[i] = self.c, 1.0, 0.0
