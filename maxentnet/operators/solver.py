"""Newton's method within a shrinking interval, for monotonic functions of one number; many such equations advance together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

INF = float("inf")


@dataclass
class Solution:
    """Where the method stopped, with the course of x, of the relative steps and of the differences from the target."""

    x: float
    target: float
    n_iter: int
    max_iter: int
    atol: float
    rtol: float
    method: str = "newton"
    x_seq: list[float] = field(default_factory=list)
    step_seq: list[float] = field(default_factory=list)
    f_seq: list[float] = field(default_factory=list)

    @property
    def max_iter_reached(self) -> bool:
        return self.n_iter >= self.max_iter

    @property
    def no_change_stop(self) -> bool:
        return bool(self.step_seq) and self.step_seq[-1] <= self.rtol

    @property
    def converged(self) -> bool:
        if self.method == "fixed-point":
            return self.no_change_stop
        return abs(self.f_seq[-1]) <= self.atol + self.rtol * self.target


class Newton:
    """One equation fun(x) = target of a monotonic function. Feed it with value and slope at ``x`` until ``done``.

    The root lies between the last points on either side of it (or the bounds). Newton's step is taken while it stays strictly inside
    and each step leaves three quarters of the error at most; otherwise the interval is halved, or, where it has no end yet, the
    search goes on from its known end in steps that double.
    """

    def __init__(self, x0: float, target: float, atol: float = 1e-24, rtol: float = 1e-9, max_iter: int = 100, x_l: float = -INF, x_u: float = INF):
        if not x_l <= x0 <= x_u:
            raise ValueError("x0 must be between x_l and x_u.")
        self.x, self.target, self.atol, self.rtol, self.max_iter = x0, target, atol, rtol, max_iter
        self.low, self.high = x_l, x_u
        self.n, self.rising, self.reach = 0, None, 0.0
        self.xs, self.steps, self.fs = [x0], [], []
        self.done = False

    def feed(self, value: float, slope: float) -> None:
        error = value - self.target
        slow = bool(self.fs) and abs(error) > 0.75 * abs(self.fs[-1])
        self.n += bool(self.fs)
        self.fs.append(error)
        self.done = abs(error) <= self.atol + self.rtol * abs(self.target) or self.n >= self.max_iter or bool(self.steps) and self.steps[-1] <= self.rtol
        if self.done:
            return
        if slope:
            if self.rising not in (None, bool(slope > 0)):
                raise AssertionError("The function does not respect the expected monotonicity.")
            self.rising = bool(slope > 0)
        if bool(error > 0) == (self.rising is not False):
            self.high = self.x
        else:
            self.low = self.x
        new = self.x - error / slope if slope else INF
        if slow or not self.low < new < self.high:
            new = self._within()
        self.steps.append(abs(new - self.x) / abs(self.x) if self.x else 1.0)
        self.x = new
        self.xs.append(new)

    def _within(self) -> float:
        if self.low > -INF and self.high < INF:
            return self.low + (self.high - self.low) / 2
        self.reach = 2 * self.reach if self.reach else abs(self.x) or 1.0
        return self.low + self.reach if self.low > -INF else self.high - self.reach if self.high < INF else 0.0

    def solution(self) -> Solution:
        return Solution(self.x, self.target, self.n, self.max_iter, self.atol, self.rtol, "newton", self.xs, self.steps, self.fs)


def solve(fun: Callable[[Sequence[float], Sequence[int]], Sequence[tuple[float, float]]], equations: list[Newton], verbose: bool = False) -> list[Solution]:
    """Advances all equations together: ``fun`` gets the places and numbers of those not done yet and gives (value, slope) of each."""
    while todo := [i for i, e in enumerate(equations) if not e.done]:
        for i, (value, slope) in zip(todo, fun([equations[i].x for i in todo], todo), strict=True):
            equations[i].feed(value, slope)
        if verbose:
            print("; ".join(f"{i}: x = {equations[i].x:.6g}, f = {equations[i].f:.6g}" for i in todo))
    return [e.solution() for e in equations]


def monotonic_newton_solver(x0, fun, target, atol=1e-24, rtol=1e-9, max_iter=100, x_l=-INF, x_u=INF, f_l=None, f_u=None, full_return=False, verbose=False):
    """x with fun(x)[0] = target; fun gives value and slope. With ``full_return`` the whole Solution. Values at the bounds (``f_l``, ``f_u``) may be given; the method needs none."""
    out = solve(lambda xs, _: [fun(xs[0])], [Newton(float(x0), target, atol, rtol, max_iter, x_l, x_u)], verbose)[0]
    return out if full_return else out.x
