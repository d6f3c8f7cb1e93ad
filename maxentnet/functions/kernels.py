"""Link probabilities as Column expressions. A kernel of one's own overrides the four methods; Catalyst compiles them into the plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def none_if_zero(z, x, y) -> Column:
    """t = z x y, 0 where a factor is 0 even if another is infinite."""
    return F.nanvl(lit(z) * lit(x) * lit(y), F.lit(0.0))


class Kernel:
    """Functions of z, the fitnesses x (out) and y (in) and a dyadic factor c, by t = z x y c.

    A zero factor gives p = 0 even where another is infinite; t = inf gives p = 1.
    """

    def _guarded(self, z, x, y, c, zero: float, infinite: float, otherwise) -> Column:
        z, x, y, c = lit(z), lit(x), lit(y), lit(c)
        t = z * x * y * c
        none = (z == 0) | (x == 0) | (y == 0) | (c == 0)
        return F.when(none, F.lit(zero)).when(t == INF, F.lit(infinite)).otherwise(otherwise(t))

    def p(self, z, x, y, c=1.0) -> Column:
        raise NotImplementedError

    def jac(self, z, x, y, c=1.0) -> Column:
        """dp/dz."""
        raise NotImplementedError

    def logp(self, z, x, y, c=1.0) -> Column:
        raise NotImplementedError

    def log1mp(self, z, x, y, c=1.0) -> Column:
        """ln(1 - p)."""
        raise NotImplementedError

    # of several layers between the same two nodes: a sum over layers, and what becomes of it

    def layer_term(self, z, x, y) -> Column:
        """-ln(1 - p) of a layer."""
        return -self.log1mp(z, x, y)

    def layer_slope(self, z, x, y) -> Column:
        """d/dz of the layer's term."""
        raise NotImplementedError

    # the same with all layers (z, x, y) side by side in a row: a number that adds up over layers, and what it tells

    def gathered(self, t: DataFrame, name: str, layers: Sequence[tuple]) -> DataFrame:
        """``t`` with a column that ``any_link`` and ``no_link`` read; here the sum of the layers' terms."""
        return t.withColumn(name, reduce(lambda a, b: a + b, (self.layer_term(*f) for f in layers)))

    def any_link(self, held: Column) -> Column:
        return -F.expm1(-held)

    def no_link(self, held: Column) -> Column:
        return F.exp(-held)

    def log_no_link(self, t: DataFrame, name: str, layers: Sequence[tuple]) -> DataFrame:
        """``t`` with a column of -ln(1 - p) of a link in any layer."""
        return self.gathered(t, name, layers)


class Logistic(Kernel):
    """p = t / (1 + t)."""

    def p(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, 0.0, 1.0, lambda t: t / (1 + t))

    def jac(self, z, x, y, c=1.0):
        xy = lit(x) * lit(y) * lit(c)
        return F.when(xy == 0, 0.0).when(lit(z) * xy == INF, 0.0).otherwise(xy / ((1 + lit(z) * xy) * (1 + lit(z) * xy)))

    def logp(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, -INF, 0.0, lambda t: F.log(t) - F.log1p(t))

    def log1mp(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, 0.0, -INF, lambda t: -F.log1p(t))

    def layer_slope(self, z, x, y):
        xy = lit(x) * lit(y)
        return F.when((xy == 0) | (lit(z) * xy == INF), 0.0).otherwise(xy / (1 + lit(z) * xy))

    # the odds of a link in any layer: 1 + u is the product of 1 + t, so that pairs need no logarithm

    def gathered(self, t, name, layers):
        rates = [none_if_zero(*f) for f in layers]
        t = t.withColumn(name, rates[0])
        for rate in rates[1:]:  # a projection each, as u is read twice
            t = t.withColumn(name, F.col(name) + F.nanvl(rate * (1 + F.col(name)), F.lit(0.0)))
        return t

    def any_link(self, held):
        return F.nanvl(held / (1 + held), F.lit(1.0))

    def no_link(self, held):
        return 1 / (1 + held)

    def log_no_link(self, t, name, layers):
        # a product may be too large where its logarithm is not
        log = F.when(F.col(name) < INF, F.log1p(F.col(name))).otherwise(reduce(lambda a, b: a + b, (self.layer_term(*f) for f in layers)))
        return self.gathered(t, name, layers).withColumn(name, log)


class Exponential(Kernel):
    """p = 1 - exp(-t): the same for nodes and for groups of them."""

    def p(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, 0.0, 1.0, lambda t: -F.expm1(-t))

    def jac(self, z, x, y, c=1.0):
        xy = lit(x) * lit(y) * lit(c)
        return F.when((xy == 0) | (lit(z) * xy == INF), 0.0).otherwise(xy * F.exp(-lit(z) * xy))

    def logp(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, -INF, 0.0, lambda t: F.log(-F.expm1(-t)))

    def log1mp(self, z, x, y, c=1.0):
        return self._guarded(z, x, y, c, 0.0, -INF, lambda t: -t)

    def layer_term(self, z, x, y):
        return none_if_zero(z, x, y)

    def layer_slope(self, z, x, y):
        xy = lit(x) * lit(y)
        return F.when(lit(z) * xy == INF, 0.0).otherwise(xy)


def any_layer(term: Column) -> Column:
    """Chance of a link in any layer from the sum of the layers' terms."""
    return F.when(term == INF, 1.0).otherwise(-F.expm1(-term))


def log_any_layer(term: Column) -> Column:
    return F.when(term == 0, -INF).when(term == INF, 0.0).otherwise(F.log(-F.expm1(-term)))
