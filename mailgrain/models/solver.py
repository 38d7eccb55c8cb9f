"""L-BFGS of L2-regularised linear classifiers over combinations of training mails.

The weights of such a model are always X'a, a combination of the training rows, and so are its gradients. With K = X X' every
inner product the method needs is one of mails: <X'a, X'c> = a . Kc. So a fit keeps a few numbers per mail, whatever the number
of terms, and asks for one product K r per round; the line search needs none, because margins are linear in the step.
"""

import numpy as np

HISTORY = 6


class _Vector:
    """X'a and an intercept, with the margins z = K a at hand."""
    __slots__ = ("a", "z", "b")

    def __init__(self, a, z, b):
        self.a, self.z, self.b = a, z, b

    def plus(self, other, t):
        return _Vector(self.a + t * other.a, self.z + t * other.z, self.b + t * other.b)

    def times(self, t):
        return _Vector(t * self.a, t * self.z, t * self.b)

    def dot(self, other):
        return float(self.a @ other.z) + self.b * other.b


def _logistic(margin, sign, share):
    m = sign * margin
    return float(share @ np.logaddexp(0.0, -m)), -sign * share * np.exp(-np.logaddexp(0.0, m))


def _hinge(margin, sign, share):
    gap = 1.0 - sign * margin
    return float(share @ np.maximum(gap, 0.0)), np.where(gap > 0, -sign * share, 0.0)


LOSSES = {"logreg": _logistic, "svm": _hinge}


def solve(label, share, reg: float, loss: str, max_iter: int, tol: float = 1e-5):
    """Generator: yields r, is sent K r; returns (a, intercept). Minimises share . loss + reg / 2 |w|^2."""
    sign, measure = 2.0 * label - 1.0, LOSSES[loss]
    w = _Vector(np.zeros(len(label)), np.zeros(len(label)), 0.0)

    def objective(v):
        value, r = measure(v.z + v.b, sign, share)
        return value + reg / 2 * float(v.a @ v.z), r

    value, r = objective(w)
    start, seen, pairs = value, [value], []
    g = _Vector(r, (yield r), float(r.sum()))
    for _ in range(max_iter):
        if g.dot(g) <= (tol * max(abs(value), 1e-3)) ** 2:
            break
        d, coefs = g, []
        for s, y, rho in reversed(pairs):
            coefs.append(rho * s.dot(d))
            d = d.plus(y, -coefs[-1])
        if pairs:
            s, y, _ = pairs[-1]
            d = d.times(s.dot(y) / y.dot(y))
        for (s, y, rho), c in zip(pairs, reversed(coefs)):
            d = d.plus(s, c - rho * y.dot(d))
        d = d.times(-1.0)
        if g.dot(d) >= 0:
            pairs, d = [], g.times(-1.0)
        t = _step(w, d, g.dot(d), reg, measure, sign, share, 1.0 if pairs else 1.0 / np.sqrt(g.dot(g)))
        nxt = w.plus(d, t)
        found, r = objective(nxt)
        if not found < value:
            if not pairs:
                break
            pairs = []  # no descent along this direction: start again from the gradient
            continue
        w, value = nxt, found
        kr = yield r
        new = _Vector(r + reg * w.a, kr + reg * w.z, float(r.sum()))
        s, y = d.times(t), new.plus(g, -1.0)
        if s.dot(y) > 1e-14:
            pairs = [*pairs[1 - HISTORY:], (s, y, 1.0 / s.dot(y))]
        g = new
        seen = [*seen[-19:], value]
        if len(seen) > 3 and max(seen) - value <= tol * start:
            break
    return w.a, w.b


def _step(w, d, slope, reg, measure, sign, share, t):
    """A step where the slope along `d` has fallen to a tenth; the objective is convex along it."""
    linear, square = reg * float(w.a @ d.z), reg * float(d.a @ d.z)
    along = d.z + d.b

    def at(t):
        return float(measure(w.z + w.b + t * along, sign, share)[1] @ along) + linear + t * square

    low, high = 0.0, None
    for _ in range(40):
        found = at(t)
        if abs(found) <= 0.1 * abs(slope):
            return t
        if found < 0:
            low = t
            t = 2 * t if high is None else (low + high) / 2
        else:
            high = t
            t = (low + high) / 2
    return t if low == 0.0 else low


def solve_together(problems, product) -> list:
    """Results of several `solve` generators; `product(vectors, which)` answers all that still run in one pass."""
    waiting, results = {}, [None] * len(problems)
    for i, p in enumerate(problems):
        waiting[i] = next(p)
    while waiting:
        which = sorted(waiting)
        for i, answer in zip(which, product([waiting[i] for i in which], which)):
            try:
                waiting[i] = problems[i].send(answer)
            except StopIteration as end:
                results[i] = end.value
                del waiting[i]
    return results
