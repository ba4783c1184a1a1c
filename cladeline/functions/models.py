"""Reversible nucleotide models, transition matrices and rate mixtures (NumPy, on the driver)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = "ACGT"
#: Order of the six exchangeabilities.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


@dataclass(frozen=True)
class NucleotideModel:
    """Stationary frequencies, root frequencies, exchangeabilities (AC AG AT CG CT GT) and overall rate."""

    pi: tuple[float, ...]
    exch: tuple[float, ...]
    rate: float = 1.0
    root_pi: tuple[float, ...] | None = None

    @property
    def root(self) -> np.ndarray:
        return np.array(self.pi if self.root_pi is None else self.root_pi, float)

    def validate(self) -> NucleotideModel:
        pi, root, exch = np.array(self.pi, float), self.root, np.array(self.exch, float)
        if pi.shape != (4,) or root.shape != (4,) or exch.shape != (6,):
            raise ValueError("a model has 4 frequencies and 6 exchangeabilities")
        if not (np.isfinite(pi).all() and (pi > 0).all() and abs(pi.sum() - 1) <= 1e-6):
            raise ValueError("stationary frequencies must be positive and sum to 1")
        if not (np.isfinite(root).all() and (root >= 0).all() and abs(root.sum() - 1) <= 1e-6):
            raise ValueError("root frequencies must not be negative and must sum to 1")
        if not (np.isfinite(exch).all() and (exch >= 0).all()):
            raise ValueError("exchangeabilities must be finite and not negative")
        if not (math.isfinite(self.rate) and self.rate >= 0):
            raise ValueError("the rate must be finite and not negative")
        return self


@dataclass(frozen=True)
class RateMixture:
    """Rates and weights of site categories; none of either is one category of rate 1."""

    rates: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def __post_init__(self):
        r, w = np.array(self.rates, float), np.array(self.weights, float)
        if len(r) != len(w):
            raise ValueError("as many weights as rates")
        if len(r) and not (np.isfinite(r).all() and (r > 0).all() and np.isfinite(w).all() and (w > 0).all()):
            raise ValueError("rates and weights must be positive and finite")
        if len(r) and abs(w.sum() - 1) > 1e-12:
            raise ValueError("weights must sum to 1")

    @property
    def count(self) -> int:
        return len(self.rates) or 1

    def rate(self, category: int) -> float:
        self._check(category)
        return self.rates[category] if self.rates else 1.0

    def weight(self, category: int) -> float:
        self._check(category)
        return self.weights[category] if self.weights else 1.0

    def _check(self, category: int) -> None:
        if not 0 <= category < self.count:
            raise IndexError(f"no category {category}")


def jukes_cantor(rate: float = 1.0) -> NucleotideModel:
    return NucleotideModel((0.25,) * 4, (1.0,) * 6, rate).validate()


def hky(pi: Sequence[float], kappa: float, rate: float = 1.0) -> NucleotideModel:
    if not (math.isfinite(kappa) and kappa >= 0):
        raise ValueError("kappa must be finite and not negative")
    return NucleotideModel(tuple(pi), (1.0, kappa, 1.0, 1.0, kappa, 1.0), rate).validate()


def gtr(pi: Sequence[float], exch: Sequence[float], rate: float = 1.0) -> NucleotideModel:
    return NucleotideModel(tuple(pi), tuple(exch), rate).validate()


def select_category(model: NucleotideModel, mixture: RateMixture, category: int) -> NucleotideModel:
    """The single-rate model of one category."""
    return replace(model, rate=model.rate * mixture.rate(category))


def rate_matrix(model: NucleotideModel) -> np.ndarray:
    """Row sums 0, one expected change per unit of time at stationarity; the overall rate is left out."""
    model.validate()
    pi = np.array(model.pi, float)
    q = np.zeros((4, 4))
    for (i, j), x in zip(PAIRS, model.exch, strict=True):
        q[i, j], q[j, i] = x * pi[j], x * pi[i]
    np.fill_diagonal(q, -q.sum(axis=1))
    flow = -(pi * np.diag(q)).sum()
    if not (math.isfinite(flow) and flow > 0):
        raise ValueError("the expected rate must be positive")
    return q / flow


def exponentials(q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """exp(q t) for all t at once: uniformisation with scaling and squaring.

    t = 0 or q = 0 gives the identity exactly.  All terms are sums of products of numbers that are not
    negative, so nothing cancels.
    """
    times = np.asarray(times, float)
    lam = float(-np.diag(q).min())
    out = np.broadcast_to(np.eye(4), (len(times), 4, 4)).copy()
    live = np.flatnonzero(times * lam > 0)
    if not len(live):
        return out
    mean = times[live] * lam
    halvings = np.maximum(0, np.ceil(np.log2(np.maximum(mean, 1e-300) / 0.5))).astype(int)
    mean = mean / 2.0**halvings
    step = np.eye(4) + q / lam
    weight, power, total = np.exp(-mean), np.eye(4), np.zeros((len(live), 4, 4))
    for k in range(256):
        total += weight[:, None, None] * power
        weight = weight * mean / (k + 1)
        power = power @ step
        if weight.max() <= np.finfo(float).eps / 4:
            break
    for k in range(int(halvings.max(initial=0))):
        more = halvings > k
        total[more] = total[more] @ total[more]
    total = np.maximum(total, 0)
    out[live] = total / total.sum(axis=2, keepdims=True)
    return out


def scaled_times(model: NucleotideModel, lengths: np.ndarray, category_rate: float = 1.0) -> np.ndarray:
    """Rate times length of edges, all finite."""
    lengths = np.asarray(lengths, float)
    if not (np.isfinite(lengths).all() and (lengths >= 0).all()):
        raise ValueError("branch lengths must be finite and not negative")
    with np.errstate(over="ignore"):
        times = lengths * model.rate * category_rate
    if not np.isfinite(times).all():
        raise ValueError("rate times length overflows")
    return times


def transitions(model: NucleotideModel, lengths: np.ndarray, category_rate: float = 1.0) -> np.ndarray:
    """[edge, parent state, child state]; each distinct time is worked out once."""
    times, at = np.unique(scaled_times(model, lengths, category_rate), return_inverse=True)
    return exponentials(rate_matrix(model), times)[at]


def jukes_cantor_transition(t: float, rate: float = 1.0) -> np.ndarray:
    return transitions(jukes_cantor(rate), np.array([t]))[0]


def jukes_cantor_columns(length: Column, rate: float = 1.0) -> tuple[Column, Column]:
    """(the probability of each other state, of the same one) over a length, in closed form and in the JVM."""
    other = -0.25 * F.expm1(-4.0 * rate / 3.0 * length)
    return other, 1.0 - 3.0 * other


def regularized_gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma function: a series for small x, a continued fraction else."""
    if not (a > 0 and x >= 0):
        raise ValueError("a must be positive and x not negative")
    if x == 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if abs(term) < abs(total) * 1e-16:
                return min(1.0, front * total)
        raise ArithmeticError("the series does not converge")
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 4e-16:
            return max(0.0, 1 - front * h)
    raise ArithmeticError("the fraction does not converge")


def gamma_quantile(a: float, p: float) -> float:
    """x with P(a, x) = p, for a gamma variable of rate 1, by bisection."""
    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    low, high = 0.0, max(1.0, a)
    while regularized_gamma_p(a, high) < p:
        high *= 2
    for _ in range(300):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if regularized_gamma_p(a, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def discrete_gamma(shape: float, categories: int) -> RateMixture:
    """Equally likely categories, each with its conditional mean; the mean of all is 1."""
    if not (math.isfinite(shape) and shape > 0) or categories < 1:
        raise ValueError("the shape must be positive and there must be a category")
    if categories == 1:
        return RateMixture((1.0,), (1.0,))
    cuts = [0.0, *(gamma_quantile(shape, k / categories) for k in range(1, categories)), math.inf]
    mass = [regularized_gamma_p(shape + 1, c) for c in cuts]
    rates = categories * np.diff(mass)
    rates /= rates.mean()
    return RateMixture(tuple(rates.tolist()), (1 / categories,) * categories)


@dataclass
class SpectralForm:
    """P(t) = sum over k of exp(lam[k] t) coef[k]: an independent route to transitions, also for SQL."""

    lam: np.ndarray = field(default_factory=lambda: np.zeros(0))
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 4)))


def spectral_form(model: NucleotideModel) -> SpectralForm:
    q, root = rate_matrix(model), np.sqrt(np.array(model.pi, float))
    lam, v = np.linalg.eigh(root[:, None] * q / root[None, :])
    return SpectralForm(lam * model.rate, np.stack([np.outer(v[:, k] / root, v[:, k] * root) for k in range(4)]))
