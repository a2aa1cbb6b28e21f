"""Numeric kernels in numpy for Arrow tasks: zeta, log-gamma and lock-step root refinement."""

from __future__ import annotations

import numpy as np

#: Terms of the correction in zeta.
CORRECTIONS = 26
#: Height from which on the asymptotic formula of Z has a proven bound of its error.
ASYMPTOTIC_FROM = 200.0


def _coefficients(n: int) -> np.ndarray:
    """Bernoulli numbers over factorials, B2 / 2!, B4 / 4!, ..., from the even values of zeta."""
    k = np.arange(1, n + 1)
    even = 1 + (np.arange(2, 60)[:, None] ** (-2.0 * k)).sum(0)
    even[0], even[1] = np.pi**2 / 6, np.pi**4 / 90
    return 2 * (-1.0) ** (k + 1) * even / (2 * np.pi) ** (2 * k)


def zeta(s: np.ndarray) -> np.ndarray:
    """zeta of complex s with real part above 0, s other than 1, by Euler-Maclaurin summation.

    The sum has about a third of |s| terms; each correction then is under a quarter of the one before.
    """
    s = np.asarray(s, np.complex128)
    out = np.empty_like(s)
    coefficients = _coefficients(CORRECTIONS)
    for k in range(0, len(s), 256):
        x = s[k : k + 256, None]
        n = int(np.abs(x.imag).max(initial=0) / 3) + 40
        total = np.exp(-x * np.log(np.arange(1, n))).sum(1)
        x = x[:, 0]
        at = np.exp(-x * np.log(n))
        total += n * at / (x - 1) + at / 2
        term = x * at / n
        for j, c in enumerate(coefficients):
            total += c * term
            term = term * ((x + 2 * j + 1) / n) * ((x + 2 * j + 2) / n)
        out[k : k + 256] = total
    return out


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Principal ln Gamma for positive real parts: recurrence, then Stirling's series."""
    z = np.asarray(z, np.complex128)
    shift = sum(np.log(z + k) for k in range(12))
    y = z + 12
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def theta(t: np.ndarray) -> np.ndarray:
    t = np.asarray(t, float)
    return log_gamma(0.25 + 0.5j * t).imag - t / 2 * np.log(np.pi)


def hardy_z(t: np.ndarray) -> np.ndarray:
    t = np.asarray(t, float)
    return (np.exp(1j * theta(t)) * zeta(0.5 + 1j * t)).real


def hardy_z_signs(t: np.ndarray) -> np.ndarray:
    """Values with the signs of Z: the asymptotic formula with sqrt(t / 2 pi) terms, exact values where it may have another sign.

    With its first correction the formula is within 0.127 t**-0.75 from ASYMPTOTIC_FROM on.
    """
    t = np.asarray(t, float)
    root = np.sqrt(t / (2 * np.pi))
    n = np.floor(root)
    p = root - n
    angle = theta(t)
    terms = np.arange(1, int(n.max(initial=1)) + 1)
    parts = np.cos(angle[:, None] - t[:, None] * np.log(terms)) / np.sqrt(terms)
    below = np.cos(2 * np.pi * p)
    with np.errstate(divide="ignore", invalid="ignore"):
        correction = np.cos(2 * np.pi * (p * p - p - 1 / 16)) / below
    out = 2 * (parts * (terms <= n[:, None])).sum(1) - (-1.0) ** n * correction / np.sqrt(root)
    doubtful = (t < ASYMPTOTIC_FROM) | (np.abs(below) < 1e-3) | ~(np.abs(out) > 2 * 0.127 * t**-0.75)
    out[doubtful] = hardy_z(t[doubtful])
    return out


def real_zeta(t: np.ndarray) -> np.ndarray:
    return zeta(0.5 + 1j * np.asarray(t, float)).real


def residual(t: np.ndarray) -> np.ndarray:
    return np.abs(zeta(0.5 + 1j * np.asarray(t, float)))


def illinois(f, a: np.ndarray, b: np.ndarray, tol: float = 4e-16, rounds: int = 150) -> np.ndarray:
    """Roots of f in all brackets (a, b) at once by the Illinois method; NaN where the ends have one sign."""
    return illinois_rows(lambda x, _: f(x), a, b, tol, rounds)


def illinois_rows(f, a: np.ndarray, b: np.ndarray, tol: float = 4e-16, rounds: int = 150) -> np.ndarray:
    """The same for a function of its own in each bracket: f(x, rows) gives the values of those rows' functions."""
    a, b = np.array(a, float), np.array(b, float)
    every = np.arange(len(a))
    fa, fb = f(a, every), f(b, every)
    out = np.where(fa == 0, a, np.where(fb == 0, b, np.nan))
    live = np.flatnonzero(fa * fb < 0)
    a, b, fa, fb = a[live], b[live], fa[live], fb[live]
    for _ in range(rounds):
        if not len(live):
            break
        c = (a * fb - b * fa) / (fb - fa)
        fc = f(c, live)
        crossed = fc * fb < 0
        a, fa = np.where(crossed, b, a), np.where(crossed, fb, fa / 2)
        done = (np.abs(c - b) <= tol * np.maximum(1, np.abs(c))) | (fc == 0)
        b, fb = c, fc
        out[live[done]] = c[done]
        keep = ~done
        live, a, b, fa, fb = live[keep], a[keep], b[keep], fa[keep], fb[keep]
    out[live] = b
    return out


def bisect(f, a: np.ndarray, b: np.ndarray, rounds: int = 45) -> np.ndarray:
    """Roots by a fixed number of halvings; NaN where the ends have one sign."""
    a, b = np.array(a, float), np.array(b, float)
    fa = f(a)
    fine = fa * f(b) < 0
    for _ in range(rounds):
        c = (a + b) / 2
        same = fa * f(c) > 0
        a, b = np.where(same, c, a), np.where(same, b, c)
    return np.where(fine, (a + b) / 2, np.nan)


def newton(f, a: np.ndarray, b: np.ndarray, tol: float = 1e-13, rounds: int = 50) -> np.ndarray:
    """Roots by Newton's method from the middle of each bracket, with the slope taken from differences.

    A root that leaves its bracket or does not settle is found by halving; NaN where the ends have one sign.
    """
    a, b = np.array(a, float), np.array(b, float)
    x, live, done = (a + b) / 2, np.arange(len(a)), np.zeros(len(a), bool)
    for _ in range(rounds):
        if not len(live):
            break
        h = 1e-6 * np.maximum(1.0, np.abs(x[live]))
        slope = (f(x[live] + h) - f(x[live] - h)) / (2 * h)
        step = np.divide(f(x[live]), slope, out=np.full(len(live), np.inf), where=slope != 0)
        after = x[live] - step
        inside = (after >= a[live]) & (after <= b[live])
        x[live[inside]] = after[inside]
        settled = inside & (np.abs(step) <= tol * np.maximum(1.0, np.abs(after)))
        done[live[settled]] = True
        live = live[inside & ~settled]
    rest = np.flatnonzero(~done)
    if len(rest):
        x[rest] = bisect(f, a[rest], b[rest])
    return x
