"""Synthetic shapes for the tests."""

import numpy as np


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def random_rotation(rng, most=np.pi):
    axis = unit(rng.normal(size=(1, 3)))[0]
    a = rng.uniform(0, most)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def sphere(rng, n, noise=0.005, bump=False, with_gt=False):
    d = unit(rng.normal(size=(n, 3)))
    r = 1 + noise * rng.normal(size=(n, 1))
    gt = np.zeros(n)
    if bump:
        c = unit(rng.normal(size=(1, 3)))[0]
        hit = d @ c > 0.93
        r[hit] += 0.12
        gt = hit.astype(float)
    return (d * r, gt) if with_gt else d * r


def ridged(rng, n, defect=False, half=False):
    """Ellipsoid with ridges, so that a pose is identifiable."""
    d = unit(rng.normal(size=(n * (2 if half else 1), 3)))
    if half:
        d = d[d[:, 2] > 0.05][:n]
    ang = np.arctan2(d[:, 1], d[:, 0])
    r = 1 + 0.08 * np.cos(3 * ang) * (1 - d[:, 2] ** 2) + 0.15 * np.maximum(d @ unit(np.array([[1.0, 0.4, 0.3]]))[0] - 0.7, 0)
    gt = np.zeros(len(d))
    if defect:
        c = d[rng.integers(len(d))]
        hit = d @ c > 0.9
        r = r + 0.15 * hit
        gt = hit.astype(float)
    return d * r[:, None] * np.array([1.0, 0.7, 0.5]) + 0.003 * rng.normal(size=d.shape), gt
