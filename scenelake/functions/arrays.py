"""Stencils on whole frames that are held as arrays, the same as the windows over pixel tables in operators/masks.py.

Rows and columns of a frame are the first two axes; further ones, such as one for many frames, go along.
"""

from __future__ import annotations

import numpy as np

#: The eight neighbours of a pixel and itself, and the four beside, above and below it.
AROUND = [(dv, du) for dv in (-1, 0, 1) for du in (-1, 0, 1)]
BESIDE = [(-1, 0), (0, -1), (1, 0), (0, 1)]


def shifted(x: np.ndarray, dv: int, du: int, fill: float = 0) -> np.ndarray:
    """Values of the pixel so many rows and columns on, ``fill`` outside of the frame."""
    out = np.full_like(x, fill)
    h, w = x.shape[:2]
    if h > abs(dv) and w > abs(du):
        out[max(0, -dv) : h - max(0, dv), max(0, -du) : w - max(0, du)] = x[max(0, dv) : h - max(0, -dv), max(0, du) : w - max(0, -du)]
    return out


def depth_edges(d: np.ndarray, rtol: float = 0.03) -> np.ndarray:
    """Depth edges: the spread of the positive depths among the 3 x 3 around a pixel, against its own."""
    most = np.maximum.reduce([shifted(np.where(d > 0, d, -np.inf), *s, fill=-np.inf) for s in AROUND])
    least = np.minimum.reduce([shifted(np.where(d > 0, d, np.inf), *s, fill=np.inf) for s in AROUND])
    return np.where(d > 0, most - least > rtol * np.where(d > 0, d, 1), most - least > 0)


def normals(points: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (height, width, ..., 3) from the four cross products of differences to neighbours, and where there are any."""
    own = np.where(valid[..., None], points, 0.0)
    delta = [shifted(own, *s) - own for s in BESIDE]
    ok = [shifted(valid, *s) for s in BESIDE]
    total, some = np.zeros_like(own), np.zeros_like(valid)
    for i in range(4):
        both, c = ok[i] & ok[(i + 1) % 4] & valid, np.cross(delta[i], delta[(i + 1) % 4])
        total += np.where(both[..., None], c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12), 0.0)
        some |= both
    return total / np.maximum(np.linalg.norm(total, axis=-1, keepdims=True), 1e-12), some


def normal_edges(points: np.ndarray, valid: np.ndarray, degrees: float = 5.0) -> np.ndarray:
    """Normal edges: the largest angle to a valid neighbour's normal, spread to the neighbours, is large.

    The product of a normal with a neighbour's is the neighbour's with it, so four of the eight are computed.
    """
    normal, some = normals(points, valid)
    least = np.where(some, np.minimum(1.0, (normal * normal).sum(-1)), 1.0)
    for s in AROUND[5:]:
        back = (-s[0], -s[1])
        dot = (normal * shifted(normal, *s)).sum(-1)
        least = np.where(shifted(some, *s), np.minimum(least, dot), least)
        least = np.where(shifted(some, *back), np.minimum(least, shifted(dot, *back)), least)
    angle = np.arccos(np.clip(least, -1, 1))
    return (np.maximum.reduce([shifted(angle, *s) for s in AROUND]) > np.radians(degrees)) & some


def edges(points: np.ndarray, valid: np.ndarray, rtol: float = 0.03, degrees: float = 5.0) -> np.ndarray:
    """Depth and normal edge at once."""
    return depth_edges(np.where(valid, points[..., 2], 0.0), rtol) & normal_edges(points, valid, degrees)
