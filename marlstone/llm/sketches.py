"""Comparing short bit sketches within buckets, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from .common import whole_groups


def apart_by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def connected(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def close_links(most: int, width: int, small: int = 12):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by _key to (a, b): links that connect, within a bucket, what differs in at most ``most`` of the ``width`` bits in _c0, _c1 ..."""
        for rows in whole_groups(batches, "_key"):
            key, fp = rows["_key"].to_numpy(), rows["_fp"].to_numpy()
            check = rows[[f"_c{k}" for k in range(width // 64)]].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            left, right = [], []
            for d in range(1, min(small, int(sizes.max()))):
                i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= small))
                i = i[apart_by(check[i], check[i + d]) <= most]
                left.append(i)
                right.append(i + d)
            for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                own = check[s : s + n]
                for k in range(0, n, 256):
                    near = np.zeros((min(256, n - k), n - k), dtype=np.int16)
                    for w in range(own.shape[1]):
                        near += np.bitwise_count(own[k : k + 256, None, w] ^ own[None, k:, w])
                    i, j = np.nonzero(np.triu(near <= most, 1))
                    left.append(i + s + k)
                    right.append(j + s + k)
            i, j = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
            root = connected(i, j, len(fp))
            linked = fp[root] != fp
            yield pd.DataFrame({"a": fp[root[linked]], "b": fp[linked]}).drop_duplicates()

    return run
