"""A random forest of regression trees on binned features, grown level by level in numpy, groups of nodes apart: one task grows a forest.

Bins come from quantiles of the features. Trees are grown on Poisson bootstraps, every node choosing among its own draw of the
features; a split needs `least` bootstrapped rows on both sides.
"""

from __future__ import annotations

import numpy as np

BINS = 64
#: Rows of nodes that are split together, so few that their arrays stay in a core's cache.
TOGETHER = 2**15


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """One byte per row and feature: the number of cuts below the value."""
    return np.column_stack([np.searchsorted(c, x).astype(np.uint8) for x, c in zip(columns, cuts)])


def coded(x: np.ndarray, onehot: list[np.ndarray]) -> np.ndarray:
    """x with a last column for 0/1 features of which every row has one: the number of that one."""
    return np.column_stack([x, np.argmax(np.column_stack(onehot), axis=1).astype(np.uint8)])


def _reduction(low: np.ndarray, left: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """What splits take off the squares around the nodes' means, over the nodes' rows. low: sums around the mean on one side, of `left` rows; both are overwritten."""
    right = size - left
    low *= low
    low *= (left >= least) & (right >= least)
    left *= right
    low /= np.maximum(left, 1, out=left)
    return low


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int, codes: int = 0) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """(tree, rows of its bootstrap, their leaves). A tree: feature, cut, left child and mean of every node; a leaf is its own child.

    With `codes`, the last column of x stands for so many 0/1 features. One histogram of it has the splits of all of these, so that
    a row is counted once for them and once per other feature that its node has drawn.
    """
    stride = x.shape[1]
    plain = stride - (codes > 0)
    width = plain + codes
    weight = rng.poisson(1.0, len(x))
    bag = np.flatnonzero(weight)
    w = weight[bag].astype(float)
    leaf, size = np.zeros(len(bag), np.int64), 1
    parts = []  # per level of some nodes: ids, feature, cut, child, mean
    step = max(BINS, codes)  # keys of a node
    todo = [(0, np.zeros(1, np.int64), x, bag, np.arange(len(bag)), w, w * y[bag], np.zeros(len(bag), np.int64))]
    while todo:
        first, ids, x, at, own, w, wy, node = todo.pop()
        flat = x.ravel()
        for level in range(first, depth + 1):
            k = len(ids)
            rows, total = np.bincount(node, w, k), np.bincount(node, wy, k)
            mean = total / np.maximum(rows, 1)
            feature, cut, child, best = np.zeros(k, np.int64), np.full(k, 255, np.int64), ids.copy(), np.zeros(k)
            large = rows >= 2 * least  # others can't be split
            if level < depth and large.any():
                number, place_, node_ = np.cumsum(large) - 1, at * stride, node
                w_, wy_ = w, wy
                if not large.all():
                    keep = np.flatnonzero(large[node])
                    place_, node_, w_, wy_ = place_[keep], number[node[keep]], w[keep], wy[keep]
                start, n = node_ * step, int(large.sum())
                chosen, size_ = np.sort(np.argsort(rng.random((n, width)), axis=1)[:, :tries], axis=1), rows[large]
                mean_ = mean[large]
                most, which, where = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

                def offered(of: np.ndarray, g: np.ndarray, f: np.ndarray, c: np.ndarray) -> None:
                    better = g > np.maximum(most[of], 1e-12)
                    to = of[better]
                    most[to], which[to], where[to] = g[better], f[better], c[better]

                drawn = (chosen < plain).sum(axis=1)  # of the features with a column of their own, which come first
                if codes and (drawn < chosen.shape[1]).any():
                    key = flat[place_ + plain] + start
                    right, high = (np.bincount(key, x_, n * step).reshape(n, step)[:, :codes] for x_ in (w_, wy_))
                    g = _reduction(high - right * mean_[:, None], right.copy(), size_[:, None], least)
                    g = np.where(chosen >= plain, np.take_along_axis(g, np.maximum(chosen - plain, 0), axis=1), 0)
                    c = g.argmax(axis=1)
                    each = np.arange(n)
                    offered(each, g[each, c], chosen[each, c], np.zeros(n, np.int64))
                nodes = np.arange(n)
                for j in range(int(drawn.max())):
                    has = drawn > j
                    if has.mean() < 0.75:  # else leaving the others' rows out costs more than counting them
                        number = np.cumsum(has) - 1
                        keep = np.flatnonzero(has[node_])
                        place_, node_, w_, wy_ = place_[keep], number[node_[keep]], w_[keep], wy_[keep]
                        chosen, size_, mean_, drawn, nodes, has = chosen[has], size_[has], mean_[has], drawn[has], nodes[has], has[has]
                        start = node_ * step
                    m, f = len(nodes), np.minimum(chosen[:, j], plain - 1)
                    key = flat[place_ + f[node_]] + start
                    left, low = (np.bincount(key, x_, m * step).reshape(m, step)[:, :BINS].cumsum(axis=1) for x_ in (w_, wy_))
                    low -= left * mean_[:, None]
                    low = _reduction(low, left, size_[:, None], least)
                    c = low.argmax(axis=1)
                    offered(nodes, np.where(has, low[np.arange(m), c], 0), f, c)
                best[large] = most
                feature[large], cut[large] = which, np.where(most > 0, where, 255)
                feature[best <= 0] = 0
            split = best > 0
            number = np.cumsum(split) - 1
            child[split] = size + 2 * number[split]
            parts.append((ids, feature, cut, child, mean))
            if not split.all():
                goes = split[node]
                stays = np.flatnonzero(~goes)
                leaf[own[stays]] = ids[node[stays]]
                if not split.any():
                    break
                goes = np.flatnonzero(goes)
                at, own, w, wy, node = at[goes], own[goes], w[goes], wy[goes], node[goes]
            node = 2 * number[node] + _right(flat, at * stride, plain, codes, feature, cut, node)
            ids = np.arange(size, size + 2 * int(split.sum()))
            size += len(ids)
            if len(ids) >= 8 and len(at) > TOGETHER:
                order = np.argsort(node.astype(np.uint16) if len(ids) < 2**16 else node, kind="stable")
                ends = np.cumsum(np.bincount(node, minlength=len(ids)))
                until = np.r_[np.flatnonzero(np.diff(ends // TOGETHER)) + 1, len(ids)]  # nodes where a group of them ends
                for a, b in zip(np.r_[0, until[:-1]], until):
                    of = order[(ends[a - 1] if a else 0) : ends[b - 1]]
                    todo.append((level + 1, ids[a:b], x[at[of]], np.arange(len(of)), own[of], w[of], wy[of], node[of] - a))
                break
    at, *columns = (np.concatenate(a) for a in zip(*parts))
    order = np.argsort(at)
    return tuple(c[order] for c in columns), bag, leaf


def _right(flat: np.ndarray, start: np.ndarray, plain: int, codes: int, feature: np.ndarray, cut: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whether the rows that begin at `start` go to the right child of their nodes."""
    if not codes:
        return flat[start + feature[node]] > cut[node]
    value = flat[start + np.minimum(feature, plain)[node]]
    at = np.flatnonzero((feature >= plain)[node])  # rows of nodes that split by a code
    right, of = value > cut[node], node[at]
    right[at] = (value[at] == (feature - plain)[of]) & (cut[of] < 255)
    return right


def leaves(tree: tuple[np.ndarray, ...], x: np.ndarray, depth: int, codes: int = 0) -> np.ndarray:
    feature, cut, child, _ = tree
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), TOGETHER):
        flat, node = x[a : a + TOGETHER].ravel(), out[a : a + TOGETHER]
        start = np.arange(len(node)) * x.shape[1]
        for _ in range(depth):
            node[:] = child[node] + _right(flat, start, x.shape[1] - (codes > 0), codes, feature, cut, node)
    return out


def fit_predict(x: np.ndarray, y: np.ndarray, at: np.ndarray, seed: list[int], trees: int = 30, depth: int = 12, least: int = 5, codes: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean of the trees for the fitted rows x, for the rows at, variance of the trees for at). codes: as of `grow`."""
    rng, tries = np.random.default_rng(seed), int(np.ceil(np.sqrt(x.shape[1] - (codes > 0) + codes)))
    middle = y.mean()
    fitted, given = np.zeros(len(x)), np.empty((trees, len(at)))
    for i in range(trees):
        tree, bag, leaf = grow(x, y - middle, rng, depth, least, tries, codes)
        fitted[bag] += tree[3][leaf]
        out = np.ones(len(x), bool)
        out[bag] = False
        fitted[out] += tree[3][leaves(tree, x[out], depth, codes)]
        given[i] = tree[3][leaves(tree, at, depth, codes)]
    return fitted / trees + middle, given.mean(axis=0) + middle, given.var(axis=0, ddof=1) if trees > 1 else np.full(len(at), np.nan)
