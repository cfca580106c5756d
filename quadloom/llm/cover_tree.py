"""A forest of cover trees over integer points, and the assignment of whole subtrees to centres.

Each tree is a simplified cover tree: every child of a node lies within the node's covering distance (half
of the power of two that holds the node's radius), children of one node lie further apart than that, and a
node is its own first child. Points are kept in tree order, so that a subtree is a range of points and its
sum is the difference of two cumulative sums. All trees of a forest are grown and walked together, level
by level, in arrays.

A node goes whole to a centre where the triangle inequality leaves no other: the farthest that one of its
points can be from that centre is less than the nearest that any of them can be to another. Otherwise its
children inherit the centres that are still possible, and the points of a last node are compared exactly,
in integers. The bounds are floats with a margin far above their rounding, which only makes more nodes
descend."""

from __future__ import annotations

import numpy as np

#: Points of a node that is not divided further.
LEAF = 8
#: Components up to which distances and sums hold in 64 bits, and squares of distances in a float.
SMALL = 1 << 24
#: Share and least size of the margin that bounds are given for rounding.
MARGIN = 1e-9


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exact."""
    d = a - b
    return (d * d).sum(axis=1)


class Forest:
    """``points[i]`` belongs to tree ``tree[i]``; equal points of a tree come once, with a count."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, tree: np.ndarray, trees: int):
        order = np.argsort(tree, kind="stable")
        sizes = np.bincount(tree, minlength=trees)
        first = np.cumsum(sizes) - sizes
        used = np.flatnonzero(sizes)
        start, end = first[used], (first + sizes)[used]
        reach = np.zeros(len(points))  # of each place in the order: the distance to its node's centre
        at = spread(start, end - start)
        reach[at] = np.sqrt(distances(points[order[at]], points[order[np.repeat(start, end - start)]]).astype(float))
        levels = []
        total = 0
        while len(start):
            # a range from each start to its end, and one on to the next start, which is left out
            radius = np.maximum.reduceat(np.append(reach, 0.0), np.stack([start, end], axis=1).ravel())[::2]
            split = (end - start > LEAF) & (radius > 0)
            own = {"start": start, "end": end, "radius": radius, "tree": tree[order[start]], "child": np.full(len(start), -1), "children": np.zeros(len(start), np.int64)}
            levels.append(own)
            total += len(start)
            kids_start, kids_end, parent = self._divide(points, order, reach, start[split], end[split], radius[split])
            n = np.bincount(parent, minlength=int(split.sum()))
            own["children"][split] = n
            own["child"][split] = total + np.cumsum(n) - n
            start, end = kids_start, kids_end
        put = {k: np.concatenate([x[k] for x in levels]) if levels else np.zeros(0, np.int64) for k in ("start", "end", "radius", "tree", "child", "children")}
        self.start, self.end, self.radius, self.tree = put["start"].astype(np.int64), put["end"].astype(np.int64), put["radius"].astype(float), put["tree"].astype(np.int64)
        self.child, self.children = put["child"].astype(np.int64), put["children"].astype(np.int64)
        self.order = order
        self.points, self.counts, self.of_tree = points[order], counts[order], tree[order]
        self.finish()

    def finish(self) -> None:
        """What follows from the rest: roots, and cumulative sums and counts."""
        self.roots = np.arange(len(np.unique(self.of_tree)))
        weighted = self.points * self.counts[:, None]
        self.sums = np.vstack([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(weighted, axis=0)])
        self.totals = np.concatenate([[0], np.cumsum(self.counts)])

    @staticmethod
    def _divide(points, order, reach, start, end, radius):
        """Children of the given nodes, as ranges; ``order`` and ``reach`` are rearranged in place."""
        if not len(start):
            return start, end, np.zeros(0, np.int64)
        cover = np.exp2(np.ceil(np.log2(radius)) - 1)
        sizes = end - start
        place = spread(start, sizes)
        node = np.repeat(np.arange(len(start)), sizes)
        left = np.arange(len(place))
        label = np.zeros(len(place), np.int64)
        near = np.zeros(len(place))
        who = order[place]
        turn = 0
        while len(left):
            g = node[left]
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            centre = np.repeat(left[heads], np.diff(np.append(heads, len(left))))
            d = np.sqrt(distances(points[who[left]], points[who[centre]]).astype(float))
            taken = d <= cover[g]
            label[left[taken]] = turn
            near[left[taken]] = d[taken]
            left = left[~taken]
            turn += 1
        kid = node * turn + label
        by = np.argsort(kid, kind="stable")
        order[place], reach[place] = who[by], near[by]
        kid = kid[by]
        heads = np.flatnonzero(np.concatenate([[True], kid[1:] != kid[:-1]]))
        tails = np.append(heads[1:], len(kid)) - 1
        return place[heads], place[tails] + 1, node[by][heads]

    def assign(self, centres: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest of ``centres[tree]`` for each point, ties to the lower index, and how many points
        were compared exactly."""
        out = np.zeros(len(self.points), np.int64)
        k = centres.shape[1]
        node = np.repeat(self.roots, k)
        cand = np.tile(np.arange(k), len(self.roots))
        exact = 0
        while len(node):
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            sizes = np.diff(np.append(heads, len(node)))
            own = node[heads]
            d = np.sqrt(distances(self.points[self.start[node]], centres[self.tree[node], cand]).astype(float))
            r = self.radius[node]
            far = d + r
            least = np.minimum.reduceat(far, heads)
            slack = MARGIN * (1 + least)
            possible = d - r <= np.repeat(least + slack, sizes)
            alive = np.add.reduceat(possible.astype(np.int64), heads)
            sure = alive == 1
            # the only centre left for the whole subtree
            first = np.flatnonzero(possible & np.repeat(sure, sizes))
            s, e = self.start[own[sure]], self.end[own[sure]]
            out[spread(s, e - s)] = np.repeat(cand[first], e - s)
            node, cand = node[possible], cand[possible]
            open_ = np.repeat(~sure, alive)
            node, cand = node[open_], cand[open_]
            last = self.children[node] == 0
            exact += self._compare(node[last], cand[last], centres, out)
            node, cand = self._descend(node[~last], cand[~last])
        return out, exact

    def _descend(self, node: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children with the centres that were possible for their parent."""
        if not len(node):
            return node, cand
        n = self.children[node]
        kid = spread(self.child[node], n)
        cand = np.repeat(cand, n)
        by = np.lexsort((cand, kid))
        return kid[by], cand[by]

    def _compare(self, node: np.ndarray, cand: np.ndarray, centres: np.ndarray, out: np.ndarray) -> int:
        if not len(node):
            return 0
        n = self.end[node] - self.start[node]
        point = spread(self.start[node], n)
        cand = np.repeat(cand, n)
        by = np.lexsort((cand, point))
        point, cand = point[by], cand[by]
        heads = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
        d = distances(self.points[point], centres[self.of_tree[point], cand])
        best = np.repeat(np.minimum.reduceat(d, heads), np.diff(np.append(heads, len(point))))
        hit = np.flatnonzero(d == best)
        firsts = hit[np.concatenate([[True], point[hit][1:] != point[hit][:-1]])]
        out[point[firsts]] = cand[firsts]
        return len(heads)

    def sums_by_centre(self, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``tree * k + centre``, sums and counts of the points assigned there, from cumulative sums over
        the runs of points that went to one centre together."""
        key = self.of_tree * k + found
        if not len(key):
            return key, self.sums[:0], key
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tails = np.append(heads[1:], len(key))
        keys, where = np.unique(key[heads], return_inverse=True)
        sums, counts = np.zeros((len(keys), self.points.shape[1]), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(sums, where, self.sums[tails] - self.sums[heads])
        np.add.at(counts, where, self.totals[tails] - self.totals[heads])
        return keys, sums, counts
