"""N-gram Jaccard join with a count-vector R-tree, exact for 100 * |A & B| >= 75 * |A | B|.

A document's set is its distinct 5-word shingles (64-bit ids). Equal sets are one class. Then
1. Prefixes: in any fixed order of shingles two sets that link share one among the first n - ceil(3n/4) + 1 of each.
   The order is: shingles found often come last, then by id. Often means in at least one in HOT_PART classes of some
   block of a task's rows; such local counts are summed over all data, so the list covers everything and its length is
   bounded by HOT_PART times the mean set size. The list only moves work; any order is exact.
2. (shingle, class) pairs of the prefixes meet by shingle, packed into binary blobs of buckets, FINE of them a partition,
   that a sort brings together one after the other; those alone at a shingle go.
3. Count vectors: hashing shingles into groups makes each class a point of group counts. For two sets the overlap is
   at most the sum of coordinate minima, and they link only if that reaches 3/7 of the sum of their sizes. A set of n
   has between n/4 and n/2 groups (64 at least), so that counts fit in 4 bits and the bound stays tight at every size;
   the number is a power of two, and points of different sizes compare after the longer one is folded.
4. First round: within each shingle's bucket, in size order, each class and the first of a fitting size become a
   candidate if they meet in many buckets; its bound is checked, then its sets; links merge classes into components.
5. Buckets that still hold several components of fitting sizes get an R-tree: points sorted by size and packed into
   leaves of LEAF with bounding boxes, boxes packed FAN at a time into the boxes above, up to one root; from the root
   down, boxes, then points, are paired if the bound of minima allows a link and their components differ; the trees of
   one leaf, most of them, are paired together. Second round: of all such pairs of a bucket the forest with the highest
   bounds is verified and merged, so a group of near copies costs a forest, not all its pairs. Third round: every such pair lies in a cluster that the
   forests' edges connect; clusters that still hold several components are searched once, in tiles, and every pair whose
   components still differ is verified with whole sets. Links inside a component can't change it, so none is lost.

Cases: a null or empty text, or one without words, has size 0 and is its own component; fewer than 5 words make one
shingle of the whole sequence; repeated rows are equal sets; a row with a null doc_id links with nothing (its
component is null); empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Words, dealt, drop, join_checked, join_hot, map_arrow, sequence_hash, set_hash, signed, table, text_chunks, text_only
from gridloom.llm.components import connected_components

K, LEAST_GROUPS, LEAF, FAN = 5, 64, 32, 8
HOT_PART = 1000
#: Stars of the first round meet in at least one of STAR_PART of the larger set's shingles: it only has to find most links.
STAR_PART = 12
BLOCK = 512
#: Buckets of packed pairs for each partition: a task holds one of them at a time.
FINE = 8
#: Possible links of a bucket that wait before they shrink to their forest.
WAITING = 500_000
#: Packed pairs: shingle, class.
PAIR = np.dtype([("key", "<u8"), ("id", "<u8")])


def shingle_sets(column: pa.Array):
    """(row, sorted distinct shingle ids) of every text."""
    for at, end, data, offsets in text_chunks(column):
        words = Words(data, offsets, lower=True)
        grams, inside = words.grams(K)
        for i in range(end - at):
            lo, hi = words.first[i], words.first[i + 1]
            if hi - lo >= K:
                yield at + i, np.unique(grams[lo : hi - K + 1])
            elif hi > lo:
                yield at + i, np.array([sequence_hash(words.hash[lo:hi])], dtype=np.uint64)
            else:
                yield at + i, np.zeros(0, dtype=np.uint64)


def _survey(batches):
    """Kind 0: (doc_id, size, two set hashes). Kind 1: shingles frequent in this block, with their counts."""
    names = ["kind", "a", "b", "h1", "h2"]
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        rows, seen, all_sets = [], set(), []
        for i, s in shingle_sets(b.column("text")):
            h1, h2 = signed(np.array([set_hash(s), set_hash(s, 1)], dtype=np.uint64)).tolist() if len(s) else (0, 0)
            rows.append((0, ids[i], len(s), h1, h2))
            if len(s) and h1 not in seen:
                seen.add(h1)
                all_sets.append(s)
        if all_sets:
            keys, n = np.unique(np.concatenate(all_sets), return_counts=True)
            often = n >= max(3, len(all_sets) / HOT_PART)
            rows += [(1, k, c, 0, 0) for k, c in zip(signed(keys[often]).tolist(), n[often].tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def point(s: np.ndarray, fine: bool = False) -> bytes:
    """The count vector of a set, two counts a byte: between n/4 and n/2 groups, or 8 to 16 times n if fine."""
    groups = LEAST_GROUPS
    while groups * 4 < len(s) or fine and groups < 8 * len(s):
        groups *= 2
    while (counts := np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups)).max() > 15:
        groups *= 2
    counts = counts.astype(np.uint8)
    return (counts[: groups // 2] | counts[groups // 2 :] << 4).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    packed = np.frombuffer(blob, dtype=np.uint8)
    return np.concatenate([packed & 15, packed >> 4]).astype(np.int16)


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    """Points (last axis) over fewer groups: counts of groups that become one add up."""
    while points.shape[-1] > groups:
        half = points.shape[-1] // 2
        points = points[..., :half] + points[..., half:]
    return points


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _prefixes(hot, buckets: int):
    """Kind 0: class, size, count vector. Kind 1: bucket, packed (shingle, class) pairs. Each set once a batch."""

    def run(batches):
        often = hot.value
        for b in batches:
            classes, keys, owners, seen = [], [], [], set()
            for _, s in shingle_sets(b.column("text")):
                if not len(s) or (h := set_hash(s)) in seen:
                    continue
                seen.add(h)
                late = np.zeros(len(s), dtype=bool)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    late = often[at] == s
                keys.append(np.concatenate([s[~late], s[late]])[: prefix_size(len(s))])
                owners.append(np.full(len(keys[-1]), h, dtype=np.uint64))
                classes.append((h, len(s), point(s)))
            ids = signed(np.array([c[0] for c in classes], dtype=np.uint64))
            n = len(classes)
            yield _batch([0] * n, np.arange(n) % buckets, ids, [c[1] for c in classes], [c[2] for c in classes])
            if not n:
                continue
            pairs = np.empty(sum(map(len, keys)), dtype=PAIR)
            pairs["key"], pairs["id"] = np.concatenate(keys), np.concatenate(owners)
            bucket = (pairs["key"] % np.uint64(buckets)).astype(np.int64)
            pairs = pairs[np.argsort(bucket, kind="stable")]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            used = [k for k in range(buckets) if ends[k] > (ends[k - 1] if k else 0)]
            blobs = [pairs[(ends[k - 1] if k else 0) : ends[k]].tobytes() for k in used]
            yield _batch([1] * len(used), used, [None] * len(used), [None] * len(used), blobs)

    return run


def _batch(kind, bucket, ids, n, blob):
    cols = ((kind, pa.int32()), (bucket, pa.int32()), (ids, pa.int64()), (n, pa.int64()), (blob, pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], names=["kind", "bucket", "id", "n", "blob"])


_ROW = "kind int, bucket int, id long, n long, blob binary"


def _shared(batches):
    """Packed pairs sorted by bucket -> kind 1, the (shingle, class) pairs whose shingle has several classes. Kind 0 passes."""
    held, parts = None, []
    for b in batches:
        kind = b.column("kind").to_numpy()
        own = b.filter(pa.array(kind == 0))
        yield pa.RecordBatch.from_arrays([own.column("kind"), pa.array([None] * len(own), pa.int64()), *(own.column(c) for c in ("id", "n", "blob"))], names=["kind", "key", "id", "n", "blob"])
        blobs = b.filter(pa.array(kind == 1))
        for k, blob in zip(blobs.column("bucket").to_pylist(), blobs.column("blob").to_pylist(), strict=True):
            if k != held:
                yield from _several(parts)
                held, parts = k, []
            parts.append(blob)
    yield from _several(parts)


def _met(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, sorted by key, whose key has several."""
    same = key[1:] == key[:-1]
    keep = np.append(False, same)[: len(key)] | np.append(same, False)[: len(key)]
    return key[keep], ids[keep]


def _several(parts: list[bytes]):
    """A bucket's pairs whose shingle has several classes, each once."""
    pairs = np.frombuffer(b"".join(parts), dtype=PAIR)
    key, ids = pairs["key"].copy(), pairs["id"].copy()
    order = np.argsort(key, kind="stable")
    key, ids = _met(key[order], ids[order])
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))[: len(key)]
    key, ids = map(signed, _met(key[new], ids[new]))
    for at in range(0, len(key), 100_000):
        m = len(key[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(key[at : at + m]), pa.array(ids[at : at + m]), pa.array([None] * m, pa.int64()), pa.array([None] * m, pa.binary())], names=["kind", "key", "id", "n", "blob"])


def _slices(batches, key: str):
    """Rows of whole keys from a partition sorted by key, without holding more than one key at a time."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        keys = t.column(key).to_numpy()
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(cut):
            yield t.slice(0, int(cut[-1])).combine_chunks()
            rest = t.slice(int(cut[-1]))
        else:
            rest = t
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _stars(batches):
    """In each shingle's bucket, in size order, every class with the first one whose size still allows a link."""
    for t in _slices(batches, "key"):
        key, ids, n = (t.column(c).to_numpy() for c in ("key", "id", "n"))
        order = np.lexsort((ids, n, key))
        key, ids, n = key[order], ids[order], n[order]
        center = np.arange(len(key))
        open_rows = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # the centres of this pass: one a bucket
        ends = np.append(open_rows[1:], len(key))
        while len(open_rows):
            # all that fit a centre attach to it; the next that doesn't is the bucket's next centre
            limit = 100 * n[open_rows]
            reach = np.array([lo + np.searchsorted(75 * n[lo:hi], lim, "right") for lo, hi, lim in zip(open_rows, ends, limit, strict=True)])
            for lo, hi in zip(open_rows, reach, strict=True):
                center[lo:hi] = lo
            more = reach < ends
            open_rows, ends = reach[more], ends[more]
        ok = center != np.arange(len(key))
        pairs = np.column_stack([np.sort(np.column_stack([ids[center[ok]], ids[ok]]), axis=1), n[ok]])
        pairs, times = np.unique(pairs, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2].copy()), pa.array(times)], names=["a", "b", "n", "times"])


def _fitting(batches):
    """The rows with another component of a fitting size in their bucket."""
    for t in _slices(batches, "key"):
        key, n, comp = (t.column(c).to_numpy() for c in ("key", "n", "comp"))
        order = np.lexsort((n, key))
        keep = np.zeros(len(t), dtype=bool)
        key, n, comp = key[order], n[order], comp[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for lo, hi in zip(start, np.append(start[1:], len(key)), strict=True):
            size, of = n[lo:hi], comp[lo:hi]
            first = np.searchsorted(100 * size, 75 * size, "left")
            last = np.searchsorted(75 * size, 100 * size, "right")
            change = np.append(0, np.cumsum(np.append(False, of[1:] != of[:-1])))  # changes before each row
            keep[lo:hi] = change[last] > change[first + 1]
        yield from t.take(pa.array(order[keep])).select(["key", "id", "n", "comp"]).to_batches()


def _reduced(ufunc, values: np.ndarray, step: int) -> np.ndarray:
    return ufunc.reduceat(values, np.arange(0, len(values), step), axis=0)


class Tree:
    """A packed R-tree over points of one number of groups, in size order. Level 0 holds the leaves' boxes: greatest
    coordinates, least and greatest size, and the component of a box that has only one (else -1)."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, sizes: np.ndarray, place: np.ndarray):
        self.rows, self.points = rows, points
        level, step = (points, sizes, sizes, place, place), LEAF
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        while not self.levels or len(level[0]) > 1:
            level = tuple(_reduced(u, v, step) for u, v in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append((*level[:3], np.where(level[3] == level[4], level[3], -1)))
            step = FAN

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _joinable(a: Tree, b: Tree, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of boxes of level k may hold a link between components."""
    (top, least, most, alone), (far, least2, most2, alone2) = a.level(k), b.level(k)
    ok = (100 * most[i] >= 75 * least2[j]) & (100 * most2[j] >= 75 * least[i]) & ~((alone[i] == alone2[j]) & (alone[i] >= 0))
    g = min(top.shape[1], far.shape[1])
    top, far, at = fold(top, g), fold(far, g), np.flatnonzero(ok)
    for lo in range(0, len(at), max(1, (2 << 20) // g)):
        part = at[lo : lo + max(1, (2 << 20) // g)]
        overlap = np.minimum(top[i[part]], far[j[part]]).sum(axis=1, dtype=np.int64)
        ok[part] = 7 * overlap >= 3 * (least[i[part]] + least2[j[part]])
    return ok


def _below(tree: Tree, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in i, box) of the boxes of level k - 1 under the boxes i of level k."""
    if k >= len(tree.levels):  # a lower tree waits at its root
        return np.arange(len(i)), i
    first = i * FAN
    n = np.minimum(first + FAN, len(tree.levels[k - 1][0])) - first
    of = np.repeat(np.arange(len(i)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _leaf_pairs(a: Tree, b: Tree):
    """Pairs of leaves that may hold a link, from the roots down."""
    top = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, dtype=np.int64)
    for k in range(top, -1, -1):
        ok = _joinable(a, b, k, i, j)
        i, j = i[ok], j[ok]
        if k:
            of, left = _below(a, k, i)
            of2, right = _below(b, k, j[of])
            i, j = left[of2], right
            if a is b:
                i, j = i[i <= j], j[i <= j]
    return zip(i.tolist(), j.tolist(), strict=True)


def tree_pairs(points: list[np.ndarray], sizes: np.ndarray, comp: np.ndarray):
    """Index pairs of different components whose sum of coordinate minima allows a link, by packed R-trees, one for each
    number of groups. The sum of minima of two boxes' upper corners bounds all pairs below."""
    groups = np.array([len(p) for p in points])
    order = np.lexsort((sizes, groups))
    place = np.unique(comp, return_inverse=True)[1]
    trees = []
    for g in np.unique(groups):
        own = order[groups[order] == g]
        trees.append(Tree(own, np.array([points[x] for x in own]), sizes[own], place[own]))
    for at, a in enumerate(trees):
        for b in trees[at:]:
            g = min(a.points.shape[1], b.points.shape[1])
            left_points, right_points = fold(a.points, g), fold(b.points, g)
            for i, j in _leaf_pairs(a, b):
                own, far = a.rows[i * LEAF : (i + 1) * LEAF], b.rows[j * LEAF : (j + 1) * LEAF]
                left, right = left_points[i * LEAF : (i + 1) * LEAF], right_points[j * LEAF : (j + 1) * LEAF]
                step = max(1, (2 << 20) // right.size)  # a few MB at a time, however long the points
                overlap = np.concatenate([np.minimum(left[k : k + step, None], right).sum(axis=2, dtype=np.int64) for k in range(0, len(left), step)])
                total = sizes[own][:, None] + sizes[far]
                x, y = np.nonzero((place[own][:, None] != place[far]) & (7 * overlap >= 3 * total))
                if a is b and i == j:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield own[x], far[y], overlap[x, y] / total[x, y]


def best_forest(n: int, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of a forest of the highest-scored edges that joins what all the edges join (Boruvka's rounds)."""
    order = np.lexsort((b, a, -score))
    a, b = a[order], b[order]
    root, taken = np.arange(n), np.zeros(len(a), dtype=bool)
    live = np.arange(len(a))
    while True:
        ra, rb = root[a[live]], root[b[live]]
        live, ra, rb = live[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(live):
            return order[taken]
        best = np.full(n, len(a))
        np.minimum.at(best, ra, live)
        np.minimum.at(best, rb, live)
        picked = np.unique(best[best < len(a)])
        taken[picked] = True
        root = forest_roots(n, root, a[picked], b[picked])


def forest_roots(n: int, root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        root = new
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def _bucket(t: pa.Table, lo: int, hi: int):
    """(ids, sizes, components, points) of the rows of one shingle in a sorted slice."""
    ids, n, comp = (t.column(c)[lo:hi].to_numpy() for c in ("id", "n", "comp"))
    return ids, n, comp, [unpacked(x) for x in t.column("blob")[lo:hi].to_pylist()]


def _grouped(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Each point's number of groups and its row among the points of that number, and those points by number."""
    groups = np.array([2 * len(x) for x in blobs], dtype=np.int64)
    row, points = np.zeros(len(blobs), dtype=np.int64), {}
    for g in np.unique(groups).tolist():
        own = np.flatnonzero(groups == g)
        row[own] = np.arange(len(own))
        packed = np.frombuffer(b"".join(blobs[x] for x in own), dtype=np.uint8).reshape(len(own), -1)
        points[g] = np.concatenate([packed & 15, packed >> 4], axis=1)
    return groups, row, points


def leaf_links(bucket: np.ndarray, n: np.ndarray, comp: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score): row pairs of different components of one bucket whose points allow a link, for buckets of at most
    LEAF points, sorted by bucket. Such a tree is a single leaf, so all of a slice are paired point by point at once."""
    groups, row, points = _grouped(blobs)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for step in range(1, LEAF):
        i = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(i):
            break
        j = i + step
        ok = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
        found.append(np.column_stack([i[ok], j[ok]]))
    a, b = np.concatenate(found).T
    a, b = np.where(groups[a] <= groups[b], a, b), np.where(groups[a] <= groups[b], b, a)
    overlap = np.zeros(len(a), dtype=np.int64)
    for g, far in np.unique(np.column_stack([groups[a], groups[b]]), axis=0).tolist():
        at = np.flatnonzero((groups[a] == g) & (groups[b] == far))
        step = max(1, (2 << 20) // far)
        for part in (at[lo : lo + step] for lo in range(0, len(at), step)):
            right = fold(points[far][row[b[part]]].astype(np.int16), g)
            overlap[part] = np.minimum(points[g][row[a[part]]], right).sum(axis=1, dtype=np.int64)
    total = n[a] + n[b]
    ok = 7 * overlap >= 3 * total
    return a[ok], b[ok], overlap[ok] / total[ok]


def _tree_links(n: np.ndarray, comp: np.ndarray, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best-bounded forest of the possible links of one bucket."""
    kept, waiting = [np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)], []
    for found in tree_pairs(points, n, comp):
        waiting.append(found)
        if sum(len(w[0]) for w in waiting) > WAITING:
            kept, waiting = _best(len(n), kept, waiting), []
    a, b, _ = _best(len(n), kept, waiting)
    return a, b


def _chains(batches):
    """The best-bounded forest of each bucket's possible links."""
    for t in _slices(batches, "key"):
        key = t.column("key").to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        out = []
        for lo, m in zip(start[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            ids, n, comp, points = _bucket(t, lo, lo + m)
            a, b = _tree_links(n, comp, points)
            out.append(np.column_stack([ids[a], ids[b]]))
        small = t.filter(pa.array(np.repeat(size <= LEAF, size)))
        key, ids, n, comp = (small.column(c).to_numpy() for c in ("key", "id", "n", "comp"))
        a, b, score = leaf_links(key, n, comp, small.column("blob").to_pylist())
        taken = best_forest(len(ids), a, b, score)  # buckets share no row, so it is a forest of each
        out.append(np.column_stack([ids[a[taken]], ids[b[taken]]]))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _best(n: int, kept: list, waiting: list) -> list:
    a, b, score = (np.concatenate([kept[k], *(w[k] for w in waiting)]) for k in range(3))
    chosen = best_forest(n, a, b, score)
    return [a[chosen], b[chosen], score[chosen]]


def _tile(t: pa.Table) -> pa.Table:
    """The possible links between components in a tile of one or two blocks of a cluster."""
    t = t.combine_chunks()
    ids, n, comp, block = (t.column(c).to_numpy() for c in ("id", "n", "comp", "block"))
    across, out = t.column("ta")[0] != t.column("tb")[0], [np.zeros((0, 2), dtype=np.int64)]
    for x, y, _ in tree_pairs([unpacked(v) for v in t.column("blob").to_pylist()], n, comp):
        if across:
            apart = block[x] != block[y]
            x, y = x[apart], y[apart]
        out.append(np.sort(np.column_stack([ids[x], ids[y]]), axis=1))
    pairs = np.concatenate(out)
    return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})


def _left_pairs(docs: DataFrame, chains: DataFrame, comp: DataFrame, classes: DataFrame, firsts: DataFrame, block: int) -> DataFrame:
    """(a, b): every possible link between components. All lie inside the clusters that the forests' edges, linking or
    not, connect; a cluster is searched once, in tiles of two blocks of at most about `block` classes, with points of so
    many groups that few pairs pass that don't link."""
    clusters = connected_components(chains, "a", "b")
    at = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    at = table(at.select("id", "cluster", F.coalesce("component", "id").alias("comp")))
    sizes = at.groupBy("cluster").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cluster", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    rows = table(at.join(sizes, "cluster").join(classes.select("id", "n"), "id"))
    fine = _from_texts(docs, rows.select("id"), rows.count(), firsts, lambda s: point(s, fine=True))
    rows = rows.join(fine, "id").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) AS int)"))
    tiles = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("ta", F.least("block", "other")).withColumn("tb", F.greatest("block", "other"))
    return tiles.select("cluster", "ta", "tb", "id", "n", "comp", "block", "blob").groupBy("cluster", "ta", "tb").applyInArrow(_tile, "a long, b long")


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose count vectors allow a link."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("blob").alias(f"v{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for b in batches:
            ok = []
            for x, y, size in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), b.column("na").to_numpy() + b.column("nb").to_numpy(), strict=True):
                x, y = unpacked(x), unpacked(y)
                g = min(len(x), len(y))
                ok.append(7 * int(np.minimum(fold(x, g), fold(y, g)).sum()) >= 3 * int(size))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(both.select("a", "b", "na", "nb", "va", "vb"), run, "a long, b long")


def _from_texts(docs: DataFrame, wanted: DataFrame, at_most: int, firsts: DataFrame, make) -> DataFrame:
    """(id, blob): make(set) of the wanted classes, at_most of them, from the texts of their first documents."""
    first = firsts.join(wanted.withColumnRenamed("id", "h1"), "h1", "left_semi")
    texts = join_checked(text_only(docs), table(first.select("doc_id").distinct(), rows=at_most), "doc_id", "left_semi")

    def run(batches):
        for b in batches:
            ids, blobs = [], []
            for _, s in shingle_sets(b.column("text")):
                ids.append(set_hash(s))
                blobs.append(make(s))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(ids, dtype=np.uint64))), pa.array(blobs, pa.binary())], names=["id", "blob"])

    return table(map_arrow(texts, run, "id long, blob binary").dropDuplicates(["id"]))


def _verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs that link, by the whole sets of their classes."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _from_texts(docs, ends, 2 * pairs.count(), firsts, lambda s: s.tobytes())
    side = lambda s: sets.select(F.col("id").alias(s), F.col("blob").alias(f"s{s}"))

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * both >= 75 * (len(merged) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return table(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb"), run, "a long, b long"))


def _spots(sized: DataFrame, comp: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """(key, id, n, comp, blob), sorted by shingle: the rows whose bucket holds another component of a fitting size."""
    labelled = table(sized.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    mixed = table(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m"))
    labelled = join_hot(labelled, mixed, "key", "m").select("key", "id", "n", "comp")  # most buckets are one component by now
    fitting = table(map_arrow(labelled.repartition(parts, "key").sortWithinPartitions("key"), _fitting, "key long, id long, n long, comp long"))
    placed = fitting.join(classes.select("id", "blob"), "id").select("key", "id", "n", "comp", "blob")
    return placed.repartition(parts, "key").sortWithinPartitions("key")


def jaccard_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs; block: classes of a block of the third round's tiles."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = text_only(docs)
    survey = table(map_arrow(texts, _survey, "kind long, a long, b long, h1 long, h2 long").withColumn("kind", F.col("kind").cast("int")), "kind")
    members = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "h1", "h2")
    firsts = table(members.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    total = members.where("n > 0").count()
    often = survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).where(F.col("c") >= max(8, total / HOT_PART)).select("a")
    hot = np.sort(often.toArrow().column("a").to_numpy().astype(np.int64).view(np.uint64))  # bounded, see above
    spread = map_arrow(texts.where("doc_id IS NOT NULL"), _prefixes(spark.sparkContext.broadcast(hot), FINE * parts), _ROW)
    spread = table(map_arrow(dealt(spread, "bucket").sortWithinPartitions("bucket"), _shared, "kind int, key long, id long, n long, blob binary"), "kind")
    classes = table(spread.where("kind = 0").groupBy("id").agg(F.min("n").alias("n"), F.min("blob").alias("blob")))
    shared = spread.where("kind = 1").select("key", "id")
    sized = table(shared.join(classes.select("id", "n"), "id"))
    near = map_arrow(sized.repartition(parts, "key").sortWithinPartitions("key"), _stars, "a long, b long, n long, times long")
    near = near.groupBy("a", "b").agg(F.max("n").alias("n"), F.sum("times").alias("times")).where(F.col("times") * STAR_PART >= F.col("n"))
    first_round = table(_bounded(near.select("a", "b"), classes))
    links = _verified(docs, first_round, firsts)
    comp = connected_components(links, "a", "b")
    spots = _spots(sized, comp, classes, parts)
    chains = table(map_arrow(spots, _chains, "a long, b long").distinct())
    links = table(links.unionByName(_verified(docs, chains, firsts)))
    comp = connected_components(links, "a", "b")
    across = table(_left_pairs(docs, chains, comp, classes, firsts, block))
    more = _verified(docs, across, firsts)
    comp = connected_components(links.unionByName(more), "a", "b")
    # classes -> documents
    named = table(firsts.withColumnRenamed("doc_id", "least").join(comp.select(F.col("node").alias("h1"), "component"), "h1", "left").withColumn("component", F.coalesce("component", "h1")))
    least = table(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    own = table(join_hot(named, least, "component", "m").select("h1", "copies", "component_id"))
    linked = join_hot(members.where("n > 0 AND doc_id IS NOT NULL"), own, "h1", "copies")
    alone = members.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    drop(spread, classes, sized)
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, less all but the least doc_id of each component; of rows that share a
    doc_id one stays. Only the ids that go are joined to the texts."""
    found = table(jaccard_components(docs))
    gone = table(found.where("component_id <> doc_id").select("doc_id").distinct())
    kept = join_checked(docs, gone, "doc_id", "left_anti")
    if found.where("doc_id IS NOT NULL AND component_id = doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
