"""Trie of conversation prefixes, shard by shard, as balanced parentheses.

A conversation is a sequence of turns; a node is a distinct sequence of first turns. Each
turn is reduced to an md5 of role and text and the length of its text before anything is
shuffled, so texts never travel. Sequences are range partitioned and sorted as
concatenated md5 values, with ``conv_id`` as last key, so even copies of one conversation are
spread over tasks. A task streams over its sorted sequences and cuts them into shards of
about ``SHARD_NODES`` nodes.

In a shard the common prefix with the sequence before says which nodes are new, which gives
the parentheses. findclose delimits the subtree of every node, rank turns the closing
position into an interval of preorder numbers and counts leaf pairs in it, and cumulative
arrays over the preorder give members, leaves and savings of the interval.

Only nodes on the first and the last path of a shard (its spines) may go on in another
shard. They leave the shard as two paths with what their finished subtrees add up to, and
are merged as sequences of a smaller trie, level by level, until one shard is left. Each
level reads two paths per shard of the level before, so levels shrink by thousands.

A node holds at least one row of a task, a path one row: 24 bytes a turn, so one
conversation with tens of millions of turns still fits. The digest of the ids that end at a
node is made in the shard, for nodes on spines from one row per shard, streamed in order.

Defined results: rows without ``conv_id`` belong to no conversation and are left out; a null
role or text is empty; turns come in ascending order, null first, turns of equal number by
the md5 of role and text; repeated rows are turns of their own; without conversations there
is no node, not even a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab.llm.chat import turn_code
from storelab.llm.parens import Parens
from storelab.operators.lookup import join_groups
from storelab.session import cut

SHARD_NODES = 1 << 19
# A shard holds at least so many paths, so that every level has far fewer than the one before.
LEAST_PATHS = 64
CODE = 16
GROUP, HEADS = 100, 6
NO_ID = np.iinfo(np.int64).max
NOTHING = hashlib.sha256(b"").hexdigest()

_ARRAYS = ["members", "least", "children", "leaves", "saved"]
_PATH = f"key binary, chars array<int>, conv_id long, {', '.join(f'{n} array<long>' for n in _ARRAYS)}"
_NODE = ("depth long, node_key binary, parent_key binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, ids string")
_SCHEMA = f"kind string, {_PATH}, {_NODE}"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, chars): every conversation after its first turns were replaced by those
    of the first conversation of its hundred."""
    chars = F.char_length(F.coalesce("text", F.lit(""))).cast("int")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(turn_code()).alias("code"), chars.alias("chars"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "code", "chars"))).alias("own"))
    base = (own.where(F.col("conv_id") % GROUP == 0)
            .select(F.col("conv_id").alias("base_id"), F.slice("own", 1, HEADS - 1).alias("head")))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = (own.withColumns({"n": n, "base_id": F.col("conv_id") - F.col("conv_id") % GROUP})
              .join(base, "base_id", "left"))
    none = F.slice("own", 1, 0)
    whole = F.concat(F.coalesce(F.slice(F.col("head"), F.lit(1), F.col("n")), none),
                     F.slice(F.col("own"), F.col("n") + 1, F.greatest(F.size("own"), F.lit(1))))
    return joined.select("conv_id", whole.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["code"])), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"))


class Shard:
    """The trie of sorted paths; arrays of ``paths`` hold what is already summed up below a node."""

    def __init__(self, codes: np.ndarray, chars: np.ndarray, bounds: np.ndarray, below: dict[str, np.ndarray]):
        """``codes`` and ``chars`` hold the turns of all paths, ``below`` one entry more per path."""
        self.lengths = lengths = np.diff(bounds)
        n = len(lengths)
        self.shared = shared = self._shared(codes, bounds, lengths)
        new = lengths - shared
        first = np.cumsum(new) - new
        self.n_nodes = size = int(new.sum())
        path = np.repeat(np.arange(n), new)
        self.depth = np.arange(size) - first[path] + shared[path] + 1
        # the turn that leads to a node; the root has none
        turn = bounds[path] + self.depth - 1
        self.chars = np.where(self.depth > 0, chars[np.maximum(turn, 0)] if len(chars) else 0, 0).astype(np.int64)
        self.upto = first + new - 1  # last node made when a path is done
        order = np.lexsort((np.arange(size), self.depth))
        self._by_depth, self._width = order, size + 1
        self._sorted = self.depth[order] * self._width + order
        self.parent = np.full(size, -1, np.int64)
        deeper = np.flatnonzero(self.depth > 0)
        self.parent[deeper] = self.at(self.depth[deeper] - 1, deeper)
        # sums below a node that its paths bring along
        owner = np.repeat(np.arange(n), lengths + 1)
        level = np.arange(len(owner)) - np.repeat(bounds[:-1] + np.arange(n), lengths + 1)
        node = self.at(level, self.upto[owner])
        self.below = {k: np.zeros(size, np.int64) for k in below if k != "least"}
        for k, sums in self.below.items():
            np.add.at(sums, node, below[k])
        self.below["least"] = np.full(size, NO_ID)
        np.minimum.at(self.below["least"], node, below["least"])
        self._measure()

    @staticmethod
    def _shared(codes, bounds, lengths) -> np.ndarray:
        """Length of the common prefix with the path before; -1 for the first, which brings the root."""
        shared = np.zeros(len(lengths), np.int64)
        shared[0] = -1
        least = np.minimum(lengths[1:], lengths[:-1])
        going, d = np.flatnonzero(least > 0) + 1, 0
        while len(going):
            same = codes[bounds[going] + d] == codes[bounds[going - 1] + d]
            going = going[same]
            d += 1
            shared[going] = d
            going = going[least[going - 1] > d]
        return shared

    def at(self, depth: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """The last node of each depth up to each node, in preorder."""
        return self._by_depth[np.searchsorted(self._sorted, depth * self._width + upto, "right") - 1]

    def _measure(self) -> None:
        nodes = np.arange(self.n_nodes)
        opens = 2 * nodes - self.depth  # a node opens after all nodes before it, less those still open
        bits = np.zeros(2 * self.n_nodes, np.uint8)
        bits[opens] = 1
        tree = Parens(bits)
        closes = tree.find_close(opens)
        self.end = end = tree.rank(closes)  # the subtree of a node is the interval from it to here

        def below(values):
            sums = np.r_[0, np.cumsum(values)]
            return sums[end] - sums[nodes]

        # a leaf pair opens and closes at once; finished children make it no leaf
        pair = np.zeros(2 * self.n_nodes, np.uint8)
        pair[opens[(closes == opens + 1) & (self.below["children"] == 0)]] = 1
        pairs = Parens(pair)
        self.leaves = pairs.rank(closes) - pairs.rank(opens) + below(self.below["leaves"])
        self.members = below(self.below["members"])
        self.saved = below(self.below["saved"] + (self.members - 1) * self.chars)
        self.children = self.below["children"] + np.bincount(self.parent[self.parent >= 0], minlength=self.n_nodes)
        self.least = self.below["least"].copy()
        order, depths = self._by_depth, self.depth[self._by_depth]
        starts = np.r_[np.flatnonzero(np.diff(depths, prepend=-1)), len(depths)]
        for a, b in list(zip(starts[:-1], starts[1:]))[:0:-1]:  # the deepest level first, without the root
            level = order[a:b]
            np.minimum.at(self.least, self.parent[level], self.least[level])

    def path(self, i: int) -> np.ndarray:
        """The nodes of path ``i`` from the root."""
        depth = np.arange(self.lengths[i] + 1)
        return self.at(depth, np.full(len(depth), self.upto[i]))

    def open_sums(self, spine: np.ndarray) -> dict[str, np.ndarray]:
        """For nodes on spines: what their finished subtrees add up to."""
        inner = np.flatnonzero(~spine & (self.parent >= 0))
        inner = inner[spine[self.parent[inner]]]
        up, out = self.parent[inner], {k: v.copy() for k, v in self.below.items()}
        for name, of in (("members", self.members), ("leaves", self.leaves), ("saved", self.saved)):
            np.add.at(out[name], up, of[inner])
        np.add.at(out["children"], up, 1)
        np.minimum.at(out["least"], up, self.least[inner])
        return out


def _keys_of(codes: list[bytes]) -> list[bytes]:
    """The name of each node of a path, from the root."""
    out = [hashlib.md5(b"").digest()]
    for code in codes:
        out.append(hashlib.md5(out[-1] + code).digest())
    return out


def _shard_rows(items: list[tuple], first_level: bool, final: bool):
    """Rows of one shard: finished nodes, spines and, on the first level, ends at spines.

    An item is (key, chars, conv_id or None, the five arrays or None).
    """
    lengths = np.array([len(i[0]) // CODE for i in items], np.int64)
    bounds = np.r_[0, np.cumsum(lengths)]
    raw = b"".join(i[0] for i in items)
    codes = np.frombuffer(raw, "V16") if raw else np.zeros(0, "V16")
    chars = np.concatenate([np.zeros(0, np.int64), *[np.asarray(i[1], np.int64) for i in items]])
    if first_level:
        last = bounds[1:] + np.arange(len(items))
        below = {k: np.zeros(bounds[-1] + len(items), np.int64) for k in _ARRAYS}
        below["least"][:] = NO_ID
        below["members"][last] = 1
        below["least"][last] = [i[2] for i in items]
    else:
        below = {k: np.concatenate([np.asarray(i[3][k], np.int64) for i in items]) for k in _ARRAYS}
    s = Shard(codes, chars, bounds, below)
    spine = np.zeros(s.n_nodes, bool)
    names: dict[int, bytes] = {}
    paths = [] if final else [0] if len(items) == 1 else [0, len(items) - 1]
    out = []
    if not final:
        for i in paths:
            spine[s.path(i)] = True
    named = range(len(items)) if not first_level else paths
    for i in named:
        names.update(zip(s.path(i).tolist(), _keys_of([items[i][0][k: k + CODE] for k in range(0, len(items[i][0]), CODE)])))
    # ends: equal paths are neighbours, ids ascend in them
    texts: dict[int, str] = {}
    if first_level:
        end_node = s.at(lengths, s.upto)
        runs = np.r_[np.flatnonzero(np.r_[True, end_node[1:] != end_node[:-1]]), len(items)]
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
            node, text = int(end_node[a]), ",".join(str(items[j][2]) for j in range(a, b))
            texts[node] = text
            if spine[node]:
                out.append({"kind": "end", "node_key": names[node], "conv_id": items[a][2], "ids": text})
    digests = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items() if not spine[n]}
    parent_known = np.zeros(s.n_nodes, bool)
    parent_known[s.parent >= 0] = ~spine[s.parent[s.parent >= 0]]
    for v in np.flatnonzero(~spine).tolist():
        p = int(s.parent[v])
        out.append({"kind": "node", "conv_id": int(s.least[v]), "depth": int(s.depth[v]), "node_key": names.get(v),
                    "parent_key": names[p] if p >= 0 and not parent_known[v] else None,
                    "parent_conv_id": int(s.least[p]) if parent_known[v] else None,
                    "n_convs": int(s.members[v]), "n_children": int(s.children[v]), "n_leaves": int(s.leaves[v]),
                    "saved_tokens": int(s.saved[v]), "ends_sha256": digests.get(v, NOTHING) if first_level else None})
    if not final:
        sums, told = s.open_sums(spine), np.zeros(s.n_nodes, bool)
        for i in paths:
            path = s.path(i)
            fresh = ~told[path]
            told[path] = True
            arrays = {k: np.where(fresh, sums[k][path], NO_ID if k == "least" else 0).tolist() for k in _ARRAYS}
            out.append({"kind": "path", "key": items[i][0], "chars": s.chars[path[1:]].tolist(), "conv_id": items[i][2], **arrays})
    return out


_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64())}


def _level(sorted_items: DataFrame, first_level: bool, final: bool, shard_nodes: int, least_paths: int) -> DataFrame:
    fields = [f.rsplit(" ", 1) for f in _SCHEMA.split(", ")]

    def run(batches):
        items, nodes = [], 0

        def flush():
            rows = _shard_rows(items, first_level, final)
            for i in range(0, len(rows), 50_000):
                part = rows[i: i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], _TYPES[t]) for n, t in fields],
                                                 [n for n, _ in fields])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "chars", "conv_id")]
            sums = [None] * batch.num_rows
            if not first_level:
                arrays = [batch.column(n).to_pylist() for n in _ARRAYS]
                sums = [dict(zip(_ARRAYS, r)) for r in zip(*arrays)]
            for item in zip(*columns, sums):
                items.append(item)
                nodes += len(item[0]) // CODE + 1
                if not final and nodes >= shard_nodes and len(items) >= least_paths:
                    yield from flush()
                    items, nodes = [], 0
        if items:
            yield from flush()

    return sorted_items.mapInArrow(run, _SCHEMA)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node_key, ends_sha256) of nodes on spines, from the ids of each shard in order."""
    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield made(done)
        if key is not None:
            yield made([(key, digest.hexdigest())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                          ["end_key", "digest"])

    return (ends.repartition("node_key").sortWithinPartitions("node_key", "conv_id")
            .select("node_key", "ids").mapInArrow(run, "end_key binary, digest string"))


def trie(paths: DataFrame, shard_nodes: int = SHARD_NODES, least_paths: int = LEAST_PATHS) -> DataFrame:
    """Per node of the trie over (conv_id, key, chars): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    least_paths = max(least_paths, 4)  # a shard leaves two paths, so fewer would not make levels smaller
    order = ["key", "conv_id"]
    ranged = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    made = cut(_level(ranged, True, False, shard_nodes, least_paths), ["kind"])
    nodes, ends = made.where("kind = 'node'"), made.where("kind = 'end'")
    spines, levels = made.where("kind = 'path'"), []
    while True:
        n, size = spines.agg(F.count("*"), F.coalesce(F.sum(F.length("key") / CODE + 1), F.lit(0))).first()
        final = n <= least_paths or size <= shard_nodes
        parts = spines.repartition(1) if final else spines.repartitionByRange(*order)
        made = cut(_level(parts.sortWithinPartitions(*order), False, final, shard_nodes, least_paths), ["kind"])
        levels.append(made.where("kind = 'node'"))
        if final:
            break
        spines = made.where("kind = 'path'")
    merged = levels[0]
    for more in levels[1:]:
        merged = merged.unionAll(more)
    merged = cut(merged.drop("ends_sha256").join(_end_digests(ends), F.col("node_key") == F.col("end_key"), "left")
                 .withColumn("ends_sha256", F.coalesce("digest", F.lit(NOTHING))))
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = nodes.select(*columns).unionAll(merged.select(*columns))
    # nodes under a spine learn its smallest member once the spine is merged
    parents = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("merged_id"))
    return (join_groups(every, parents, "parent_key", "left")
            .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "merged_id"))
            .select(*[c for c in columns if c != "parent_key"]))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(conversations))
