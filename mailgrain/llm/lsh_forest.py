"""MinHash near-duplicates by an LSH forest.

Every text becomes its set of word shingles (64-bit hashes) and a signature of 64 minima. Equal sets collapse to one node
first, so any number of exact copies costs one row. Tree t orders nodes by the signature rotated by 4 t places; that is
16 sorted orders whose first four places never overlap. Candidates of a node are its neighbours in an order as long as
they share at least `depth` leading places, up to `window` of them: in thin regions that reaches down to the least
depth, in dense ones only the longest common prefixes are taken. Candidates whose sizes or signatures can't reach the
similarity are dropped, the others are confirmed on the full sets.

* First round: the next neighbour in four orders. It joins the bulk of every family of near copies by few confirmations.
* Second round: all orders, whole windows, only pairs across the components found so far.
* Dense rest: regions longer than a window that still hold several components are not cut off. Their members are joined
  exactly by their rarest shingles: sets with similarity s share one of the n - ceil(s n) + 1 rarest ones; again only
  across components, with the largest component of a shingle on one side.

A pair at similarity 0.8 shares three leading places of one order with probability 0.51, so all 16 orders miss it once in
100,000 cases, and closer pairs far more rarely; the signature bound (36 of 64 places) drops it about as rarely.

Rows without words, or with null text, have empty sets and no links. Rows with one doc_id and different texts are nodes of
their own; a component is named by its smallest non-null doc_id (null if it has none); `kept` compares ids null-safely, so
rows without id are kept only in components without ids. Sets are told apart by a 64-bit hash. Columns beyond id and
text are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spread_join, written
from .components import components

SIGNATURE, TREES, STEP, DEPTH = 64, 16, 4, 3
LEAST = 36  # equal places of two signatures at similarity 0.8: 51 expected, 3.2 the deviation
FIRST_TREES = (0, 4, 8, 12)
MOST_KEYS = 1_000_000  # nodes that may be broadcast; more are joined by shuffle


def _mixed(x):
    """A 64-bit finaliser (two multiply-shift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mixed(np.arange(1, 100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_HASHES, _PLACES = _FACTORS[:SIGNATURE], _FACTORS[SIGNATURE:]


class _Words(dict):
    """Hash of each word met, kept up to a bound per worker."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxh64_intdigest(word)
        return got


def shingle_set(text, width: int = 4, words: dict | None = None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of one text (bytes). `lower` and `split` of bytes take A-Z and [\\x20\\x09-\\x0D] only."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    known = _Words() if words is None else words
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += h[i:len(h) - n + 1 + i] * _PLACES[i]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 minima, each cut to 16 bits."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i:i + 4096, None] * _HASHES).min(axis=0))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def _node(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(shingles.tobytes())


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id_col, key, n, node, signature), one row per row of `docs`: text hash, size of the set, hash of the set."""

    def run(batches):
        words = _Words()
        for b in batches:
            sizes, nodes, signs = [], [], []
            for text in b.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, width, words)
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield arrow_rows([id_col, "key", "n", "node", "signature"], [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()],
                             [b.column(0), b.column(1), sizes, _as_long(nodes), signs])

    text = F.col(text_col).cast("string")
    kept = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text).alias("key"), text.alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` {dict(kept.dtypes)[id_col]}, key long, n long, node long, signature binary")


def _as_long(nodes):
    return [None if x is None else x - (1 << 64) if x >> 63 else x for x in nodes]


def orders(nodes: DataFrame, trees) -> DataFrame:
    """(tree, k1, k2, node, n, component, low): each node once per tree; k1 and k2 hold eight places, `low` the signature's low bytes."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sign = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, SIGNATURE)
            low = pa.array([r.tobytes() for r in sign.astype(np.uint8)], pa.binary())
            for t in trees:
                turned = np.roll(sign, -STEP * t, axis=1)[:, :8].astype(np.uint64)
                k1, k2 = (sum(turned[:, i + j] << np.uint64(48 - 16 * j) for j in range(4)) for i in (0, 4))
                yield arrow_rows(["tree", "k1", "k2", "node", "n", "component", "low"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()],
                                 [np.full(b.num_rows, t, np.int32), k1.view(np.int64), k2.view(np.int64), b.column(0), b.column(1), b.column(2), low])

    return nodes.select("node", "n", "component", "signature").mapInArrow(
        run, "tree int, k1 long, k2 long, node long, n long, component long, low binary")


_ROW = ["tree", "k1", "k2", "node", "n", "component", "low"]
_FOUND = "a long, b long, dense boolean, " + "tree int, k1 long, k2 long, node long, n long, component long, low binary"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _window_pairs(window: int, percent: int, borders: bool):
    """Streams a sorted partition: pairs (a, b); one `dense` row (tree, k1) where a region is longer than the window; the first and last rows."""

    def pack(pairs=(), dense=None, edge=None):
        out = [[], [], []] + [[] for _ in _ROW]
        if len(pairs):
            n = len(pairs[0])
            return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(n, pa.bool_())] + [pa.nulls(n, t) for t in _FOUND_TYPES[3:]], names=["a", "b", "dense", *_ROW])
        if dense is not None:
            n = len(dense[0])
            out = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.ones(n, bool)), pa.array(dense[0], pa.int32()), pa.array(dense[1])]
            return pa.record_batch(out + [pa.nulls(n, t) for t in _FOUND_TYPES[5:]], names=["a", "b", "dense", *_ROW])
        n = len(edge["node"])
        cols = [pa.array(edge[c], t) for c, t in zip(_ROW[:-1], _FOUND_TYPES[3:])] + [pa.array([r.tobytes() for r in edge["low"]], pa.binary())]
        return pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool)), *cols], names=["a", "b", "dense", *_ROW])

    def run(batches):
        held, opened = None, False
        for b in batches:
            if not b.num_rows:
                continue
            rows = {c: b.column(i).to_numpy() for i, c in enumerate(_ROW[:-1])}
            rows["low"] = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            if borders and not opened:  # a short first batch is followed by others: its rows are an edge all the same
                yield pack(edge={c: v[:window] for c, v in rows.items()})
            opened = True
            start = 0
            if held is not None:
                start = len(held["node"])
                rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
            total = len(rows["node"])
            prefix = rows["k1"] >> 16 * (4 - DEPTH)
            for s in range(1, window + 1):
                i = np.arange(max(start, s), total)
                i = i[(prefix[i] == prefix[i - s]) & (rows["tree"][i] == rows["tree"][i - s])]
                if not len(i):
                    break
                if s == window:
                    keys = np.unique(np.stack([rows["tree"][i], prefix[i]]), axis=1)
                    yield pack(dense=(keys[0], keys[1]))
                i = i[rows["component"][i] != rows["component"][i - s]]
                small, large = np.minimum(rows["n"][i], rows["n"][i - s]), np.maximum(rows["n"][i], rows["n"][i - s])
                i = i[100 * small >= percent * large]
                i = i[(rows["low"][i] == rows["low"][i - s]).sum(axis=1) >= LEAST]
                if len(i):
                    x, y = rows["node"][i], rows["node"][i - s]
                    yield pack(pairs=(np.minimum(x, y), np.maximum(x, y)))
            held = {c: v[-window:] for c, v in rows.items()}
        if borders and held is not None:
            yield pack(edge=held)

    return run


def neighbours(nodes: DataFrame, trees, window: int, percent: int):
    """(pairs (a, b), dense regions (tree, prefix)) of nodes (node, n, component, signature) in the sorted orders of `trees`.

    Orders are ranged over partitions by all places and the node, so no region has to lie in one task; the rows at both
    ends of every partition (2 windows a partition) are streamed once more for the pairs that a border parts."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "k1", "k2", "node"]
    ranged = orders(nodes, trees).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_window_pairs(window, percent, True), _FOUND), "neighbours")
    edges = found.where("NOT dense").select(*_ROW).distinct().repartition(1).sortWithinPartitions(*order)
    across = written(edges.mapInArrow(_window_pairs(window, percent, False), _FOUND), "borders")
    both = found.unionByName(across)
    return both.where("a IS NOT NULL").select("a", "b").distinct(), both.where("dense").select("tree", F.col("k1").alias("prefix")).distinct()


def _sets(docs: DataFrame, keys: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, n, shingles) of the texts with these hashes, once each; `shingles` is a sorted list of 64-bit hashes as bytes."""
    text = F.col(text_col).cast("string")
    few = keys.count() <= MOST_KEYS
    wanted = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(F.broadcast(keys) if few else keys, "key", "left_semi")

    def run(batches):
        words = _Words()
        for b in batches:
            for part in range(0, b.num_rows, 256):  # bounded sets in memory
                sets = [shingle_set(t, width, words) for t in b.column(0).slice(part, 256).cast(pa.binary()).to_pylist()]
                yield arrow_rows(["node", "n", "shingles"], [pa.int64(), pa.int64(), pa.binary()],
                                 [_as_long([_node(s) for s in sets]), [len(s) for s in sets], [s.tobytes() for s in sets]])

    return wanted.groupBy("key").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "node long, n long, shingles binary")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, written(nodes.join(ends, "node", "left_semi").select("key"), "keys"), text_col, width)
    sets = written(sets, "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    met = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield arrow_rows(["a", "b"], [pa.int64(), pa.int64()], [b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))])

    return written(met.mapInArrow(run, "a long, b long"), "links")


def _rare_by_table(sets: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(h, node, n, component, left): the rarest shared shingles of every node, `left` counts its shared ones from there on.

    `shared` has at most `MOST_KEYS` rows (16 bytes each) here; every task looks its sets up in it."""
    table = shared.orderBy("h").toArrow()
    known = shared.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), table.column(1).to_numpy()))

    def run(batches):
        keys, df = known.value
        for b in batches:
            for node, n, component, s in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                h = np.frombuffer(s.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                found = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                h, at = h[found], at[found]
                reach = n - -(-n * percent // 100) + 1 - (n - len(h))  # shingles of one component alone come first and meet nobody
                if reach > 0:
                    first = np.lexsort((h, df[at]))[:reach]
                    yield arrow_rows(["h", "node", "n", "component", "left"], [pa.int64()] * 5,
                                     [h[first], np.full(len(first), node), np.full(len(first), n), np.full(len(first), component), len(h) - np.arange(len(first))])

    return sets.mapInArrow(run, "h long, node long, n long, component long, left long")


def _rare_by_join(postings: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The same where the shared shingles are too many for a table in every task."""
    alone = F.col("n") - F.size("l")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    rare = spread_join(postings, shared, "h", shared.select("h", F.col("df").alias("n")), "node").groupBy("node", "n", "component").agg(
        F.array_sort(F.collect_list(F.struct("df", "h"))).alias("l"))  # one text's own shingles
    rare = rare.where(reach > 0).select("node", "n", "component", F.size("l").alias("most"), F.posexplode(F.slice("l", 1, reach.cast("int"))).alias("i", "x"))
    return rare.select(F.col("x.h").alias("h"), "node", "n", "component", (F.col("most") - F.col("i")).cast("long").alias("left"))


def rest_pairs(nodes: DataFrame, dense: DataFrame, docs: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """Candidates inside dense regions that hold several components: every pair of theirs at the similarity is among them."""
    places = orders(nodes, range(TREES)).select("tree", F.shiftright("k1", 16 * (4 - DEPTH)).alias("prefix"), "node", "component")
    few = dense.count() <= MOST_KEYS
    inside = places.join(F.broadcast(dense) if few else dense, ["tree", "prefix"])
    inside = written(inside, "dense")
    mixed = inside.groupBy("tree", "prefix").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("tree", "prefix")
    mixed = written(mixed, "mixed")
    few = mixed.count() <= MOST_KEYS
    open_nodes = inside.join(F.broadcast(mixed) if few else mixed, ["tree", "prefix"], "left_semi").select("node").distinct()
    members = written(nodes.join(open_nodes, "node", "left_semi").select("node", "component", "key"), "members")
    sets = _sets(docs, members.select("key"), text_col, width)
    sets = written(sets.join(members.select("node", "component"), "node").select("node", "n", "component", "shingles"), "sets")

    def listed(batches):
        for b in batches:
            for node, n, component, s in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                h = np.frombuffer(s.as_buffer(), np.int64)
                yield arrow_rows(["node", "n", "component", "h"], [pa.int64()] * 4, [np.full(len(h), node), np.full(len(h), n), np.full(len(h), component), h])

    postings = sets.mapInArrow(listed, "node long, n long, component long, h long")
    shared = postings.groupBy("h").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    shared = written(shared.select("h", "df"), "frequencies")
    few = shared.count() <= MOST_KEYS
    placed = written(_rare_by_table(sets, shared, percent) if few else _rare_by_join(postings, shared, percent), "rare")
    sizes = placed.groupBy("h", "component").agg(F.count("*").alias("m"))
    heavy = sizes.groupBy("h").agg(F.max_by("component", F.struct("m", "component")).alias("heavy"), F.count("*").alias("sides"), F.sum("m").alias("m"))
    heavy = written(heavy.where("sides > 1"), "heavy")
    counts = heavy.select("h", F.col("m").alias("n"))
    split = written(spread_join(placed, heavy.select("h", "heavy"), "h", counts, "node"), "split")
    light = split.where("component <> heavy").select("h", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("left").alias("lx"))
    other = split.select("h", "heavy", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("left").alias("ly"))
    met = spread_join(other, light, "h", counts, "y").where("cx <> cy AND (cy = heavy OR cx < cy)")
    # the first shingle that two sets share leaves each at least as many shingles, itself included, as they must have in common
    met = met.where((100 + percent) * F.least("lx", "ly") >= percent * (F.col("nx") + F.col("ny")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` with the component each belongs to by `links`."""
    parts = components(links)
    few = parts.count() <= MOST_KEYS
    return written(nodes.drop("component").join(F.broadcast(parts) if few else parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80, window: int = 8) -> DataFrame:
    """(id_col, n_shingles, component_id, kept): one row per document."""
    each = written(signed(docs, id_col, text_col, width), "signed")
    named = each.where("node IS NOT NULL").groupBy("node").agg(
        F.min(id_col).alias("first"), F.count("*").alias("rows"), F.min(F.struct("key", "n", "signature")).alias("s"))
    nodes = written(named.select("node", "first", "rows", "s.key", "s.n", "s.signature", F.col("node").alias("component")), "nodes")

    pairs, _ = neighbours(nodes, FIRST_TREES, 1, percent)
    links = confirmed(pairs, nodes, docs, text_col, width, percent)
    nodes = _labelled(nodes, links)
    pairs, dense = neighbours(nodes, range(TREES), window, percent)
    links = written(links.unionByName(confirmed(pairs, nodes, docs, text_col, width, percent)), "links")
    nodes = _labelled(nodes, links)
    dense = written(dense, "regions")
    if not dense.isEmpty():
        more = confirmed(rest_pairs(nodes, dense, docs, text_col, width, percent), nodes, docs, text_col, width, percent)
        if not more.isEmpty():
            nodes = _labelled(nodes, links.unionByName(more))

    names = nodes.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    whole = spread_join(nodes.select("node", "component"), names.drop("n"), "component", names.select("component", "n"), "node").select("node", "component_id")
    linked = spread_join(each.where("node IS NOT NULL"), whole, "node", nodes.select("node", F.col("rows").alias("n")), F.struct(id_col, "key"))
    empty = each.where("node IS NULL").withColumn("component_id", F.col(id_col))
    columns = [id_col, F.col("n").alias("n_shingles"), "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept")]
    return linked.select(*columns).unionByName(empty.select(*columns))
