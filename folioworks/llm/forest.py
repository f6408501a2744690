"""Near-duplicate classes by an LSH forest over MinHash signatures.

Each of several orders sorts all signatures, from a hash of its own on.  Neighbours
in an order are the rows with a long common prefix: regions are as shallow as they
are sparse, and as deep as ``depth`` hashes where they are crowded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import forget_encoder, scratch_dir, stored
from .tables import width as width_of


@dataclass(frozen=True)
class Forest:
    """``orders`` sorted orders of signatures, each looked at ``depth`` hashes deep.

    All rows that share the first ``depth`` hashes of an order are neighbours there,
    however many.  A pair at similarity s does so with probability s**depth; all
    orders miss it with (1 - s**depth)**orders, 3e-7 at s = 0.85 and 6e-5 at 0.8 for
    the defaults.  Where no more than ``crowd`` different rows share a prefix of only
    ``shallow`` hashes (or of any length up to ``depth``), they are neighbours, too.
    """

    shingle: int = 5
    percent: int = 80
    orders: int = 32
    depth: int = 6
    shallow: int = 4
    crowd: int = 32
    # Rows of one region that are compared with each other in one piece; larger
    # regions are dealt over cells of two blocks of about so many rows.
    region_rows: int = 4096
    # Pairs for each row beyond which a region is dense.
    sparse: int = 8
    # Standard errors by which a signature's estimate may fall short of the
    # threshold before a pair is no candidate.
    slack: float = 4.0

    @property
    def hashes(self) -> int:
        return self.orders * self.depth

    @property
    def least_equal(self) -> int:
        """Equal hashes that a candidate pair has at least."""
        p = self.percent / 100
        return math.floor(self.hashes * p - self.slack * math.sqrt(self.hashes * p * (1 - p)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.arange(1, 2 * n + 1, dtype=np.uint64)
    drawn = W.mixed(count * np.uint64(0xA0761D6478BD642F))
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


def sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in W.groups(column):
        hashes, _, _, at = W.words(data, offsets, W.NOT_SPACE)
        yield first, end, *W.shingles(hashes, at, shingle)


def sketches(docs: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """(id, n_shingles, content, signature) of every text.

    ``content`` is a 128-bit digest of the shingle set: equal sets, equal digest.
    """
    factor, offset = _multipliers(forest.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        for batch in batches:
            for first, end, shingle, at in sets_of(batch.column(1), forest.shingle):
                rows = end - first
                low = (shingle >> np.uint64(32)).astype(np.uint32)
                signature = np.empty((rows, forest.hashes), dtype=np.uint16)
                for j in range(forest.hashes):
                    least = W.reduced(np.minimum, (low ^ offset[j]) * factor[j], at, 0)
                    signature[:, j] = W.mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)
                digest = np.stack([
                    W.reduced(np.add, W.mixed(shingle + np.uint64(0x5851F42D4C957F2D)), at, 0),
                    W.reduced(np.bitwise_xor, W.mixed(shingle ^ np.uint64(0x14057B7EF767814F)), at, 0)], axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([x.tobytes() for x in digest], pa.binary()),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                ], ["id", "n_shingles", "content", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, n_shingles long, content binary, signature binary")


class _Walk:
    """Reads the rows of sorted orders and tells the regions, holding at most ``crowd`` heads.

    A head is the first row of those that share ``depth`` hashes.  The run of heads
    that share ``shallow`` hashes is one region if it is no crowd; else its runs at
    each greater depth are, on the same condition.  Rows that share ``depth`` hashes
    are a region always.
    """

    def __init__(self, forest: Forest):
        self.depth, self.crowd = forest.depth, forest.crowd
        self.depths = range(forest.shallow, forest.depth)
        # Of each depth: heads of the run under way (one more than a crowd at most).
        self.heads: dict[int, list[int]] = {d: [] for d in self.depths}
        # Closed runs of the next depth, which count if the run under way grows to a crowd.
        self.inner: dict[int, list[tuple]] = {d: [] for d in self.depths}
        self.out: list[tuple] = []  # (order, depth, prefix, id)
        self.first = None  # of a deepest run, while it is alone

    def _closed(self, depth: int, order: int, key: bytes) -> None:
        """End the run of this depth, and the deeper ones in it."""
        if depth + 1 < self.depth:
            self._closed(depth + 1, order, key)
        heads, inner = self.heads[depth], self.inner[depth]
        if len(heads) > self.crowd:
            found = inner
        else:
            found = [(order, depth, key[: 2 * depth], i) for i in heads] if len(heads) > 1 else []
        if depth - 1 in self.heads and len(self.heads[depth - 1]) <= self.crowd:
            self.inner[depth - 1] += found  # the outer run decides
        else:
            self.out += found
        self.heads[depth], self.inner[depth] = [], []

    def row(self, order: int, key: bytes, row_id: int, common: int, was: tuple[int, bytes] | None, edge: bool) -> None:
        """``common``: hashes shared with the row before, ``was``; ``edge``: its run may go on elsewhere."""
        if common == self.depth:
            if self.first is not None:
                self.out.append((order, self.depth, key, self.first))
                self.first = None
            self.out.append((order, self.depth, key, row_id))
            return
        if was is not None:
            ending = max(common + 1, self.depths.start)
            if ending < self.depth:
                self._closed(ending, *was)
        for d in self.depths:
            if len(self.heads[d]) <= self.crowd:
                self.heads[d].append(row_id)
                if len(self.heads[d]) > self.crowd and (d - 1 not in self.heads or len(self.heads[d - 1]) > self.crowd):
                    self.out += self.inner[d]  # it has grown to a crowd: its closed runs stand
                    self.inner[d] = []
        self.first = row_id
        if edge:
            self.out.append((order, self.depth, key, row_id))
            self.first = None

    def ended(self, order: int, key: bytes) -> None:
        """Close what is under way; the last row's run may go on elsewhere."""
        if self.depths:
            self._closed(self.depths.start, order, key)
        if self.first is not None:
            self.out.append((order, self.depth, key, self.first))


def _filed(distinct: DataFrame, forest: Forest) -> DataFrame:
    """(region, id, order): the neighbours of each sorted order, by region.

    The orders are sorted by ranges over all rows, so a crowd of equal prefixes is dealt
    over many tasks.  A task names the deepest runs at its edges even if they are
    single rows there, so no run is lost between two tasks; regions of one row are
    left out afterwards.
    """
    width, n = 2 * forest.depth, forest.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, was = _Walk(forest), None
        held: tuple | None = None  # the row before, until it is known whether it has a neighbour

        def found() -> pa.RecordBatch:
            rows, walk.out = walk.out, []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.int64()))],
                ["order", "depth", "prefix", "id"])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            order, key, ids = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            raw = np.frombuffer(b"".join(key.to_pylist()), np.uint16).reshape(-1, n)
            before = np.concatenate([raw[:1] if was is None else np.frombuffer(was[1], np.uint16)[None], raw[:-1]])
            same = np.concatenate([raw == before, np.zeros((len(raw), 1), bool)], axis=1)
            common = np.where(np.concatenate([[was is not None and was[0] == order[0]], order[1:] == order[:-1]]),
                              np.argmin(same, axis=1), -1)
            if first:
                common[0] = -1
            # Rows without a neighbour on either side are most of all; the walk needs the others only.
            near = common >= forest.shallow
            wanted = near.copy()
            wanted[:-1] |= near[1:]
            wanted[[0, -1]] = True  # what comes before and after is not known here
            at = np.flatnonzero(wanted)
            for k, o, c in zip(at.tolist(), order[at].tolist(), common[at].tolist()):
                own = raw[k].tobytes()
                walk.row(o, own, int(ids[k]), c, held, first and k == 0)
                held = (o, own)
            first = False
            was = int(order[-1]), raw[-1].tobytes()
            if len(walk.out) > 50_000:
                yield found()
        if held is not None:
            walk.ended(*held)
            yield found()

    keys = F.transform(F.sequence(F.lit(0), F.lit(forest.orders - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width)))
    rows = distinct.select("id", F.posexplode(keys).alias("order", "key")).select("order", "key", "id")
    tasks = max(width_of(distinct.sparkSession), 1)
    walked = rows.repartitionByRange(tasks, "order", "key", "id").sortWithinPartitions("order", "key", "id").mapInArrow(
        run, "order int, depth int, prefix binary, id long")
    return walked.select(F.xxhash64("order", "depth", "prefix").alias("region"), "id", "order")


def _estimated(pairs: DataFrame, distinct: DataFrame, forest: Forest) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, forest.hashes)
                    for k in (2, 3))
            kept = pa.array((x == y).sum(axis=1) >= forest.least_equal)
            yield batch.select([0, 1]).filter(kept)

    sig = distinct.select("id", "signature")
    return (
        pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
        .join(sig.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    )


def _members(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """(id, members): the full shingle sets of the wanted ids, as sorted 64-bit hashes."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, shingle, at in sets_of(batch.column(1), forest.shingle):
                raw = shingle.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first),
                    pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()),
                ], ["id", "members"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(
        wanted, "id", "left_semi").mapInArrow(shingled, "id long, members binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Is 100 * intersection >= percent * union of two sorted sets?"""
    both = len(x) + len(y)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), forest.percent)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    # Stored, so that its size is known: a short list is sent to the texts instead of
    # shuffling them.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = stored(wanted, f"{scratch_dir(docs.sparkSession)}/wanted")
    sets = _members(docs, wanted, id_col, text_col, forest)
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")
    )


def _regions(rows: DataFrame, stats: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` of open regions, with ``side``, in regions or cells of bounded size;
    ``stats`` are the regions' sizes.

    A region of more than ``region_rows`` rows is dealt over cells.  The rows of
    its most common label need no comparison among themselves: their blocks of
    about ``region_rows`` rows each meet every block of the others, and those
    meet each other.  So each pair of labels meets in exactly one cell.  In a
    cell of two blocks, sides 1 and 2 are compared; side 0 is one block.
    """
    columns = ["region", "id", "label", "signature", "order", "side"]
    rows = stored(rows, f"{scratch_dir(rows.sparkSession)}/rows").withColumn("side", F.lit(0))
    dense = stats.filter(F.col("n") > forest.region_rows).select("region")
    if dense.isEmpty():
        return rows.select(columns)
    crowd = rows.join(dense, "region", "left_semi")

    def blocks(n):
        return F.ceil(n / forest.region_rows).cast("int")

    sizes = (
        crowd.groupBy("region", "label").agg(F.count("*").alias("n"))
        .groupBy("region").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
        .select("region", F.col("most.label").alias("common"), blocks(F.col("most.n")).alias("ours"),
                blocks(F.col("n") - F.col("most.n")).alias("others"))
    )
    sizes = stored(sizes, f"{scratch_dir(rows.sparkSession)}/sizes")

    def cell(kind, x, y, side):
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))

    block, common = F.col("block"), F.col("label") == F.col("common")
    placed = crowd.join(sizes, "region").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.when(common, F.col("ours")).otherwise(F.col("others"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("others") - 1)
    cells = F.when(common, F.transform(every, lambda k: cell(0, block, k, F.lit(1)))).otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("ours") - 1), lambda k: cell(0, k, block, F.lit(2))),
        F.transform(every, lambda k: cell(
            1, F.least(k, block), F.greatest(k, block), F.when(k == block, 0).when(block < k, 1).otherwise(2)))))
    placed = placed.withColumn("cell", F.explode(cells)).withColumn("side", F.col("cell.side")).withColumn(
        "region", F.xxhash64("region", "cell.kind", "cell.x", "cell.y"))
    return rows.join(dense, "region", "left_anti").select(columns).union(placed.select(columns))


def _open_regions(rows: DataFrame) -> DataFrame:
    """(region, n): the regions that hold several labels, and their rows."""
    return rows.groupBy("region").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    ).filter("low <> high").select("region", "n")


def _pairs_in(labels: np.ndarray, signature: np.ndarray, side: np.ndarray, order: int, forest: Forest) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a region: the later rows of another label, and of the other
    side if it has two, that its signature doesn't rule out, less those that
    share an earlier order's prefix and so were compared in that order: whole
    regions are, however large (see ``_regions``)."""
    for i in range(len(labels) - 1):
        other = labels[i + 1 :] != labels[i]
        if side[i]:
            other &= side[i + 1 :] != side[i]
        rest = np.flatnonzero(other) + i + 1
        if not len(rest):
            continue
        same = signature[rest] == signature[i]
        near = same.sum(axis=1) >= forest.least_equal
        rest, same = rest[near], same[near]
        if order and len(rest):
            earlier = same[:, : order * forest.depth].reshape(len(rest), order, forest.depth).all(axis=2).any(axis=1)
            rest = rest[~earlier]
        if len(rest):
            yield i, rest


def _by_region(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[tuple]:
    """(region, ids, labels, signatures, sides, order, slice of the table) of rows sorted by region."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[tuple]:
        region = table.column("region").to_numpy()
        at = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
        ids, labels, side, order = (table.column(c).to_numpy() for c in ("id", "label", "side", "order"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, forest.hashes)
        for i, j in zip(at[:-1], at[1:]):
            yield int(region[i]), ids[i:j], labels[i:j], signature[i:j], side[i:j], int(order[i]), table.slice(i, j - i)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column("region")[-1].as_py()
        if held[0].column("region")[0].as_py() == last:
            continue  # one region so far, and it may go on
        table = pa.Table.from_batches(held)
        whole = int(np.flatnonzero(table.column("region").to_numpy() != last)[-1]) + 1
        yield from cut(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held))


def _open_pairs(regions: DataFrame, forest: Forest) -> DataFrame:
    """(region, a, b): candidate pairs of different labels, each from one region only.

    A region with many more pairs than rows is named without them (a and b
    null): it is dense and its sets are compared where they meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, ids, labels, signature, side, order, _ in _by_region(batches, forest):
            left, right, dense = [], [], False
            for i, rest in _pairs_in(labels, signature, side, order, forest):
                left.append(np.full(len(rest), ids[i]))
                right.append(ids[rest])
                if dense := sum(map(len, left)) > forest.sparse * len(ids):
                    break
            if dense:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([region]), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["region", "a", "b"])
            elif left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), region)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))],
                    ["region", "a", "b"])

    return regions.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, a long, b long")


def _dense_links(regions: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): links that join the labels of each dense region, found on the full
    sets within the task; of links that join the same labels only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, labels, signature, side, order, table in _by_region(batches, forest):
            members = [np.frombuffer(m.as_buffer(), np.uint64) for m in table.column("members")]
            _, label = np.unique(labels, return_inverse=True)
            root = list(range(len(ids)))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            links = []
            for i, rest in _pairs_in(labels, signature, side, order, forest):
                for j in rest.tolist():
                    x, y = top(int(label[i])), top(int(label[j]))
                    if x != y and _linked(members[i], members[j], forest.percent):
                        root[max(x, y)] = min(x, y)
                        links.append(sorted((int(ids[i]), int(ids[j]))))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return (
        regions.join(sets, "id").repartition("region").sortWithinPartitions("region").mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): classes of near copies of whole texts.

    1. Equal shingle sets are one class by their digest; the smallest id stands
       for it from here on.
    2. Every order of the forest sorts the distinct sets by their signature and
       finds regions of rows with a common prefix, deeper where they are crowded
       (see ``Forest``).  Sets of one region are neighbours; each is first
       checked against the most central of them (the one with most neighbours
       in all orders), which joins a large group of copies at the cost of one
       comparison a member, and never by all its pairs.
    3. Where a region still holds several components, all pairs between them
       are compared by signature inside the task (regions of more than
       ``region_rows`` rows block by block, in many tasks), and what the
       estimate can't rule out is confirmed on the full sets: pair by pair
       where they are few, else inside the task of the region.

    Null and empty texts have an empty set and are linked with nothing; repeated
    rows of one id count once with their smallest digest; null ids are left out.
    """
    base = scratch_dir(docs.sparkSession)
    docs = docs.filter(F.col(id_col).isNotNull())
    sketch = stored(sketches(docs, id_col, text_col, forest), f"{base}/sketch")
    classes = stored(
        sketch.filter("n_shingles > 0").groupBy("content").agg(F.min("id").alias("rep")), f"{base}/classes")
    distinct = stored(
        sketch.join(classes, (sketch.content == classes.content) & (sketch.id == classes.rep), "left_semi")
        .dropDuplicates(["id"]), f"{base}/distinct")

    filed = stored(_filed(distinct, forest), f"{base}/walked")
    shared = filed.groupBy("region").agg(F.count("*").alias("n")).filter("n > 1")
    filed = stored(filed.join(shared, "region"), f"{base}/filed")

    central = filed.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = filed.select("region", "id").join(central, "id")
    hubs = ranked.groupBy("region").agg(F.max(F.struct("degree", F.negative("id").alias("other"))).alias("top"))
    best = (
        filed.select("region", "id").join(hubs, "region")
        .groupBy("id", F.negative("top.other").alias("hub"))
        .agg(F.count("*").alias("n"))
        .filter("id <> hub").groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    )
    first = best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    first = stored(_estimated(first, distinct, forest), f"{base}/first")
    links = stored(_confirmed(first, docs, id_col, text_col, forest), f"{base}/links-1")
    labels = components(links)

    rows = (
        filed.select("region", "id", "order").join(labels.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("label", F.coalesce("component", "id"))
    )
    stats = stored(_open_regions(rows), f"{base}/open")
    rows = rows.join(stats.select("region"), "region", "left_semi").join(distinct.select("id", "signature"), "id")
    rows = rows.select("region", "id", "label", "signature", "order")
    regions = _regions(rows, stats, forest)
    second = stored(_open_pairs(regions, forest), f"{base}/second")
    pairs = second.filter("a is not null").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    pairs = stored(pairs, f"{base}/pairs")
    links = links.union(_confirmed(pairs, docs, id_col, text_col, forest))
    dense = regions.join(second.filter("a is null").select("region"), "region", "left_semi")
    # Stored for the same reason as ``wanted`` in ``_confirmed``.
    crowded = stored(dense.select("id").distinct(), f"{base}/crowded")
    sets = _members(docs, crowded, id_col, text_col, forest)
    links = links.union(_dense_links(dense, sets, forest))
    labels = components(stored(links, f"{base}/links"))

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "content", F.coalesce("component", "rep").alias("component_id"))
    return (
        sketch.select("id", "n_shingles", "content").dropDuplicates(["id"]).join(named, "content", "left")
        .select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col("id") == F.col("component_id"))
    )
