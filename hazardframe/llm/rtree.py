"""Hard-negative mining by inner product over an R-tree packed by sort-tile-recursive.

Packing: the rows are cut at quantiles of their most varying coordinate, each slab at quantiles of the next, and so on,
into tiles of about TILE_ROWS rows; inside its tile a row goes on to leaves of LEAF_ROWS rows in the same way. Equal
coordinates are told apart by a hash, so that a vector which very many rows share fills many tiles. Leaves, tiles and
parts of up to PART_TILES tiles carry minimum bounding boxes; a tile is one row of packed arrays.

Searching: over a box each coordinate of the inner product with a query lies in an interval, and the sums of their ends
bound every score in the box. The anchors of a tile travel as one block. A block first searches its own tile, which
gives each window a k-th score; then the boxes of the other tiles are held against it, and the block's anchors go only
to tiles that could hold a score inside a window that is not strictly below the k-th. Inside a tile each anchor takes
leaves from a queue by falling upper bound, until none could add to its result; a leaf outside all of its windows is passed over.

What a block finds in a tile is at most k rows for each window; the k first of all tiles are found by a window over them.
No cap cuts the search: where boxes tell nothing (vectors without structure) every tile is visited.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardframe.llm.storage import delete_table, write_table
from hazardframe.llm.textblocks import segment_arange

TILE_ROWS = 8_192
LEAF_ROWS = 256
PART_TILES = 1_024
BLOCKS_PER_TASK = 32  # blocks that one task holds against a tile, or a part
LIMIT = 1 << 22  # components are held within it, so that a hundred times any score of up to 1,024 coordinates fits 64 bits
LOWEST, HIGHEST = -(1 << 62), 1 << 62


# --- packing --------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """The packed tiles, the boxes of the tiles in parts, and the tables to delete when done."""

    tiles: DataFrame
    parts: DataFrame
    n_tiles: int
    n_parts: int
    dims: int
    exact: bool  # whether doubles hold every score
    wide: str  # how a component is stored
    paths: list[str]

    @property
    def kind(self) -> type:
        return np.float64 if self.exact else np.int64


def _str_order(x: np.ndarray, coordinates: list[int], tie: np.ndarray, leaf: int) -> np.ndarray:
    """Order of the rows in which stretches of ``leaf`` rows are STR leaves."""
    if len(x) <= leaf or not coordinates:
        return np.arange(len(x))
    order = np.lexsort((tie, x[:, coordinates[0]]))
    slabs = math.ceil(math.ceil(len(x) / leaf) ** (1 / len(coordinates)))
    rows = math.ceil(math.ceil(len(x) / leaf) / slabs) * leaf
    return np.concatenate([part[_str_order(x[part], coordinates[1:], tie[part], leaf)] for part in np.split(order, range(rows, len(x), rows))])


def _boxes(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, begin, axis=0), np.maximum.reduceat(x, begin, axis=0)


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column; missing coordinates of shorter vectors are zero."""
    column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), segment_arange(size)] = column.flatten().to_numpy()
    return out


TILE = "tile bigint, low binary, high binary, leaf_low binary, leaf_high binary, vectors binary, labels binary, ids binary, anchors binary, copies binary"


def _pack(dims: int, coordinates: list[int], wide: str) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        x = _vectors(rows["vector"], dims)
        tie = rows["tie"].to_numpy()
        order = _str_order(x, coordinates, tie, LEAF_ROWS)
        x = x[order]
        leaf_low, leaf_high = _boxes(x, np.arange(0, len(x), LEAF_ROWS))
        null = rows["id"].is_null().to_numpy()
        ids = np.stack([rows["id"].fill_null(0).to_numpy(), null]).astype("<i8")[:, order]
        packed = {
            "low": x.min(axis=0).astype(wide), "high": x.max(axis=0).astype(wide), "leaf_low": leaf_low.astype(wide), "leaf_high": leaf_high.astype(wide), "vectors": x.astype(wide),
            "labels": rows["label"].to_numpy()[order].astype("<i8"), "ids": ids, "anchors": rows["anchor"].to_numpy(zero_copy_only=False)[order], "copies": rows["copies"].to_numpy()[order].astype("<i8"),
        }
        return pa.table({"tile": rows["tile"].slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()}})

    return run


def _tiled(rows: DataFrame, coordinates: list[int], slabs: int) -> DataFrame:
    """Rows with the number of their tile: cut at quantiles of each coordinate within the slabs of those before."""
    out = rows.withColumn("tile", F.lit(0).cast("long"))
    if slabs < 2:
        return out
    levels = F.array(*[F.lit(i / slabs) for i in range(1, slabs)])
    for step, c in enumerate(coordinates):
        # Whole numbers plus a fraction that differs from row to row: equal coordinates are cut too.
        out = out.withColumn("_at", F.coalesce(F.get("vector", F.lit(c)), F.lit(0)) + (F.col("tie") + 0.5) / F.lit(float(1 << 20)))
        cuts = F.percentile_approx("_at", levels, 200 * slabs)
        if step == 0:
            first = out.agg(cuts.alias("c")).first()["c"]
            out = out.withColumn("_cuts", F.array(*[F.lit(v) for v in first]))
        else:
            out = out.join(out.groupBy("tile").agg(cuts.alias("_cuts")), "tile")
        out = out.withColumn("tile", F.col("tile") * slabs + F.size(F.filter("_cuts", lambda v: v <= F.col("_at")))).drop("_at", "_cuts")
    return out


def build(df: DataFrame, id_column: str, label: str, vector: str, anchor: Column, most: int) -> Tree:
    """Pack the rows of ``df``. Equal rows are one with a count; of each at most ``most`` copies are kept as entries, more
    than any search can return."""
    spark = df.sparkSession
    held = F.transform(F.col(vector), lambda v: F.least(F.greatest(v, F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(label).alias("label"), held.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.groupBy("id", "label", "vector", "anchor").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(most)).cast("int"))))
    # A copy beyond the first is no anchor of its own: results are repeated by the count.
    rows = rows.select("id", "label", "vector", (F.col("anchor") & (F.col("copy") == 1)).alias("anchor"), "copies", (F.xxhash64("id", "label", "vector", "copy").bitwiseAND((1 << 20) - 1)).alias("tie"))
    rows, path = write_table(rows, "rows")
    count = rows.count()
    spread = rows.select(F.posexplode("vector")).groupBy("pos").agg(
        F.sum("col").alias("s"), F.sum(F.col("col").cast("double") * F.col("col")).alias("ss"), F.max(F.abs("col")).alias("m")
    ).collect()  # one row for each coordinate
    dims = 1 + max((r["pos"] for r in spread), default=0)
    largest = max((r["m"] for r in spread), default=0)
    varying = [r["pos"] for r in sorted(spread, key=lambda r: (-(r["ss"] - r["s"] * r["s"] / count), r["pos"]))]
    levels = 1 if count <= 4 * TILE_ROWS else 2 if count <= 4_096 * TILE_ROWS else 3
    slabs = max(1, math.ceil(math.ceil(count / TILE_ROWS) ** (1 / levels)))
    tiled = _tiled(rows, varying[:levels], slabs)
    inner = varying[levels : levels + 2] or varying[:2]
    wide = "<i2" if largest < 1 << 15 else "<i4"
    tiles, tile_path = write_table(tiled.groupBy("tile").applyInArrow(_pack(dims, inner, wide), TILE), "tiles")
    delete_table(spark, path)
    boxes = tiles.select(F.col("tile"), "low", "high")
    numbered = boxes.withColumn("part", F.floor(F.col("tile") / PART_TILES))

    def join(part: pa.Table) -> pa.Table:
        return pa.table({
            "part": part["part"].slice(0, 1), "tiles": pa.array([part["tile"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "low": pa.array([b"".join(part["low"].to_pylist())], pa.binary()), "high": pa.array([b"".join(part["high"].to_pylist())], pa.binary()),
        })

    parts, part_path = write_table(numbered.groupBy("part").applyInArrow(join, "part bigint, tiles binary, low binary, high binary"), "parts")
    return Tree(
        tiles.withColumn("wide", F.lit(wide)), parts.withColumn("wide", F.lit(wide)), n_tiles=tiles.count(), n_parts=math.ceil(slabs**levels / PART_TILES), dims=dims,
        exact=dims * largest * largest < 1 << 53, wide=wide, paths=[tile_path, part_path],
    )


# --- searching ------------------------------------------------------------------------------------------------------


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of each query with anything in each box: the intervals of the coordinates, added up."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


@dataclass
class Queries:
    """Anchors (vector, label, own place in the home tile) with windows of scores and the k-th score known for each."""

    at: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray

    def some(self, pick: np.ndarray) -> Queries:
        return Queries(*(getattr(self, f)[pick] for f in ("at", "vectors", "labels", "low", "high", "kth")))

    def need(self) -> np.ndarray:
        return np.maximum(self.kth, self.low)


def _search(tile: dict, q: Queries, k: int, same: bool, home: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Best-first search in a tile. (query, window, row, score) of the k first of each window, and the k-th scores then known."""
    x, labels, ids, null = tile["vectors"], tile["labels"], tile["ids"], tile["null"]
    lower, upper = _bounds(q.vectors, tile["leaf_low"], tile["leaf_high"])
    order = np.argsort(-upper, axis=1, kind="stable")
    best = np.full((*q.low.shape, k), LOWEST, x.dtype)
    kth, every = q.kth.copy(), np.arange(len(q.at))
    real = q.low <= q.high
    found: list[tuple[np.ndarray, ...]] = []
    queue = every  # those whose queue is not done
    for step in range(order.shape[1]):
        box = order[queue, step]
        need = np.maximum(kth[queue], q.low[queue])
        reach = real[queue] & (upper[queue, box][:, None] >= need)
        going = reach.any(axis=1)  # bounds only fall from here on
        visit = (reach & (lower[queue, box][:, None] <= q.high[queue])).any(axis=1)
        picked, boxes = queue[visit], box[visit]
        queue = queue[going]
        if not len(queue):
            break
        order_by_box = np.argsort(boxes, kind="stable")
        picked, boxes = picked[order_by_box], boxes[order_by_box]
        edges = np.flatnonzero(np.diff(boxes, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            who, leaf = picked[a:b], slice(int(boxes[a]) * LEAF_ROWS, int(boxes[a]) * LEAF_ROWS + LEAF_ROWS)
            score = q.vectors[who] @ x[leaf].T
            fit = (labels[leaf][None, :] == q.labels[who][:, None]) == same
            if home:
                own = q.at[who] - leaf.start
                inside = (own >= 0) & (own < score.shape[1])
                fit[np.flatnonzero(inside), own[inside]] = False
            wide = score[:, None, :]
            fit = fit[:, None, :] & (wide >= np.maximum(kth[who], q.low[who])[:, :, None]) & (wide <= q.high[who][:, :, None])
            hit, window, row = np.nonzero(fit)
            if not len(hit):
                continue
            found.append((who[hit], window, row + leaf.start, score[hit, row]))
            some = np.unique(hit)
            both = np.concatenate([best[who[some]], np.where(fit[some], wide[some], LOWEST)], axis=2)
            best[who[some]] = np.partition(both, both.shape[2] - k, axis=2)[:, :, -k:]
            kth[who[some]] = np.maximum(kth[who[some]], best[who[some]].min(axis=2))
    who, window, row, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    keep = score >= kth[who, window]
    who, window, row, score = who[keep], window[keep], row[keep], score[keep]
    order = np.lexsort((ids[row], null[row], -score, window, who))
    who, window, row, score = who[order], window[order], row[order], score[order]
    group = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0))
    place = segment_arange(np.diff(np.append(group, len(who))))
    first = place < k
    return (who[first], window[first], row[first], score[first]), kth


def _open_tile(row: dict, dims: int, kind: type) -> dict:
    wide = row["wide"]
    matrix = lambda name: np.frombuffer(row[name], wide).reshape(-1, dims).astype(kind)
    ids = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
    return {
        **{name: matrix(name) for name in ("leaf_low", "leaf_high", "vectors")}, "labels": np.frombuffer(row["labels"], "<i8"), "ids": ids[0], "null": ids[1],
        "anchors": np.frombuffer(row["anchors"], bool), "copies": np.frombuffer(row["copies"], "<i8"),
    }


BLOCK = "block bigint, at binary, ids binary, copies binary, labels binary, vectors binary, low binary, high binary, kth binary"
_BLOCK_COLUMNS = ["at", "ids", "copies", "labels", "vectors", "low", "high", "kth"]


def _block(number: int, q: Queries, ids: np.ndarray, copies: np.ndarray, wide: str) -> dict:
    whole = lambda v: v.astype("<i8").tobytes()
    return {
        "block": number, "at": whole(q.at), "ids": whole(ids), "copies": whole(copies), "labels": whole(q.labels), "vectors": q.vectors.astype(wide).tobytes(),
        "low": whole(q.low), "high": whole(q.high), "kth": whole(q.kth),
    }


def _open_block(row: dict, dims: int, kind: type, wide: str) -> tuple[Queries, np.ndarray, np.ndarray]:
    whole = lambda name: np.frombuffer(row[name], "<i8")
    at = whole("at")
    windows = {name: whole(name).reshape(len(at), -1).astype(kind) for name in ("low", "high", "kth")}
    return Queries(at, np.frombuffer(row["vectors"], wide).reshape(-1, dims).astype(kind), whole("labels"), **windows), whole("ids"), whole("copies")


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({n: pa.array([r[n] for r in rows], kinds[t]) for n, t in fields})


HIT = "block bigint, at bigint, anchor_id bigint, copies bigint, window bigint, score bigint, id bigint"


def _hits(block: int, q: Queries, ids: np.ndarray, copies: np.ndarray, tile: dict, found: tuple[np.ndarray, ...]) -> pa.Table:
    who, window, row, score = found
    return pa.table({
        "block": pa.array(np.full(len(who), block)), "at": pa.array(q.at[who]), "anchor_id": pa.array(ids[who]), "copies": pa.array(copies[who]), "window": pa.array(window.astype(np.int64)),
        "score": pa.array(score.astype(np.int64)), "id": pa.array(tile["ids"][row], mask=tile["null"][row] == 1),
    })


_HIT_SCHEMA = pa.schema([(n.split(" ")[0], pa.int64()) for n in HIT.split(", ")])


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _salted(blocks: DataFrame, targets: DataFrame, key: str, n_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt by block: no (key, salt) meets more than about BLOCKS_PER_TASK blocks."""
    salts = max(1, math.ceil(n_blocks / BLOCKS_PER_TASK))
    spread = targets.withColumn("salt", F.explode(_numbers(salts)))
    return blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).groupBy(key, "salt"), spread.groupBy(key, "salt")


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k first of each window, numbered from 1."""
    order = Window.partitionBy("block", "at", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(tree: Tree, blocks: DataFrame, k: int, same: bool) -> tuple[DataFrame, list[str]]:
    """The k first rows of each window of each anchor, by a search of the home tile and of all tiles that could add to it."""
    dims, kind = tree.dims, tree.kind

    def at_home(key, here: pa.Table, tiles: pa.Table) -> pa.Table:
        out = []
        for row in tiles.to_pylist()[:1]:
            tile = _open_tile(row, dims, kind)
            for b in here.to_pylist():
                q, ids, copies = _open_block(b, dims, kind, row["wide"])
                found, kth = _search(tile, q, k, same, True)
                q.kth = kth
                hits = _hits(b["block"], q, ids, copies, tile, found).cast(_HIT_SCHEMA)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _HIT_SCHEMA) as out_stream:
                    out_stream.write_table(hits)
                out.append({**_block(b["block"], q, ids, copies, row["wide"]), "hits": sink.getvalue().to_pybytes(), "wide": row["wide"]})
        return _table(out, BLOCK + ", hits binary, wide string")

    def other_tiles(key, here: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for part in parts.to_pylist()[:1]:
            tiles, wide = np.frombuffer(part["tiles"], "<i8"), part["wide"]
            low, high = (np.frombuffer(part[n], wide).reshape(-1, dims).astype(kind) for n in ("low", "high"))
            for b in here.to_pylist():
                q, ids, copies = _open_block(b, dims, kind, wide)
                lower, upper = _bounds(q.vectors, low, high)
                need = np.where(q.low <= q.high, q.need(), HIGHEST)
                worth = ((upper[:, :, None] >= need[:, None, :]) & (lower[:, :, None] <= q.high[:, None, :])).any(axis=2)
                worth[:, tiles == b["block"]] = False
                for t in np.flatnonzero(worth.any(axis=0)).tolist():
                    pick = np.flatnonzero(worth[:, t])
                    out.append({"tile": int(tiles[t]), **_block(b["block"], q.some(pick), ids[pick], copies[pick], wide)})
        return _table(out, "tile bigint, " + BLOCK)

    def in_tile(key, here: pa.Table, tiles: pa.Table) -> pa.Table:
        out = [_HIT_SCHEMA.empty_table()]
        for row in tiles.to_pylist()[:1] if here.num_rows else []:
            tile = _open_tile(row, dims, kind)
            for b in here.to_pylist():
                q, ids, copies = _open_block(b, dims, kind, row["wide"])
                out.append(_hits(b["block"], q, ids, copies, tile, _search(tile, q, k, same, False)[0]).cast(_HIT_SCHEMA))
        return pa.concat_tables(out)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hits in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(hits).read_all().to_batches()

    tiles = tree.tiles
    here = blocks.withColumn("tile", F.col("block"))
    home, home_path = write_table(here.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(at_home, BLOCK + ", hits binary, wide string"), "home")
    each = F.explode(_numbers(tree.n_parts))  # up to PART_TILES tiles each
    meeting = home.select("block", *_BLOCK_COLUMNS, each.alias("part"))
    a, b = _salted(meeting, tree.parts, "part", tree.n_tiles)
    pairs, pair_path = write_table(a.cogroup(b).applyInArrow(other_tiles, "tile bigint, " + BLOCK), "pairs")
    a, b = _salted(pairs, tiles, "tile", tree.n_tiles)
    hits = home.select("hits").mapInArrow(opened, HIT).unionByName(a.cogroup(b).applyInArrow(in_tile, HIT))
    best, best_path = write_table(_top(hits, k), "best")
    for path in (home_path, pair_path):
        delete_table(tiles.sparkSession, path)
    return best, [best_path]


def hard_negatives(
    df: DataFrame, anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other
    labels whose score lies between ``low`` and ``high`` per cent of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score, positive_rank.

    Scores are inner products of whole-number vectors; higher ones come first, ties by smaller id, NULL ids last. A row is
    never its own positive, but a repeated row or id is a row like others, and a repeated anchor repeats its results.
    Rows with a NULL label or vector, or a NULL component, take no part. Components are held within 2**22; missing
    coordinates of shorter vectors count as 0, so an empty vector scores 0. Negative positive scores have empty windows.
    An empty table, or one without anchors, gives an empty result. Other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    whole = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda v: v.isNull()))
    tree = build(whole, id_column, label, vector, anchor, max(positives + 1, negatives))
    dims, kind, wide = tree.dims, tree.kind, tree.wide

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tile = _open_tile(row, dims, kind)
                at = np.flatnonzero(tile["anchors"])
                if len(at):
                    whole = lambda v: np.full((len(at), 1), v, kind)
                    q = Queries(at, tile["vectors"][at], tile["labels"][at], whole(LOWEST), whole(HIGHEST), whole(LOWEST))
                    yield from _table([_block(row["tile"], q, tile["ids"][at], tile["copies"][at], row["wide"])], BLOCK).to_batches()

    blocks, block_path = write_table(tree.tiles.mapInArrow(anchors, BLOCK), "blocks")
    good, good_paths = _found(tree, blocks, positives, True)

    def windows(key, here: pa.Table, found: pa.Table) -> pa.Table:
        """A block whose windows follow from its anchors' positives; without one a window is empty."""
        out = []
        for b in here.to_pylist():
            q, ids, copies = _open_block(b, dims, kind, wide)
            q.low, q.high, q.kth = (np.full((len(q.at), positives), v, kind) for v in (HIGHEST, LOWEST, LOWEST))
            who, rank, score = np.searchsorted(q.at, found["at"].to_numpy()), found["rank"].to_numpy() - 1, found["score"].to_numpy()
            q.low[who, rank], q.high[who, rank] = -((-low * score) // 100), high * score // 100
            out.append(_block(b["block"], q, ids, copies, wide))
        return _table(out, BLOCK)

    windowed = blocks.groupBy("block").cogroup(good.groupBy("block")).applyInArrow(windows, BLOCK)
    bad, bad_paths = _found(tree, windowed, negatives, False)
    for path in [block_path, *tree.paths]:
        delete_table(spark, path)
    pair = good.select("block", "at", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = bad.select("block", "at", (F.col("window") + 1).cast("int").alias("positive_rank"), "anchor_id", "copies", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = negative.join(pair, ["block", "at", "positive_rank"]).withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
