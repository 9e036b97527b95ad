"""Near duplicates by order MinHash and banded alignment.

The k-mers of a text are its five-word shingles, each labelled with its number of occurrence, so that repetitions count.
For each of TABLES hash orders the two smallest k-mers are kept in the order of the text; texts that agree in one such
pair share a bucket. Sharing it gets likelier with the edit similarity of the texts, as both what occurs and in which
order matters. Candidates are verified by aligning their k-mer sequences inside a band that holds every alignment of the
required similarity, and verified pairs are joined to classes.

In a first round each bucket compares its members with one pivot, which joins most copies. Where a bucket still holds
members of several classes, every pair of theirs that could reach the similarity is tested or found to be in one class:
such a pair shares a k-mer of the prefixes of both texts, in an order of all k-mers that puts those of a single class first
and then rare before common ones. The members that share such a k-mer form a group, and each group is compared with growing
sets of new pivots until all its members have been pivots or are of one class. Pairs of one class are not tested, nor pairs
whose places in the prefixes leave too few k-mers behind; the most typical texts are pivots first, so that a text and its
copies join at once. New links are merged into the classes on the graph of the classes that they join.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hazardframe.llm import textblocks as tb
from hazardframe.llm.storage import delete_table, write_table

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 16
ONE_TASK = 100_000  # links
PIVOTS = 2  # of a group in the first round of groups
MORE_PIVOTS = 8  # growth of that number from round to round


def labelled_kmers(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers of the texts in a row, and where each text's begin. A text of fewer than k words has
    one k-mer made of all of them."""
    data, offsets = tb.text_bytes(column)
    starts, ends, first = tb.word_bounds(data, offsets)
    counts = np.diff(first)
    if len(starts):
        words = tb.word_hashes(data, starts, ends)
    else:
        words = np.zeros(0, np.uint64)
    sizes = np.maximum(counts - k + 1, 1)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint64)
    long = counts >= k
    text_of = np.repeat(np.arange(len(counts)), sizes)
    if long.any():
        at = np.repeat(first[:-1], sizes) + tb.segment_arange(sizes)
        inside = long[text_of]
        out[inside] = tb.grams(words, k)[at[inside]]
    for i in np.flatnonzero(~long):
        w = words[first[i] : first[i + 1]]
        out[begin[i]] = tb.grams(w, len(w))[0] if len(w) else np.uint64(0)
    # Number the occurrences of equal k-mers of a text in the order of the text.
    key = out ^ tb.mixed(text_of.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        nth = np.empty(len(order), np.uint64)
        nth[order] = run.astype(np.uint64)
        out = np.where(nth > 0, tb.mixed(out + nth * np.uint64(0xA24BAED4963EE407)), out)
    return out, begin


def order_sketch(kmers: np.ndarray, begin: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Texts x tables: hash of the two smallest k-mers of each hash order, in the order of the text."""
    n = len(begin) - 1
    sizes = np.diff(begin)
    heads = begin[:-1]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((n, tables), np.uint64)
    for t in range(tables):
        rank = tb.mixed(kmers ^ np.uint64(pow(tb.BASE, 7 * t + 5, 1 << 64)))
        one = np.minimum.reduceat(rank, heads)
        at_one = np.flatnonzero(rank == np.repeat(one, sizes))
        text = np.searchsorted(begin, at_one, "right") - 1
        first_at = np.empty(n, np.int64)
        first_at[text[::-1]] = at_one[::-1]
        rank[first_at] = top
        two = np.minimum.reduceat(rank, heads)
        at_two = np.flatnonzero(rank == np.repeat(two, sizes))
        text = np.searchsorted(begin, at_two, "right") - 1
        second_at = np.empty(n, np.int64)
        second_at[text[::-1]] = at_two[::-1]
        forward = first_at <= second_at
        a, b = np.where(forward, one, two), np.where(forward, two, one)
        out[:, t] = tb.mixed(a * np.uint64(3) + tb.mixed(b + np.uint64(t + 1)))
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """k-mers on the best order-keeping alignment over all k-mers of both, or 0.0 if it cannot reach ``similarity``.

    With s the similarity, at least s / (1 + s) of all k-mers are matched, so at most (1 - s) / (1 + s) of them are not,
    and no match of a good alignment is further off the diagonal than that. Labelled k-mers are distinct within a text,
    so the alignment is the longest increasing run of matched positions.
    """
    total = len(a) + len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return 0.0
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    j = order[at]
    hit = b[j] == a
    i, j = np.flatnonzero(hit), j[hit]
    band = (1 - similarity) / (1 + similarity) * total + 1
    near = np.abs(i - j) <= band
    j = j[near]
    need = similarity / (1 + similarity) * total
    if len(j) < need - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        length = len(j)
    else:
        tails: list[int] = []
        for v in j.tolist():
            k = bisect_left(tails, v)
            tails[k : k + 1] = [v]
        length = len(tails)
    found = length / (total - length)
    return found if found >= similarity - 1e-12 else 0.0


def _sketches(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(2), 2 << 20):
                kmers, begin = labelled_kmers(batch.column(2).slice(lo, hi - lo))
                sketch = order_sketch(kmers, begin).view(np.int64)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, TABLES, dtype=np.int32)), pa.array(sketch.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), values], names=["id", "key", "sketch"])

    return rows.mapInArrow(run, "id bigint, key string, sketch array<bigint>")


def _kmer_table(texts: DataFrame) -> DataFrame:
    """node and the text's labelled k-mers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                kmers, begin = labelled_kmers(batch.column(1).slice(lo, hi - lo))
                values = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(kmers.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], names=["node", "kmers"])

    return texts.mapInArrow(run, "node bigint, kmers array<bigint>")


def _verify(pairs: DataFrame, kmers: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xs, ys = x.values.to_numpy(), y.values.to_numpy()
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            ok = [aligned_similarity(xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]], similarity) > 0 for i in range(len(x))]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = kmers.select(F.col("node").alias("a"), F.col("kmers").alias("x"))
    right = kmers.select(F.col("node").alias("b"), F.col("kmers").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _smallest_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of a whole graph of at most ONE_TASK links: links hook the larger of two roots to the smaller one, and
    nodes follow their roots, until every link lies below one root."""
    held = list(batches)
    if not held:
        return
    links = pa.Table.from_batches(held)
    ends = [links.column(i).to_numpy() for i in (0, 1)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    u, v = at[: links.num_rows], at[links.num_rows :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        for end in (u, v):
            np.minimum.at(root, root[end], low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of ``links`` (a, b), by alternating large-star and
    small-star steps; every step is a grouped minimum and a join, so a node with very many links is pre-aggregated. As soon
    as at most ONE_TASK links are left, one task finishes them; the result is the same."""
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, path = write_table(edges, "edges")

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    while before[0] > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        following, new_path = write_table(small, "edges")
        delete_table(spark, path)
        edges, path = following, new_path
        now = mark(edges)
        if now == before:
            break
        before = now
    if before[0] <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_smallest_linked, "node bigint, root bigint")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further ``links``: only the classes that these join are worked on again, as nodes of a smaller graph."""
    if roots is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias("r_" + end)), end, "left").withColumn("r_" + end, F.coalesce("r_" + end, end))
    joined = components(ends.select(F.col("r_a").alias("a"), F.col("r_b").alias("b")))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(joined.join(roots, "node", "left_anti"))


def _prefixes(open_kmers: DataFrame, similarity: float) -> DataFrame:
    """token, node, n (k-mers of the text), at (place of the token among them), o (less for a more typical text): the k-mers
    of each text's prefix that occur in several classes.

    Texts of similarity s share at least s of the k-mers of either. Whatever order of all k-mers is used, they then share
    one of the first n - ceil(s n) + 1 of both texts. Here k-mers that occur in one class only come first: they can meet
    no text of another class and give no row. The others follow from rare to common. Counts are exact, and rows grow with
    the k-mers that classes share.
    """
    tokens = open_kmers.select("node", "c", F.size("kmers").alias("n"), F.explode("kmers").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count(F.lit(1)).alias("texts")).where("c1 <> c2").select("token", "texts")
    met = tokens.select("node", "n", "token").join(shared, "token")
    by_text = Window.partitionBy("node")
    met = met.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(by_text)).withColumn("o", -F.avg(F.log("texts")).over(by_text))
    met = met.withColumn("at", F.col("alone") + F.row_number().over(by_text.orderBy("texts", "token")) - 1)
    return met.where(F.col("at") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9)).select("token", "node", "n", "at", "o")


def _with_class(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("c", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")


def _undecided(rows: DataFrame, group: str) -> DataFrame:
    """The rows of the groups with members of several classes."""
    several = rows.groupBy(group).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select(group)
    return rows.join(several, group)


def _left_to_meet(group: DataFrame, similarity: float) -> DataFrame:
    """The rows of the tokens with members of several classes from which on a text holds enough k-mers for a partner as short
    as the shortest of its group."""
    several = group.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("n").alias("least")).where("c1 <> c2").select("token", "least")
    need = F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("least")) - 1e-9
    return group.join(several, "token").where(F.col("n") - F.col("at") >= need).drop("least")


def near_duplicate_classes(documents: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, key (digest of the text), root (the class's smallest digest) and class_id, one row per row of ``documents``.
    The class id is the smallest id of the class; a text without a near duplicate is a class of its own, equal texts
    share one.

    NULL counts as the empty text; all texts without a word form one class. A NULL id is kept and is a class id only
    where a class has no other. Rows with equal ids are classed by their texts. An empty table gives an empty table; only
    the named columns are read.
    """
    spark: SparkSession = documents.sparkSession
    paths = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = write_table(df, name)
        paths.append(path)
        return table

    text_column = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.md5(text_column.cast("binary")).alias("key"), text_column.alias("text"))
    sketches = kept(_sketches(rows), "sketches")

    # Equal texts are one node from here on; nodes are numbered, and the written table fixes the numbers.
    distinct = sketches.groupBy("key").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    nodes = kept(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    slots = nodes.select("node", F.posexplode("sketch").alias("slot", "value")).select("node", F.xxhash64("slot", "value").alias("bucket"))
    # The pivot of a bucket is its smallest node: a group of copies that shares many buckets gives few pairs for each copy.
    pivots = slots.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last")
    members = kept(slots.join(pivots, "bucket"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key", F.xxhash64("id").alias("tag"))
    # Which of the rows of a text supplies it does not matter: one with its smallest id.
    texts = rows.withColumn("tag", F.xxhash64("id")).join(wanted, ["key", "tag"]).dropDuplicates(["key", "tag"])
    kmers = kept(_kmer_table(texts.select("node", "text")), "kmers")

    roots, tried = None, []

    def test(pairs: DataFrame) -> None:
        nonlocal roots
        if tried:
            pairs = pairs.join(spark.read.schema("a bigint, b bigint").parquet(*tried), ["a", "b"], "left_anti")
        pairs = kept(pairs, "pairs")
        tried.append(paths[-1])
        if pairs.isEmpty():
            return
        verified = kept(_verify(pairs, kmers, similarity), "links")
        if not verified.isEmpty():
            roots = kept(_merged(roots, verified), "roots")

    test(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    open_nodes = _undecided(_with_class(members.select("bucket", "node"), roots), "bucket").select("node", "c").distinct()
    group, shares = kept(_prefixes(kmers.join(open_nodes, "node"), similarity), "prefixes"), PIVOTS
    while True:
        group = kept(_left_to_meet(_with_class(group.drop("c"), roots), similarity), "groups")
        if group.isEmpty():
            break
        # One pivot for each share of the group: minima again, whatever the size of the group.
        share = F.pmod(F.xxhash64("node"), F.lit(shares)).alias("share")
        chosen = group.groupBy("token", share).agg(F.min(F.struct("o", "node", "n", "at", "c")).alias("p"))
        chosen = kept(chosen.select("token", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.at").alias("to"), F.col("p.c").alias("d")), "pivots")
        # At the first k-mer that two texts share, what follows in the common order must hold all the others they need.
        left_over = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))
        enough = left_over >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("m")) - 1e-9
        met = group.join(chosen, "token").where((F.col("c") != F.col("d")) & enough)
        test(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        group = group.join(chosen.select("token", F.col("other").alias("node")), ["token", "node"], "left_anti")
        shares *= MORE_PIVOTS
    if roots is None:
        roots = spark.createDataFrame([], "node bigint, root bigint")
    numbered = _with_class(nodes.select("node", "key", "id"), roots)
    classes = numbered.groupBy("c").agg(F.min("id").alias("class_id"), F.min("key").alias("root"))
    of_text = numbered.join(classes, "c").select("key", "root", "class_id")
    out, _ = write_table(sketches.select("id", "key").join(of_text, "key").select("id", "key", "root", "class_id"), "classes")
    for path in paths:
        delete_table(spark, path)
    return out


def drop_near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` with the smallest id of their class, all columns as they are. Of rows equal in id and
    text one stays; where a class has no id at all, one row of it stays."""
    classes = near_duplicate_classes(documents, id_column, text, similarity)
    kept = classes.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("root", "key", "class_id").agg(F.count(F.lit(1)).alias("n"))
    # Several rows of a class may carry its smallest id: the smallest text digest decides.
    chosen = kept.groupBy("root").agg(F.min(F.struct("key", "class_id", "n")).alias("c"))
    chosen = chosen.select(F.col("c.class_id").alias("class_id"), F.col("c.key").alias("key"), F.col("c.n").alias("n"))
    # The row travels as one struct, so that no name of its columns can clash.
    carried = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(id_column).cast("long").alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest")
    )
    found = carried.join(chosen, (F.col("digest") == F.col("key")) & F.col("id").eqNullSafe(F.col("class_id")))
    single, repeated = found.where("n = 1"), found.where("n > 1").dropDuplicates(["digest", "id"])
    return single.select("row").unionByName(repeated.select("row")).select("row.*")
