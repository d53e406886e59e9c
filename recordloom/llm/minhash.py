"""Near-duplicate documents: circulant MinHash, banding, and links confirmed on whole sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.llm.common import keyed, lists, offsets, parts, ranges, worker_memory
from recordloom.llm.windows import byte_texts, letter_values, mixed, span_hashes, words_of
from recordloom.session import stage

#: Coordinates of a signature: bands times rows. A pair at similarity 0.8 is missed once in 300,000 times.
BANDS, ROWS = 32, 5
#: Size of the universe that the two permutations are of, as a power of two.
UNIVERSE_BITS = 20
#: Shingles that get their coordinates at once.
AT_ONCE = 16_384
#: Agreeing coordinates, below which a pair at the wanted similarity lies once in 10^8 times, in standard deviations.
DEVIATIONS = 6
#: Members compared with one copy of their leader's text, and members of a block.
MEMBERS, BLOCK = 256, 1024
#: Ids that may be broadcast.
BROADCAST_IDS = 4_000_000


class Shingles:
    """The distinct shingles of a part's texts, as sorted hashes."""

    def __init__(self, part: pa.RecordBatch, words: int):
        data, bounds = byte_texts(part)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        begin, end, first = words_of(data, bounds)
        hashes = mixed(span_hashes(letter_values()[data], begin, end))
        count = np.diff(first)
        # a text with fewer words is one shingle
        starts = ranges(first[:-1], np.where(count >= words, count - words + 1, np.minimum(count, 1)))
        text = np.searchsorted(first, starts, side="right") - 1
        found = span_hashes(hashes, starts, np.minimum(starts + words, first[text + 1]))
        order = np.lexsort((found, text))
        text, found = text[order], found[order]
        new = np.concatenate([[True], (np.diff(text) != 0) | (found[1:] != found[:-1])])[: len(text)]
        self.hashes = found[new]
        self.sizes = np.bincount(text[new], minlength=part.num_rows)
        self.bounds = offsets(self.sizes)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i]: self.bounds[i + 1]]

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that tell sets apart."""
        total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x)])[self.bounds])
        return total(mixed(self.hashes)), total(mixed(self.hashes ^ np.uint64(0xA0761D6478BD642F)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one as windows of all its circular shifts."""
    memory = worker_memory()
    if "permutations" not in memory:
        dice = np.random.default_rng(2021)
        size, width = 1 << UNIVERSE_BITS, BANDS * ROWS
        first, second = dice.permutation(size), dice.permutation(size).astype(np.uint32)
        shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)
        memory["permutations"] = first, shifts
    return memory["permutations"]


def signatures(shingles: Shingles) -> np.ndarray:
    """For each text with shingles the smallest values under all shifts of the second permutation."""
    first, shifts = permutations()
    place = first[(shingles.hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full((len(shingles.sizes), shifts.shape[1]), 1 << UNIVERSE_BITS, np.uint32)
    text = np.repeat(np.arange(len(shingles.sizes)), shingles.sizes)
    for begin in range(0, len(place), AT_ONCE):
        own = text[begin: begin + AT_ONCE]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        least = np.minimum.reduceat(shifts[place[begin: begin + AT_ONCE]], edge, axis=0)
        out[own[edge]] = np.minimum(out[own[edge]], least)
    return out


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        shingles = Shingles(part, words)
        one, two = shingles.set_hashes()
        signature = signatures(shingles)
        band = np.zeros((part.num_rows, BANDS), np.uint64)
        for row in range(ROWS):
            band = mixed(band + signature[:, row::ROWS].astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
        low = signature.astype(np.uint8)
        yield pa.record_batch({
            "rid": part.column("rid"), "key": part.column("key"), "size": pa.array(shingles.sizes, pa.int64()),
            "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64)),
            "signature": pa.array([r.tobytes() for r in low], pa.binary()),
            "bands": lists(band.view(np.int64).ravel(), np.full(part.num_rows, BANDS), pa.int64()),
        })


def least_agreement(percent: int) -> int:
    """Agreeing low bytes that a pair of the wanted similarity has but for bad luck."""
    n, p = BANDS * ROWS, percent / 100
    return int(n * p - DEVIATIONS * np.sqrt(n * p * (1 - p)))


def bytes_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            agree = (bytes_matrix(batch.column("sig_a")) == bytes_matrix(batch.column("sig_b"))).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(agree >= least))


def groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows, some at a time, with the places where groups begin and the end."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.combine_chunks()
        new = np.any([np.diff(table[c].to_numpy()) != 0 for c in names], axis=0)
        return table, np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table, edge = cut(pa.Table.from_batches(held))
            if len(edge) > 2:
                yield table.slice(0, edge[-2]), edge[:-1]
                held = table.slice(edge[-2]).to_batches()
    if sum(b.num_rows for b in held):
        yield cut(pa.Table.from_batches(held))


class Block:
    """Members of a group whose pairs across components are looked at.

    ``root`` changes as components are found to belong together, so that pairs which
    would tell nothing new are left out.
    """

    def __init__(self, rows: pa.Table, signature: np.ndarray, least: int):
        self.root, self.block = rows["root"].to_numpy().copy(), rows["block"].to_numpy()
        # each pair of blocks meets once, and pairs within a block where the block meets itself
        self.whole = bool(len(rows)) and rows["low"][0].as_py() == rows["high"][0].as_py()
        self.signature, self.least = signature, least

    def likely(self, i: int) -> np.ndarray:
        """Later members of other components that are likely similar to member ``i``."""
        later = np.arange(i + 1, len(self.root))
        later = later[self.root[later] != self.root[i]]
        if not self.whole:
            later = later[self.block[later] != self.block[i]]
        return later[(self.signature[later] == self.signature[i]).sum(axis=1) >= self.least] if len(later) else later

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


def _apart(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of components that have a likely pair in a bucket, as few as hold all such components together."""
    for rows, edge in groups(batches, ["band", "low", "high"], BLOCK):
        signature, given = bytes_matrix(rows["signature"].combine_chunks()), rows["root"].to_numpy()
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            block = Block(rows.slice(lo, hi - lo), signature[lo:hi], least)
            for i in range(hi - lo):
                for j in block.likely(i):
                    if block.root[i] != block.root[j]:
                        a.append(given[lo + i])
                        b.append(given[lo + j])
                        block.join(i, j)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have enough in common."""
    place = np.minimum(np.searchsorted(one, two), max(0, len(one) - 1))
    both = int((one[place] == two).sum()) if len(one) else 0
    return 100 * both >= percent * (len(one) + len(two) - both)


def _compare(batches: Iterator[pa.RecordBatch], words: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Links between components of one cluster, confirmed on whole sets."""
    for rows, edge in groups(batches, ["cluster", "low", "high"], BLOCK):
        signature, node = bytes_matrix(rows["signature"].combine_chunks()), rows["cid"].to_numpy()
        sets: list[np.ndarray] = []
        for part in parts(rows.select(["text"]).to_batches(), "text"):
            shingles = Shingles(part, words)
            sets += [shingles.of(i).copy() for i in range(part.num_rows)]
        a, b = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            block = Block(rows.slice(lo, hi - lo), signature[lo:hi], least)
            for i in range(hi - lo):
                for j in block.likely(i):
                    if block.root[i] != block.root[j] and similar(sets[lo + i], sets[lo + j], percent):
                        a.append(node[lo + i])
                        b.append(node[lo + j])
                        block.join(i, j)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def in_blocks(members: DataFrame, group: str) -> DataFrame:
    """Rows of ``members`` dealt into blocks: each pair of blocks of a group together, sorted one after the other.

    A group of up to ``BLOCK`` members stays as it is.
    """
    counts = stage(members.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = members.join(counts, group).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    return rows.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough; a leader's row stands before its members' rows."""
    leader, own = None, np.zeros(0, np.uint64)
    for part in parts(batches, "text"):
        shingles = Shingles(part, words)
        a, b = [], []
        for i, (lead, member) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
            if member is None:
                leader, own = lead, shingles.of(i).copy()
                continue
            assert leader == lead
            if similar(own, shingles.of(i), percent):
                a.append(lead)
                b.append(member)
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``texts`` of distinct ``ids``, written down; many ids are shuffled, few are broadcast."""
    if ids.count() <= BROADCAST_IDS:  # numbers of eight bytes
        ids = F.broadcast(ids)
    return stage(texts.join(ids, "rid", "left_semi"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that hold on whole sets, written down. ``texts`` has ``rid, text``.

    Rows of a leader ``a`` are split over several tasks, each with a copy of its text.
    """
    pairs = stage(pairs, "pairs")
    texts = texts_of(texts, pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "rid"))
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b")
    members = members.join(texts.withColumnRenamed("rid", "b"), "b").select("a", "salt", "b", "text")
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    leaders = leaders.join(texts.withColumnRenamed("rid", "a"), "a").select("a", "salt", "b", "text")
    rows = leaders.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return stage(rows.mapInArrow(partial(_confirm, words=words, percent=percent), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches.

    Large and small stars by turns: each node's larger neighbours, then its smaller ones, go to
    the smallest node it knows, until nothing changes. Each turn is written down.
    """
    edges, before = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(down)
        edges, after = _written(small.where("a <> b").distinct())
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges, written down, and a digest in which their order plays no part."""
    seen = Observation()
    parts = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a")))
    edges = stage(edges.observe(seen, *[p.alias(f"d{i}") for i, p in enumerate(parts)]), "edges")
    return edges, tuple(seen.get[f"d{i}"] for i in range(len(parts)))


def near_duplicates(df: DataFrame, key: str, text: str, words: int, percent: int, row: str | None = None) -> DataFrame:
    """``key, n_shingles, component_id, representative``: documents grouped by links of similar ones.

    A text's set are its distinct shingles of ``words`` words, A-Z in lower case, words being runs
    without ASCII white space; a text with fewer words is one shingle. Two are linked if 100
    times their common shingles is at least ``percent`` times all of theirs. ``component_id`` is
    the smallest key that links reach, and one row of each component is its ``representative``:
    the one with this key, or of several the first one by its place in the files (see ``common.keyed``;
    ``row`` is a column that has such numbers already). Links are found by signatures, so one may be missed, see ``BANDS``; none is wrong.

    Equal sets count once. Buckets of bands link their members to a leader first. Components that
    are still apart, but have members in one bucket that agree in enough coordinates, form
    clusters; their members are compared across components in blocks, each text in as many
    tasks as its cluster has blocks. Every link is confirmed on whole sets.

    A null text or one without words has an empty set, is linked with nothing and represents itself.
    Repeated rows are equal sets. A null key stays, comes after all others, and is the component's
    id only where there is no other key. Other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    named = [df[key].alias("key"), df[text].alias("text")]
    rows = df.select(*named, df[row].alias("rid")) if row else keyed(df.select(*named), "rid")
    sets = stage(rows.mapInArrow(
        partial(_sets, words=words), f"rid long, key {kind}, size long, one long, two long, signature binary, bands array<long>"
    ), "sets")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "rid")
    classes = stage(
        sets.where("size > 0").groupBy("one", "two").agg(
            F.min(order).alias("head"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")
        ).withColumn("cid", F.col("head.rid")), "classes")

    banded = classes.select("cid", F.explode("bands").alias("band"))
    leaders = stage(banded.groupBy("band").agg(F.min("cid").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    members = stage(banded.join(leaders, "band").select("band", "cid", "leader"), "members")
    least = least_agreement(percent)
    signature = classes.select("cid", "signature")
    stars = members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stars.join(signature.toDF("a", "sig_a"), "a").join(signature.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    likely = stars.mapInArrow(partial(_likely, least=least), "a long, b long")
    texts = rows.select("rid", "text")
    links = confirmed(likely, texts, words, percent)

    joined = stage(components(links), "components")
    rooted = signature.join(joined, signature["cid"] == joined["node"], "left").select("cid", "signature", F.coalesce("root", "cid").alias("root"))
    members = members.select("band", "cid").join(rooted.select("cid", "root"), "cid")
    several = stage(members.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band"), "several")
    buckets = in_blocks(members.join(several, "band").join(signature, "cid"), "band")
    # components with likely pairs across them form clusters, whose members are compared where they meet
    clusters = stage(components(buckets.mapInArrow(partial(_apart, least=least), "a long, b long")), "clusters")
    together = rooted.join(clusters.toDF("root", "cluster"), "root")
    found = texts_of(texts, together.select(F.col("cid").alias("rid"))).withColumnRenamed("rid", "cid")
    together = in_blocks(together.join(found, "cid"), "cluster")
    links = links.union(together.mapInArrow(partial(_compare, words=words, percent=percent, least=least), "a long, b long"))

    joined = stage(components(links), "components")
    rooted = classes.join(joined, classes["cid"] == joined["node"], "left").select("one", "two", "head", F.coalesce("root", "cid").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("head").alias("least"))
    found = stage(rooted.join(heads, "root").select("one", "two", "least"), "found")
    # an empty set finds no class
    out = sets.drop("signature", "bands").join(found, ["one", "two"], "left").withColumn("own", F.isnull("least"))
    return out.select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("own"), F.col("key")).otherwise(F.col("least.key")).alias("component_id"),
        (F.col("own") | (F.col("least.rid") == F.col("rid"))).alias("representative"),
    )
