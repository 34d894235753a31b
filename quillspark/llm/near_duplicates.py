"""MinHash near-duplicates with sequential Bayesian verification of banded candidates.

1. Each text becomes its set of distinct word shingles; texts with the same set form a class.
2. ``BANDS`` bands of ``ROWS`` MinHash values give bucket keys. A bucket of up to ``ALL_PAIRS``
   classes gives all its pairs. A larger bucket is compared with its most central class, the one
   whose buckets hold most classes in all. What is then outside the bucket's main component sends
   its own most central class to be compared with the rest, for as long as that settles many.
   What is outside even then is mostly like nothing but a hub that it misses by little. The classes
   of these buckets are joined by prefixes: with shingles ordered from rare to common, two sets that
   reach the threshold share one among the first of both, at places that leave enough behind them
   for the sizes of both. A class of edits of its own has nothing but these up there and meets no
   one, so the work follows shared rare shingles and not the product of a bucket with itself. What
   is left out is inside one component or can't reach the threshold; no candidate is given up.
3. Signatures of a candidate pair are compared in batches. After each batch the posterior of the
   similarity decides: the pair goes if the chance that it reaches the threshold is under ``MISS``.
4. Survivors are verified on the full sets. Only links matter that join different components, so
   pairs inside a component found by earlier steps are not compared.
5. Components of the verified links name each document's group by its smallest doc_id.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8**6)**40 = 5e-6.

Defined results: a text without words, null or empty, has no shingles and is linked with nothing;
a row with a null doc_id is linked with nothing and has a null component; rows that share a doc_id
are one document, so unlike texts of one doc_id join their components; an empty table gives an
empty result; a text with fewer words than the shingle width has its whole sequence as one shingle;
a very long text is held whole by one task at a time; of equally central classes the one with the
smaller doc_id is the hub, which changes no result; other columns are passed through or ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, free_name, settled, written
from .components import components

BANDS, ROWS = 40, 6
WIDTH = 5
#: The threshold as a fraction of whole numbers: similarity * 100 >= PERCENT.
PERCENT = 80
#: Signature values compared at a time, and the accepted chance of losing a pair at the threshold.
STEP, MISS = 40, 1e-6
ALL_PAIRS = 12
#: Rounds of hubs at most; they end when one leaves more than this share of what was open.
HUB_ROUNDS, SLOW = 8, 0.8
#: Ids sent to all tasks instead of a shuffle of the texts, up to this many (8 bytes each).
SENT_IDS = 1_000_000
#: Cells for counting shingles: 2**16 to 2**24, about four for each shingle, of one byte each.
BLOCK_BITS, CELL_BITS = 16, 24
#: Sizes in one grade differ by this factor at most.
GRADE = 1.03

_RNG = np.random.default_rng(11)
_MULTIPLY = (_RNG.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)) | np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, (BANDS * ROWS, 1), dtype=np.uint32)
_COLUMNS = 1024
SIGNED = "doc_id long,n_shingles long,class binary,signature binary,bands binary"


def shingle_sets(piece: tk.Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other; and where each set begins."""
    starts, ends, first = tk.spans(piece, tk.IS_SPACE)
    words = tk.span_hash(tk.prefix_hash(piece.data, tk.BYTE_VALUE_LOWER), starts, ends)
    made, at = tk.shingles(words, first, width)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(at))
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    made, owner = made[new], owner[new]
    return made, np.searchsorted(owner, np.arange(len(first)))


def signature(items: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_MULTIPLY), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), _COLUMNS):
        block = low[i : i + _COLUMNS] ^ _FLIP
        block *= _MULTIPLY
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(best, block.min(axis=1), out=best)
    return best


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    grouped = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return tk.mix((grouped * tk.ORDER_VALUE[:ROWS]).sum(axis=2, dtype=np.uint64) + tk.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)))


def signed(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: the size of its set, the set's digest, one byte of each MinHash value, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for piece in tk.slices(b.column(1)):
                sets, at = shingle_sets(piece, width)
                sizes = np.diff(at)
                own = ids.slice(piece.first, len(sizes))
                seen: dict[bytes, int] = {}
                digests: list[bytes | None] = []
                full = np.zeros((len(sizes), BANDS * ROWS), np.uint32)
                for r in range(len(sizes)):
                    if not sizes[r]:
                        digests.append(None)
                        continue
                    items = sets[at[r] : at[r + 1]]
                    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                    digests.append(digest)
                    full[r] = full[seen[digest]] if digest in seen else signature(items)
                    seen.setdefault(digest, r)
                small = full.astype(np.uint8)
                keys = _band_keys(full)
                none = np.array([d is None for d in digests]) | np.array(own.is_null())
                yield batch(SIGNED, own, sizes, digests, [None if x else s.tobytes() for x, s in zip(none, small, strict=True)], [None if x else k.tobytes() for x, k in zip(none, keys, strict=True)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, ", ".join(SIGNED.split(",")))


def least_matches(percent: int = PERCENT, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """For each number of compared values, the fewest equal ones with which a pair may still be a link.

    One byte of two different values is equal by chance once in 256. The prior is uniform.
    """
    grid = np.linspace(0, 1, 2001)
    equal = grid + (1 - grid) / 256
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-np.minimum(equal, 1 - 1e-12))
            weight = np.exp(log - log.max())
            if weight[grid >= percent / 100].sum() / weight.sum() >= miss:
                out.append((n, m))
                break
    return out


def _survivors(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs that the signatures don't rule out, with the share of equal values."""
    bounds = least_matches(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sides = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3))]
            alive = np.arange(b.num_rows)
            equal = np.zeros(b.num_rows, np.int64)
            done = 0
            for n, m in bounds:
                equal[alive] += (sides[0][alive, done:n] == sides[1][alive, done:n]).sum(axis=1)
                alive, done = alive[equal[alive] >= m], n
            yield batch("a long,b long,likely double", b.column(0).take(pa.array(alive)), b.column(1).take(pa.array(alive)), equal[alive] / done)

    left = signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, likely double")


def _needed_texts(docs: DataFrame, needed: DataFrame, count: int) -> DataFrame:
    """Compressed texts of the classes' representatives; texts are not shuffled while the ids are few."""
    spark = docs.sparkSession
    if count <= SENT_IDS:
        rows = needed.select("rep").distinct().toArrow().column(0).combine_chunks()
        sent = spark.sparkContext.broadcast(rows)
        chosen = docs
    else:
        sent = None
        chosen = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            if sent is not None:
                b = b.filter(pc.is_in(b.column(0), sent.value))
            if b.num_rows:
                texts = pc.fill_null(b.column(1), "").to_pylist()
                yield batch("rep long,packed binary", b.column(0), [press.compress(t.encode()) for t in texts])

    found = chosen.select("doc_id", "text").mapInArrow(pack, "rep long, packed binary")
    return written(found.dropDuplicates())


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                both = pa.array([unpress.decompress(x).decode() for c in (2, 3) for x in part.column(c).to_pylist()], pa.large_string())
                sets: list[np.ndarray] = []
                for piece in tk.slices(both):
                    made, at = shingle_sets(piece, width)
                    sets += [made[at[r] : at[r + 1]] for r in range(len(at) - 1)]
                n = part.num_rows
                good = []
                for x, y in zip(sets[:n], sets[n:], strict=True):
                    joint = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(bool(joint) and 100 * joint >= percent * (len(x) + len(y) - joint))
                keep = part.filter(pa.array(good, pa.bool_()))
                yield batch("a long,b long", keep.column(0), keep.column(1))

    left = texts.select(F.col("rep").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("packed").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, distinct shingles and where each set begins, for rows of an id and a compressed text."""
    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            for piece in tk.slices(pa.array([unpress.decompress(x).decode() for x in part.column(1).to_pylist()], pa.large_string())):
                made, at = shingle_sets(piece, width)
                yield part.column(0).slice(piece.first, piece.last - piece.first), made, at


def prefixes(texts: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``(rep, size, place, shingle)`` for ``texts`` (rep, packed): each set's first shingles from rare to common.

    Shingles are counted in cells by hash; the order is by the cell's count (255 at most), then the shingle. A
    prefix is as long as the smallest partner asks for; shingles that no other set can hold keep their place and
    are left out.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch("n long", [sum(len(made) for _, made, _ in _shingled(batches, width))])

    total = texts.mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(max((4 * total).bit_length(), BLOCK_BITS), CELL_BITS)
    shift, block = np.uint64(64 - bits), 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint8)
        for _, made, at in _shingled(batches, width):
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            cell = np.unique(owner << bits | (made >> shift).astype(np.int64)) & ((1 << bits) - 1)  # no set counts a cell twice
            found, n = np.unique(cell, return_counts=True)
            seen[found] = np.minimum(seen[found] + n, 255)
        press = zstandard.ZstdCompressor(level=1)
        filled = [k for k in range(len(seen) // block) if seen[k * block : (k + 1) * block].any()]
        yield batch("block int,cells binary", filled, [press.compress(seen[k * block : (k + 1) * block].tobytes()) for k in filled])

    def merge(rows: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        seen = np.zeros(block, np.int64)
        for x in rows.column("cells").to_pylist():
            seen += np.frombuffer(unpress.decompress(x), np.uint8)
        return pa.Table.from_batches([batch("block int,cells binary", rows.column("block").to_pylist()[:1], [np.minimum(seen, 255).astype(np.uint8).tobytes()])])

    counted = texts.mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, cells binary").toArrow()
    cells = np.zeros(1 << bits, np.uint8)
    for k, x in zip(counted.column("block").to_pylist(), counted.column("cells").to_pylist(), strict=True):
        cells[k * block : (k + 1) * block] = np.frombuffer(x, np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(cells)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, made, at in _shingled(batches, width):
            n = sent.value[(made >> shift).astype(np.int64)]
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            rank = np.lexsort((made, n, owner))
            place = np.arange(len(made)) - at[:-1][owner]
            keep = (place <= size[owner] * (100 - percent) // 100) & (n[rank] > 1)
            yield batch("rep long,size long,place long,shingle long", ids.take(pa.array(owner[keep])), size[owner[keep]], place[keep], made[rank][keep].view(np.int64))

    return texts.mapInArrow(order, "rep long, size long, place long, shingle long")


def _prefix_pairs(members: DataFrame, rest: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """``(a, b)``: pairs of a class in ``rest`` and one of ``members`` (rep, g) that prefixes don't rule out."""
    first = written(prefixes(texts, percent, width))
    grade = lambda size: F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(float(np.log(GRADE))))
    least = F.floor(F.col("size") * percent / 100)
    most = F.floor((F.col("size") - F.col("place")) * (100 + percent) / percent) - F.col("size")
    asking = first.join(rest, "rep").where(most >= least).select("shingle", F.col("rep").alias("other"), F.col("g").alias("other_g"), F.col("size").alias("other_size"), F.col("place").alias("other_place"), F.explode(F.sequence(grade(least), grade(most))).alias("grade"))
    offered = first.join(members, "rep").withColumn("grade", grade(F.col("size")))
    # what both may share begins here and can't be more than what is left of either
    left = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("other_size"))
    met = offered.join(asking, ["shingle", "grade"]).where((F.col("g") != F.col("other_g")) & enough)
    return met.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))


def links(docs: DataFrame, table: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Links between classes, enough to connect whatever is connected: pairs of representatives' ids.

    ``table`` is what ``signed`` gives for ``docs`` (columns doc_id and text).
    """
    whole = table.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(whole.groupBy("class").agg(F.min("doc_id").alias("rep"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands")))
    signatures = classes.select("rep", "signature")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
            yield batch("key long,rep long", keys, np.repeat(b.column(0).to_numpy(), BANDS))

    keyed = classes.select("rep", "bands").mapInArrow(unfold, "key long, rep long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, "key"))

    small = members.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("m")).select("m").distinct()
    pair = F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x AS a, y AS b))))")
    some = small.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    fame = members.groupBy("rep").agg(F.sum("n").alias("fame"))
    large = written(members.where(F.col("n") > ALL_PAIRS).join(fame, "rep").select("key", "rep", "fame", F.col("rep").alias("g")))
    first = F.struct("fame", -F.col("rep"))

    def hubs_of(rows: DataFrame) -> DataFrame:
        """The most central class of each bucket, and its component."""
        return written(rows.groupBy("key").agg(F.max_by("rep", first).alias("hub"), F.max_by("g", first).alias("hub_g")))

    groups = _shared_ids(whole, classes)
    tested: DataFrame | None = None
    compared: DataFrame | None = None
    step, before, last = 0, None, False
    while not last:
        texts = None
        if step > 0:
            named = written(_named(large.drop("g"), groups, "rep", "g"))
            main = named.groupBy("key", "g").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("g", F.struct("n", -F.col("g"))).alias("main"))
            rest = written(named.join(main, "key").where("g <> main").drop("main").join(compared, ["key", "rep"], "left_anti"))
            count = rest.count()
            if not count:
                break
            last = step > HUB_ROUNDS or (before is not None and count > SLOW * before)
            large, before = named, count
        if last:
            open_buckets = large.join(rest.select("key").distinct(), "key", "left_semi")
            there = written(open_buckets.select("rep", "g").distinct())
            texts = _needed_texts(docs, there, there.count())
            candidates = _prefix_pairs(there, rest.select("rep", "g").distinct(), texts, percent, width)
        else:
            hubs = hubs_of(large if step == 0 else rest)
            done = hubs.select("key", F.col("hub").alias("rep"))
            compared = done if compared is None else compared.unionByName(done)
            candidates = large.join(hubs, "key").where("g <> hub_g").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        candidates = (some.unionByName(candidates) if step == 0 else candidates).distinct()
        step += 1
        if tested is not None:
            candidates = candidates.join(tested, ["a", "b"], "left_anti")
        likely = written(_survivors(candidates, signatures, percent))
        tested = likely.select("a", "b") if tested is None else tested.unionByName(likely.select("a", "b"))
        if texts is None:
            needed = written(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
            texts = _needed_texts(docs, needed, needed.count())
        good = written(_verified(likely, texts, percent, width))
        if groups is None:
            groups = written(components(good))
        elif not good.isEmpty():
            # components of components: only what is new is followed
            between = _named(_named(good, groups, "a", "ga"), groups, "b", "gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
            joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
            older = groups.unionByName(between.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node", "left_anti").select("node", F.col("node").alias("component")))
            groups = written(older.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))
    if groups is None:
        return signatures.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where(F.lit(False))
    return groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _shared_ids(whole: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components of the classes whose rows share a doc_id; None if every doc_id stands for one class."""
    again = written(whole.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return None
    held = written(whole.join(again, "doc_id", "left_semi").join(classes.select("class", "rep"), "class").select("doc_id", "rep").distinct())
    first = held.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return written(components(held.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")))


def _named(rows: DataFrame, groups: DataFrame | None, node: str, name: str) -> DataFrame:
    """``rows`` with the component so far of the class in ``node``; a class that is in none is its own."""
    if groups is None:
        return rows.withColumn(name, F.col(node))
    known = groups.select(F.col("node").alias(node), F.col("component").alias("__component"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("__component", node)).drop("__component")


def report(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of ``docs``: the size of its set, its component, and whether it stays."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(signed(own, width))
    linked = settled(lambda: links(own, table, width, percent))
    classes = table.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    named = classes.join(linked.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = table.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that near-duplicate one with a smaller id; of rows with one id the first text stays."""
    found = settled(lambda: report(docs, width, percent, id_col, text_col))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    spark = docs.sparkSession
    if gone.count() <= SENT_IDS:
        sent = spark.sparkContext.broadcast(gone.toArrow().column(0).combine_chunks())
        where = docs.columns.index(id_col)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pc.invert(pc.fill_null(pc.is_in(b.column(where), pc.cast(sent.value, b.column(where).type)), False)))

        kept = docs.mapInArrow(drop, docs.schema)
    else:
        kept = docs.join(gone.select(F.col("gone").alias(free_name(docs, "gone"))), F.col(id_col).cast("long") == F.col(free_name(docs, "gone")), "left_anti")
    repeated = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    name, place = free_name(docs, "again"), free_name(docs, "place")
    again = repeated.withColumnRenamed("doc_id", name)
    same = F.col(id_col).cast("long") == F.col(name)
    first = Window.partitionBy(id_col).orderBy(text_col)
    one = kept.join(again, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return kept.join(again, same, "left_anti").unionByName(one)
