"""Removal of repeated byte strings by a sampled suffix ordering over the whole corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.

The dealt difference-cover algorithm is followed in its steps but not in its order. A
cover by residues (9 of 64) names 0.14 positions for each byte, and merging the others
takes a row for each byte: over ten times the input on disk. So the cover here is
chosen by content: the sample of a string of ``LENGTH`` bytes is its first gram of
smallest hash, so every string has one, and equal strings have it at the same place,
which is what a cover modulo v gives for pairs of positions, at a fifth of its samples.
Names are hashes instead of ranks, and equal names meet in buckets instead of next to
each other in one sorted order; nothing here needs to know which string is smaller.

1. Strings that follow one another and share their sample form a run. A run's triple is
   what stands before the sample, the sample, and what stands behind; its name a hash of
   all three. Runs with the same name are ordered by position: all but the first are
   removed as a whole, and only the first goes on.
2. Among the first runs, a sample with one name is settled. The others go on: their
   strings are named one by one and merged into one order; of neighbours with the same
   name all but the first are removed.
3. What is removed in a document is merged into spans.

Names are hashes of 96 bits and are not compared byte by byte: over 100 TB, some 3e12
runs, the chance that any two of them are mistaken for each other is about 1e-4. Rows are packed
by bucket and compressed; there are as many buckets as the text's size asks for, so a
bucket does not grow. A name that recurs in a task is sent on once, so a passage that a
third of all documents share does not meet in one task. A sample with very many names,
such as white space between ever other words, is found in a sample of the documents
beforehand; its runs are dealt by name and all taken for open. Open runs and spans are
sent to the texts while they are small; see ``_texts_of`` for the way beyond that.

Defined results: a null text is empty; fully repeated rows are one document, and each
has its result; rows that share a doc_id with different texts are ordered by a hash of
the text; a null doc_id comes after all others; texts under ``LENGTH`` bytes keep all
bytes but count for nothing; a text of up to 2**31 bytes is held whole by one task;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, settled, written

LENGTH = 100
GRAM = 32
#: Bytes of text for each bucket; a bucket of open strings or runs is unpacked whole by one task.
BUCKET_BYTES = 64_000_000
#: Documents looked at to find frequent samples, in bytes of text, and the share of a bucket's runs that makes one frequent.
HOT_BYTES, HOT_SHARE = 2_000_000_000, 0.1
BLOOM_BITS = 23
#: Runs or strings that a task gathers before it sends them on.
GATHERED = 100_000
#: Names that a task remembers; it then starts anew, which only lets some repeats travel.
REMEMBERED = 400_000
#: Open runs or spans sent to all tasks, in bytes; beyond this the texts are shuffled instead.
SENT_BYTES = 32_000_000
NO_ID = 2**63 - 1

_VALUE_2 = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_SLICE = 1 << 18
_PLACE = np.uint64((1 << 31) - 1)
_RUN = [("h1", "<u8"), ("h2", "<u4"), ("gram", "<u8"), ("doc", "<i8"), ("dig", "<i8"), ("start", "<i4"), ("n", "<u2")]
_STRING = [("h1", "<u8"), ("h2", "<u4"), ("doc", "<i8"), ("dig", "<i8"), ("start", "<i4")]
_FOUND = [("doc", "<i8"), ("dig", "<i8"), ("start", "<i4"), ("n", "<i4"), ("open", "<u1")]
_PACKED = "bucket int,n long,blob binary"
_SPANS = "doc long,dig long,spans binary,open binary"
Columns = dict[str, np.ndarray]


def _pack(columns: Columns, layout: list[tuple[str, str]], bucket: np.ndarray) -> pa.RecordBatch:
    """A compressed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(edges[1:], len(order))
    press = zstandard.ZstdCompressor(level=1)
    ordered = [columns[name].astype(kind)[order] for name, kind in layout]
    blobs = [press.compress(b"".join(c[a:z].tobytes() for c in ordered)) for a, z in zip(edges, ends, strict=True)]
    return batch(_PACKED, bucket[order][edges], ends - edges, blobs)


def _unpack(rows: pa.Table, layout: list[tuple[str, str]]) -> Columns:
    unpress = zstandard.ZstdDecompressor()
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in layout}
    for n, blob in zip(rows.column("n").to_pylist(), rows.column("blob").to_pylist(), strict=True):
        raw, at = unpress.decompress(blob), 0
        for name, kind in layout:
            size = n * np.dtype(kind).itemsize
            parts[name].append(np.frombuffer(raw[at : at + size], kind))
            at += size
    return {name: np.concatenate(x) for name, x in parts.items()}


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _keys(b: pa.RecordBatch, piece: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Id and text digest of each document of a slice."""
    ids = b.column(0).slice(piece.first, piece.last - piece.first).fill_null(NO_ID).to_numpy()
    raw = piece.data.tobytes()
    return ids, np.array([_digest(raw[a:z]) for a, z in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)], np.int64)


def runs(piece: tk.Slice, length: int = LENGTH) -> Columns:
    """The runs of a slice: row, start in the slice, number of strings, hashes of triple and sample."""
    data, offs = piece.data, piece.offsets
    gram = min(GRAM, length // 3)
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return {"row": empty, "start": empty, "n": empty, "gram": empty.astype(np.uint64), "h1": empty.astype(np.uint64), "h2": empty}
    first, second = tk.prefix_hash(data), tk.prefix_hash(data, _VALUE_2)
    places = np.arange(len(data) - gram + 1)
    hashes = tk.span_hash(first, places, places + gram)
    key = (hashes & ~_PLACE) | places.astype(np.uint64)
    width = length - gram + 1
    pad = np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([key, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    sample = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
    ends = np.repeat(offs[1:], np.diff(offs))[:n]
    at = np.flatnonzero(ends - np.arange(n) >= length)
    if not len(at):
        return {"row": empty, "start": empty, "n": empty, "gram": empty.astype(np.uint64), "h1": empty.astype(np.uint64), "h2": empty}
    own = sample[at]
    new = np.flatnonzero(np.diff(own, prepend=-1) | (np.diff(at, prepend=-2) != 1))
    start, last = at[new], at[np.append(new[1:], len(at)) - 1]
    inner = (own[new] - start).astype(np.uint64) * tk.ORDER_VALUE[7]
    h1 = tk.mix(tk.span_hash(first, start, last + length) + inner)
    h2 = tk.mix(tk.span_hash(second, start, last + length) + inner) >> np.uint64(32)
    row = np.searchsorted(offs, start, side="right") - 1
    return {"row": row, "start": start, "n": last - start + 1, "gram": hashes[own[new]], "h1": h1, "h2": h2}


class _Seen:
    """Which names a task has already sent on, and for which position."""

    def __init__(self):
        self.name, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at = [np.zeros(0, np.int64) for _ in range(3)]

    def later(self, c: Columns) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have a name that stands at an earlier position in this task; and which stand here already."""
        h2 = c["h2"].astype(np.int64)
        name = c["h1"] ^ tk.mix(h2.astype(np.uint64))
        order = np.lexsort((c["start"], c["dig"], c["doc"], name))
        repeat, again = np.zeros(len(name), bool), np.zeros(len(name), bool)
        same = np.concatenate([[False], (name[order][1:] == name[order][:-1]) & (h2[order][1:] == h2[order][:-1])])[: len(order)]
        twin = same & _as_before(c, order)
        repeat[order] = same & ~twin
        again[order] = twin
        head = order[~same]
        if len(self.name) and len(head):
            spot = np.minimum(np.searchsorted(self.name, name[head]), len(self.name) - 1)
            known = (self.name[spot] == name[head]) & (self.h2[spot] == h2[head])
            less = np.zeros(len(head), bool)
            equal = np.ones(len(head), bool)
            for old, k in zip(self.at, ("doc", "dig", "start"), strict=True):
                less |= equal & (old[spot] < c[k][head])
                equal &= old[spot] == c[k][head]
            repeat[head[known & less]] = True
            again[head[known & equal]] = True
        fresh = np.flatnonzero(~repeat & ~again)
        if len(self.name) > REMEMBERED:
            self.__init__()
        if len(fresh):
            names, second = np.concatenate([self.name, name[fresh]]), np.concatenate([self.h2, h2[fresh]])
            at = [np.concatenate([old, c[k][fresh].astype(np.int64)]) for old, k in zip(self.at, ("doc", "dig", "start"), strict=True)]
            order = np.lexsort((*at[::-1], names))
            one = order[np.concatenate([[True], np.diff(names[order]) != 0])]
            self.name, self.h2, self.at = names[one], second[one], [x[one] for x in at]
        return repeat, again


def _as_before(c: Columns, order: np.ndarray) -> np.ndarray:
    """In an order of rows: is the position that of the row before?"""
    out = np.ones(len(order), bool)
    for k in ("doc", "dig", "start"):
        out[1:] &= c[k][order][1:] == c[k][order][:-1]
    out[:1] = False
    return out


def _buckets(df: DataFrame, size: int) -> int:
    """As many as there are shuffle partitions, or as ``size`` bytes of text ask for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def _hot_samples(own: DataFrame, size: int, length: int) -> np.ndarray:
    """Hashes of samples with so many names that they would fill a bucket, from a bounded part of the documents.

    Which samples are listed changes only where their runs are looked at, never what is removed.
    """
    every = max(1, size // HOT_BYTES)
    some = own.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(every)) == 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, name = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def often() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.unique(np.stack([gram, name], axis=1), axis=0)
            found, n = np.unique(pairs[:, 0], return_counts=True)
            return found[n > 8], n[n > 8]

        for b in batches:
            for piece in tk.slices(b.column(0), _SLICE):
                c = runs(piece, length)
                gram, name = np.concatenate([gram, c["gram"]]), np.concatenate([name, c["h1"]])
                if len(gram) > 4 * GATHERED:
                    found, n = often()
                    yield batch("gram long,n long", found.view(np.int64), n)
                    gram, name = gram[:0], name[:0]
        found, n = often()
        yield batch("gram long,n long", found.view(np.int64), n)

    most = HOT_SHARE * BUCKET_BYTES / length / every
    return some.select("text").mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > most).toArrow().column(0).to_numpy().view(np.uint64)


def _by_document(doc: np.ndarray, dig: np.ndarray, buckets: int) -> np.ndarray:
    return (_joint_key(doc, dig) % np.uint64(buckets)).astype(np.int32)


def _sent(gathered: list[Columns], layout: list, seen: _Seen, buckets: int, of: str, hot: np.ndarray | None = None) -> Iterator[tuple[str, pa.RecordBatch]]:
    """What a task has gathered: rows that go on, and rows that are found to be later repeats at once."""
    c = {k: np.concatenate([g[k] for g in gathered]) for k in gathered[0]}
    later, again = seen.later(c)
    if later.any():
        doc, dig = c["doc"][later], c["dig"][later]
        found = {"doc": doc, "dig": dig, "start": c["start"][later], "n": c["n"][later], "open": np.zeros(len(doc))}
        yield "found", _pack(found, _FOUND, _by_document(doc, dig, buckets))
    new = ~later & ~again
    if new.any():
        go = {k: v[new] for k, v in c.items()}
        key = go[of].astype(np.uint64)
        if hot is not None and len(hot):
            key = np.where(np.isin(key, hot), go["h1"].astype(np.uint64), key)
        yield "on", _pack(go, layout, (key % np.uint64(buckets)).astype(np.int32))


_SENT = "found boolean, bucket int, n long, blob binary"


def _marked(kind: str, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind == "found"] * b.num_rows, pa.bool_()), *b.columns], names=["found", *b.schema.names])


def _first_runs(docs: DataFrame, buckets: int, length: int, hot: np.ndarray) -> DataFrame:
    """Packed runs of all documents (found: later repeats within a task)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gathered, size = _Seen(), [], 0
        for b in batches:
            for piece in tk.slices(b.column(1), _SLICE):
                c = runs(piece, length)
                if not len(c["row"]):
                    continue
                ids, digs = _keys(b, piece)
                row = c.pop("row")
                gathered.append(c | {"doc": ids[row], "dig": digs[row], "start": c["start"] - piece.offsets[row]})
                size += len(row)
                if size >= GATHERED:
                    for x in _sent(gathered, _RUN, seen, buckets, "gram", hot):
                        yield _marked(*x)
                    gathered, size = [], 0
        if gathered:
            for x in _sent(gathered, _RUN, seen, buckets, "gram", hot):
                yield _marked(*x)

    return docs.mapInArrow(scan, _SENT)


def _firsts(c: Columns) -> tuple[np.ndarray, np.ndarray]:
    """The order by name and position, each position once, and which rows in it are the first of their name."""
    order = np.lexsort((c["start"], c["dig"], c["doc"], c["h2"], c["h1"]))
    h1, h2 = c["h1"][order], c["h2"][order]
    head = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    once = head | ~_as_before(c, order)
    return order[once], head[once]


def _settle_runs(packed: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Later repeats, and first runs whose sample has several names (open)."""

    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py():
            return rows.select(["bucket", "n", "blob"])
        c = _unpack(rows, _RUN)
        order, head = _firsts(c)
        _, which, names = np.unique(c["gram"][order[head]], return_inverse=True, return_counts=True)
        flag, repeat = np.zeros(len(c["h1"]), bool), np.zeros(len(c["h1"]), bool)
        flag[order[head]] = (names[which] > 1) | np.isin(c["gram"][order[head]], hot)
        repeat[order[~head]] = True
        go = repeat | flag
        found = {k: c[k][go] for k in ("doc", "dig", "start", "n")} | {"open": flag[go]}
        return pa.Table.from_batches([_pack(found, _FOUND, _by_document(found["doc"], found["dig"], buckets))] if go.any() else [], schema=_packed_schema())

    return packed.groupBy("found", "bucket").applyInArrow(settle, "bucket int, n long, blob binary")


def _settle_strings(packed: DataFrame, buckets: int) -> DataFrame:
    """Strings whose name stands earlier."""

    def settle(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py():
            return rows.select(["bucket", "n", "blob"])
        c = _unpack(rows, _STRING)
        order, head = _firsts(c)
        go = order[~head]
        found = {k: c[k][go] for k in ("doc", "dig", "start")} | {"n": np.ones(len(go)), "open": np.zeros(len(go))}
        return pa.Table.from_batches([_pack(found, _FOUND, _by_document(found["doc"], found["dig"], buckets))] if len(go) else [], schema=_packed_schema())

    return packed.groupBy("found", "bucket").applyInArrow(settle, "bucket int, n long, blob binary")


def _packed_schema() -> pa.Schema:
    return batch(_PACKED, [], [], []).schema


def _merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted spans joined where they touch: starts and ends in turn."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return np.stack([s[new], e[np.append(np.flatnonzero(new)[1:], len(s)) - 1]], axis=1).astype("<i4").ravel()


def _per_document(found: DataFrame, length: int) -> DataFrame:
    """A row for each document: its spans so far, and its open runs as pairs of start and number."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = _unpack(rows, _FOUND)
        order = np.lexsort((c["start"], c["dig"], c["doc"]))
        c = {k: v[order] for k, v in c.items()}
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(c["doc"]) != 0) | (np.diff(c["dig"]) != 0)]))
        out: list[tuple] = []
        for a, z in zip(edge, np.append(edge[1:], len(order)), strict=True):
            start, n, is_open = c["start"][a:z].astype(np.int64), c["n"][a:z].astype(np.int64), c["open"][a:z] > 0
            gone = ~is_open
            spans = _merged(start[gone], start[gone] + n[gone] - 1 + length).tobytes() if gone.any() else None
            todo = np.stack([start[is_open], n[is_open]], axis=1).astype("<i4").tobytes() if is_open.any() else None
            out.append((int(c["doc"][a]), int(c["dig"][a]), spans, todo))
        return pa.Table.from_batches([batch(_SPANS, *zip(*out, strict=True))])

    return found.groupBy("bucket").applyInArrow(merge, ", ".join(_SPANS.split(",")))


def _texts_of(docs: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """``(doc, dig, text, what)``: ``rows`` (doc, dig, and a binary column) with their texts.

    Up to ``SENT_BYTES`` of rows go to the texts. Beyond that the texts go to the rows: compressed, and
    without documents that a Bloom filter of fixed size rules out (if it is full, all are shuffled).
    """
    rows = rows.select("doc", "dig", F.col(what).alias("what"))
    size = rows.agg(F.sum(F.octet_length("what") + 24)).first()[0] or 0
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = "doc long,dig long,text string,what binary"
    if size <= SENT_BYTES:
        few = rows.toArrow().combine_chunks()
        key = _joint_key(few.column("doc").to_numpy(), few.column("dig").to_numpy())
        order = np.argsort(key)
        sent = docs.sparkSession.sparkContext.broadcast((key[order], pa.array(few.column("what").to_pylist(), pa.binary()).take(pa.array(order))))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, blobs = sent.value
            for b in batches:
                for piece in tk.slices(b.column(1), _SLICE):
                    ids, digs = _keys(b, piece)
                    mine = _joint_key(ids, digs)
                    at = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
                    hit = np.flatnonzero(known[at] == mine) if len(known) else np.zeros(0, np.int64)
                    if len(hit):
                        yield batch(fields, ids[hit], digs[hit], b.column(1).take(pa.array(hit + piece.first)), blobs.take(pa.array(at[hit])))

        return own.mapInArrow(look_up, ", ".join(fields.split(",")))
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << BLOOM_BITS))
    words = rows.select(bit.alias("bit")).selectExpr("CAST(bit DIV 32 AS INT) AS w", "shiftleft(1L, CAST(bit % 32 AS INT)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bloom = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    bloom[words.column("w").to_numpy()] = words.column("m").to_numpy().astype(np.uint32)
    filled = docs.sparkSession.sparkContext.broadcast(bloom)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((filled.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0))
            for piece in tk.slices(b.column(1), _SLICE):
                ids, digs = _keys(b, piece)
                raw = piece.data.tobytes()
                yield batch("doc long,dig long,packed binary", ids, digs, [press.compress(raw[a:z]) for a, z in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield batch(fields, part.column(0), part.column(1), [unpress.decompress(x).decode() for x in part.column(2).to_pylist()], part.column(3))

    spread = own.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID))).select("doc_id", "text", bit.alias("bit"))
    packed = spread.mapInArrow(choose, "doc long, dig long, packed binary")
    return packed.join(rows, ["doc", "dig"]).select("doc", "dig", "packed", "what").mapInArrow(restore, ", ".join(fields.split(",")))


def _joint_key(doc: np.ndarray, dig: np.ndarray) -> np.ndarray:
    return tk.mix(doc.astype(np.uint64) + tk.mix(dig.astype(np.uint64)))


def _open_strings(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Packed strings of the open runs (found: later repeats within a task)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, gathered, size = _Seen(), [], 0
        for b in batches:
            todo = b.column(3).to_pylist()
            for piece in tk.slices(b.column(2), _SLICE):
                pairs = [np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64) for x in todo[piece.first : piece.last]]
                row = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
                both = np.concatenate(pairs)
                n = both[:, 1]
                at = np.concatenate([[0], np.cumsum(n)])
                start = np.repeat(both[:, 0] - at[:-1], n) + np.arange(at[-1])
                row = np.repeat(row, n)
                here = start + piece.offsets[row]
                h1 = tk.span_hash(tk.prefix_hash(piece.data), here, here + length)
                h2 = tk.span_hash(tk.prefix_hash(piece.data, _VALUE_2), here, here + length) >> np.uint64(32)
                part = b.slice(piece.first, len(pairs))
                gathered.append({"h1": h1, "h2": h2, "doc": part.column(0).to_numpy()[row], "dig": part.column(1).to_numpy()[row], "start": start, "n": np.ones(len(row), np.int64)})
                size += len(row)
                if size >= GATHERED:
                    for x in _sent(gathered, _STRING, seen, buckets, "h1"):
                        yield _marked(*x)
                    gathered, size = [], 0
        if gathered:
            for x in _sent(gathered, _STRING, seen, buckets, "h1"):
                yield _marked(*x)

    return texts.mapInArrow(scan, _SENT)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, dig, spans)``: for each document with something to remove its spans, packed int32 starts and ends in bytes."""
    if not 12 <= length < 1 << 16:
        raise ValueError(f"not a length of strings to compare: {length}")
    own = _own(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(docs, size)
    hot = _hot_samples(own, size, length)
    first = written(_per_document(_settle_runs(_first_runs(own, buckets, length, hot), buckets, hot), length))
    open_runs = first.where("open IS NOT NULL")
    merged = _settle_strings(_open_strings(_texts_of(own, open_runs, "open"), buckets, length), buckets)
    spans = first.unionByName(_per_document(merged, length)).where("spans IS NOT NULL")
    # a document's spans from both steps, one after the other, are merged when they are used
    return (spans.groupBy("doc", "dig").agg(F.collect_list("spans").alias("s")).select("doc", "dig", F.expr("aggregate(s, X'', (a, x) -> a || x)").alias("spans")))


def _joined(spans: bytes) -> np.ndarray:
    pairs = np.frombuffer(spans, "<i4").reshape(-1, 2).astype(np.int64)
    return _merged(pairs[:, 0], pairs[:, 1]).reshape(-1, 2)


def report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its bytes, the removed ones, the removed spans, and the digest of what is left."""
    own = _own(docs, id_col, text_col)
    whole = "doc_id long,doc long,dig long,n_bytes long,whole_sha256 string"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in tk.slices(b.column(1), _SLICE):
                ids, digs = _keys(b, piece)
                raw = piece.data.tobytes()
                shas = [hashlib.sha256(raw[a:z]).hexdigest() for a, z in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)]
                yield batch(whole, b.column(0).slice(piece.first, len(ids)), ids, digs, np.diff(piece.offsets), shas)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, count, shas = [], [], []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw, pairs = text.encode(), _joined(spans)
                edges = [0, *pairs.ravel().tolist(), len(raw)]
                shas.append(hashlib.sha256(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))).hexdigest())
                removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                count.append(len(pairs))
            yield batch("doc long,dig long,n_removed long,n_spans long,sha string", b.column(0), b.column(1), removed, count, shas)

    texts = _texts_of(own, settled(lambda: repeated(docs, length, id_col, text_col)), "spans")
    changed = texts.mapInArrow(cut, "doc long, dig long, n_removed long, n_spans long, sha string").dropDuplicates(["doc", "dig"])
    zero = F.lit(0).cast("long")
    base = own.mapInArrow(measure, ", ".join(whole.split(",")))
    return base.join(changed, ["doc", "dig"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole_sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``: every document with what is left of its text; bytes that no longer form a character go with the span."""
    own = _own(docs, id_col, text_col)
    fields = "doc long,dig long,left string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.encode()
                edges = [0, *_joined(spans).ravel().tolist(), len(raw)]
                left.append("".join(raw[a:z].decode(errors="ignore") for a, z in zip(edges[::2], edges[1::2], strict=True)))
            yield batch(fields, b.column(0), b.column(1), left)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in tk.slices(b.column(1), _SLICE):
                ids, digs = _keys(b, piece)
                size = len(ids)
                yield batch("doc_id long,text string,doc long,dig long", b.column(0).slice(piece.first, size), b.column(1).slice(piece.first, size), ids, digs)

    changed = _texts_of(own, settled(lambda: repeated(docs, length, id_col, text_col)), "spans").mapInArrow(cut, ", ".join(fields.split(","))).dropDuplicates(["doc", "dig"])
    whole = own.mapInArrow(keyed, "doc_id long, text string, doc long, dig long")
    return whole.join(changed, ["doc", "dig"], "left").select("doc_id", F.coalesce("left", "text").alias("text"))
