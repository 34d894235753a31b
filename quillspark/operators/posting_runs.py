"""Postings of runs of documents: what a task shuffles for a full-text index is a row for each deal of terms and run.

A task counts the terms of some two million tokens at a time and packs those of one deal (a hash of the term) into one
row: the terms, and their documents' ids with frequencies and lengths, as compressed Arrow columns. Packed rows are what
is shuffled; they are opened again behind the shuffle. Everything is numpy over Arrow buffers; memory is bounded
by ``RUN_TOKENS`` and ``RUN_DOCUMENTS``, or by one document where it is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Tokens and documents that are counted together.
RUN_TOKENS, RUN_DOCUMENTS = 1 << 21, 1 << 15
#: Deals of terms.
DEALS = 1024
#: Postings of a term in one place from which each block has its own bounds; there are a few hundred blocks.
LEAST = 1024
#: Packed rows handed on at a time, and postings opened at a time.
_ROWS, _OPENED = 64, 1 << 17


PACKED = "deal int, run int, postings int, terms binary, records binary"


def deal(term: str) -> int:
    return zlib.crc32(term.encode()) % DEALS


def _sealed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unsealed(values: pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(v.as_buffer()).read_all() for v in values]).combine_chunks()


def _tokens(batch: pa.RecordBatch, fields: Sequence[str]) -> np.ndarray:
    """Tokens of each document, all fields together."""
    return sum(np.diff(batch.column(f).offsets.to_numpy()).astype(np.int64) for f in fields) if batch.num_rows else np.zeros(0, np.int64)


def _packed(docs: pa.Table, fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    docs = docs.combine_chunks()
    n, k = docs.num_rows, len(fields)
    lengths, texts, places = [], [pa.array([""] * n, pa.string())], [np.arange(n) * (k + 1) + k]  # the empty term stands for the document
    for j, f in enumerate(fields):
        column = docs[f].chunk(0)
        own = np.diff(column.offsets.to_numpy()).astype(np.int32)
        lengths.append(own)
        texts.append(column.flatten().cast(pa.string()))
        places.append(np.repeat(np.arange(n) * (k + 1) + j, own))
    coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    deals = np.array([deal(t) for t in coded.dictionary.to_pylist()], np.int32)
    order = np.argsort(deals, kind="stable")
    rank = np.append(np.empty(len(order), np.int64), -1)
    rank[order] = np.arange(len(order))
    # Sorted by deal, term, document, field; tokens that are null have no rank.
    codes = rank[coded.indices.fill_null(-1).to_numpy()]
    keys = np.sort((codes * (n * (k + 1)) + np.concatenate(places))[codes >= 0])
    pair, field = np.divmod(keys, k + 1)
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    code, doc = np.divmod(pair[starts], n)
    counts = [np.add.reduceat(field == j, starts, dtype=np.int32) for j in range(k)]
    numbers = [pa.array(x) for x in (*counts, *(x[doc] for x in lengths))]
    names = ["id", *(f"tf_{f}" for f in fields), *(f"len_{f}" for f in fields)]
    ids = docs["id"].chunk(0)
    records = pa.record_batch([ids.take(pa.array(doc)), *numbers], names=names)
    term_at = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
    place = order[code[term_at[:-1]]]
    terms = pa.record_batch([coded.dictionary.take(pa.array(place)), pa.array(np.diff(term_at).astype(np.int32))], names=["term", "size"])
    deal_at = np.append(np.flatnonzero(np.diff(deals[place], prepend=-1)), len(place))
    run = zlib.crc32(repr(ids[0].as_py()).encode()) >> 1
    for some in range(0, len(deal_at) - 1, _ROWS):
        rows = []
        for a, b in zip(deal_at[some : some + _ROWS], deal_at[some + 1 : some + _ROWS + 1]):
            start, end = int(term_at[a]), int(term_at[b])
            rows.append((int(deals[place[a]]), run, end - start, _sealed(terms.slice(a, b - a)), _sealed(records.slice(start, end - start))))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
        yield pa.record_batch(columns, names=["deal", "run", "postings", "terms", "records"])


def packer(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows ``(id, a token array for each field)`` to packed rows."""
    fields = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        tokens = rows = 0
        for batch in batches:
            total = np.cumsum(_tokens(batch, fields))
            at = 0
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = min(int(np.searchsorted(total, before + RUN_TOKENS - tokens)) + 1, at + RUN_DOCUMENTS - rows, batch.num_rows)
                waiting.append(batch.slice(at, end - at))
                tokens, rows, at = tokens + int(total[end - 1] - before), rows + end - at, end
                if tokens >= RUN_TOKENS or rows >= RUN_DOCUMENTS:
                    yield from _packed(pa.Table.from_batches(waiting), fields)
                    waiting, tokens, rows = [], 0, 0
        if waiting:
            yield from _packed(pa.Table.from_batches(waiting), fields)

    return run


def opener(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From packed rows to postings."""

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, records = _unsealed(batch.column("terms")), _unsealed(batch.column("records"))
        term = terms["term"].chunk(0).take(pa.array(np.repeat(np.arange(terms.num_rows), terms["size"].to_numpy())))
        own = np.repeat(batch.column("deal").to_numpy(), batch.column("postings").to_numpy())
        names = ["id", *(f"tf_{f}" for f in fields), *(f"len_{f}" for f in fields)]
        return pa.record_batch([pa.array(own), term, *(records[c].chunk(0) for c in names)], names=["deal", "term", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.cumsum(batch.column("postings").to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(total[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(total, before + _OPENED, "right")))
                yield opened(batch.slice(at, end - at))
                at = end

    return run


def bounder(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count, largest frequencies and smallest lengths of each stretch of sorted postings with one term and block.

    Fewer than ``LEAST`` postings of a term next to each other become one row with a null block, but not those of the empty
    term nor those at either end of a batch, where a frequent term may go on.
    """
    most, least = [f"tf_{f}" for f in fields], [f"len_{f}" for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, block = batch.column("term"), batch.column("block").to_numpy()
            coded = term.dictionary_encode()
            codes = coded.indices.to_numpy()
            at = np.flatnonzero(np.diff(codes, prepend=-1))
            size = np.diff(np.append(at, len(codes)))
            short = (size < LEAST) & (codes[at] != coded.dictionary.index("").as_py())
            short[[0, -1]] = False
            few = np.repeat(short, size)
            starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (~few & (np.diff(block, prepend=-1) != 0)))
            n = np.diff(np.append(starts, len(block))).astype(np.int64)
            ends = [np.maximum.reduceat(batch.column(f).to_numpy(), starts) for f in most] + [np.minimum.reduceat(batch.column(f).to_numpy(), starts) for f in least]
            yield pa.record_batch([term.take(pa.array(starts)), pa.array(block[starts], mask=few[starts]), pa.array(n), *map(pa.array, ends)], names=["term", "block", "n", *most, *least])

    return run
