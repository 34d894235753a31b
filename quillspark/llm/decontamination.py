"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (A-Z folded, see ``textkit.IS_PUNCTUATION``) form a suffix
automaton that every task gets. The words of the training texts are streamed
through it; the length of the longest match that ends at each word is tracked,
and a match of ``window`` words or more marks these words as hit. An item with
fewer words counts as one window. Stretches in which some run of words cannot be
part of any window are passed over without loss.

An automaton holds at most ``BLOCK_BYTES`` of item text (or one item); a larger
benchmark is split into blocks by hash. Blocks come one after the other: an automaton
is built, sent, used in a pass over the texts and let go before the next one is built,
so driver and tasks hold one at a time. What a pass finds is kept for each document
that has something, and the passes' hits are joined by document at the end.

Defined results: null and empty texts have no words and are clean; items without
words match nothing; repeated items count once for their id; a null item_id is
reported as the empty string; repeated documents are each judged; a very long text
is scanned whole, as one row; a document exactly at the coverage limit stays; an
empty benchmark leaves all documents clean; other columns are passed through or
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, free_name, settled, written

WINDOW = 10
#: A document with a larger share of hit words goes as a whole; otherwise its hit spans go.
MAX_COVERAGE = 0.5
BLOCK_BYTES = 2_000_000
#: Hits of all blocks together that are sent to the texts, in bytes; beyond that they are joined by a shuffle.
SENT_BYTES = 64_000_000
REPORT = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean"


def _words(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tk.spans(piece, tk.IS_PUNCTUATION)
    return starts, ends, first, tk.span_hash(tk.prefix_hash(piece.data, tk.BYTE_VALUE_LOWER), starts, ends)


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * tk.ORDER_VALUE[k]
    return tk.mix(total)


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window.

    It is built in dictionaries, then kept in sorted arrays: some 40 bytes for each word of the items.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if len(words)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        numbered = [np.searchsorted(self.vocabulary, words).tolist() for _, words in items]
        for words in numbered:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.names = [name for name, _ in items]
        windows: dict[int, set[tuple[int, int]]] = {}
        for k, words in enumerate(numbered):
            size = min(window, len(words))
            state = 0
            for i, word in enumerate(words):
                state = self.step[state][word]
                if i + 1 >= size:
                    windows.setdefault(size, set()).add((self._suffix(state, size), k))
        #: By the window's length: states of the windows' last words, sorted, and the items that hold each.
        self.owners = {size: tuple(np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) for size, pairs in windows.items()}
        self.shortest = min(self.owners, default=0)
        self.gram = min(4, self.shortest)
        self.grams = np.unique(np.concatenate([_grams(w, self.gram) for _, w in items])) if items else np.zeros(0, np.uint64)
        steps = np.array(sorted((state << 32 | word, to) for state, moves in enumerate(self.step) for word, to in moves.items()), np.int64).reshape(-1, 2)
        self.moves, self.targets = steps[:, 0].copy(), steps[:, 1].astype(np.int32)
        self.link, self.length = np.array(self.link, np.int32), np.array(self.length, np.int32)
        del self.step

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The state for the extension of ``state``; the target is cloned where it holds longer strings too."""
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = clone
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        made = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.step[state]:
            self.step[state][word] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, word, self.step[state][word])
        return made

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _move(self, state: int, word: int) -> int:
        """The next state, or -1."""
        at = int(np.searchsorted(self.moves, state << 32 | word))
        return int(self.targets[at]) if at < len(self.moves) and self.moves[at] == state << 32 | word else -1

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """Windows that occur: their first word, the word after the last, and their items."""
        state = length = 0
        place = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[place] == words if len(self.vocabulary) else np.zeros(len(words), bool)
        for i, (word, ok) in enumerate(zip(place.tolist(), known.tolist(), strict=True)):
            if not ok:
                state = length = 0
                continue
            to = self._move(state, word)
            while to < 0 and state:
                state = int(self.link[state])
                length = int(self.length[state])
                to = self._move(state, word)
            if to >= 0:
                state = to
                length += 1
            for size, (states, holders) in self.owners.items():
                if length >= size:
                    own = self._suffix(state, size)
                    a, z = np.searchsorted(states, own), np.searchsorted(states, own, side="right")
                    if a < z:
                        yield i + 1 - size, i + 1, {self.names[k] for k in holders[a:z].tolist()}

    def stretches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of words, each in one text, outside of which no window can lie."""
        if not len(self.grams) or len(words) < self.gram:
            return
        grams = _grams(words, self.gram)
        known = self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams
        edges = first[1:-1]
        for k in range(1, self.gram):  # no gram spans two texts
            at = edges - k
            known[at[(at >= 0) & (at < len(known))]] = False
        turn = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for begin, end in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            inner = edges[(edges > begin) & (edges < end)].tolist() if self.gram == 1 else []
            for a, b in zip([begin, *inner], [*inner, end], strict=True):
                if b - a + self.gram - 1 >= self.shortest:
                    yield a, b + self.gram - 1


def automata(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Automaton]:
    """An automaton for each block of items; each block's text is bounded, and so is what reaches the driver at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).toArrow() if blocks > 1 else items.toArrow()
        found: list[tuple[str, np.ndarray]] = []
        names = rows.column(0).to_pylist()
        for piece in tk.slices(rows.column(1)):
            _, _, first, words = _words(piece)
            found += [(names[piece.first + r], words[first[r] : first[r + 1]]) for r in range(len(first) - 1)]
        yield Automaton(found, window)


def _hits(piece: tk.Slice, tool: Automaton):
    """Words of a slice: spans, first word of each text, hit flags, and the items found in each text."""
    starts, ends, first, words = _words(piece)
    hit = np.zeros(len(words), bool)
    items: dict[int, set[str]] = {}
    for a, b in tool.stretches(words, first):
        row = int(np.searchsorted(first, a, side="right")) - 1
        for begin, end, names in tool.matches(words[a:b]):
            hit[a + begin : a + end] = True
            items.setdefault(row, set()).update(names)
    return starts, ends, first, hit, items


def _runs(hit: np.ndarray) -> np.ndarray:
    """Where runs of hit words begin and end, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))


def _joined(runs: list[np.ndarray]) -> np.ndarray:
    """Runs of several blocks as one set of runs."""
    pairs = np.concatenate(runs).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(pairs)) - 1]], axis=1)


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


FOUND = "doc_id long,text_key long,runs binary,items binary"


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text_key, runs, items)`` of documents with hits: runs of hit words and JSON of the item ids, all blocks together."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    schema = ", ".join(FOUND.split(","))

    def one_pass(tool: Automaton) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(tool)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for piece in tk.slices(b.column(2)):
                    _, _, first, hit, items = _hits(piece, sent.value)
                    rows = sorted(items)
                    part = b.slice(piece.first, piece.last - piece.first).take(pa.array(rows, pa.int64()))
                    runs = [_runs(hit[first[r] : first[r + 1]]).astype("<i8").tobytes() for r in rows]
                    yield batch(FOUND, part.column(0), part.column(1), runs, [json.dumps(sorted(items[r])).encode() for r in rows])

        out = written(own.mapInArrow(scan, schema))
        sent.destroy()
        return out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [_joined([np.frombuffer(x, "<i8") for x in xs]).astype("<i8").tobytes() for xs in b.column(2).to_pylist()]
            items = [json.dumps(sorted({i for x in xs for i in json.loads(x)})).encode() for xs in b.column(3).to_pylist()]
            yield batch(FOUND, b.column(0), b.column(1), runs, items)

    passes = [one_pass(tool) for tool in automata(benchmark, window, block_bytes=block_bytes)]
    together = functools.reduce(DataFrame.unionByName, passes)
    # a document's rows: one for each block with hits, more only where rows are repeated
    return together.groupBy("doc_id", "text_key").agg(F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items")).mapInArrow(merge, schema)


def _with_hits(docs: DataFrame, hits: DataFrame, doc_id: Column, text_key: Column, *columns: str) -> DataFrame:
    """``docs`` and, where there are some, the columns of their hits, by id and text."""
    known, key = free_name(docs, "hit_id"), free_name(docs, "hit_key")
    few = hits.select(F.col("doc_id").alias(known), F.col("text_key").alias(key), *(F.col(a).alias(b) for a, b in zip(("runs", "items"), columns, strict=False)))
    size = hits.agg(F.sum(F.octet_length("runs") + F.octet_length("items") + 32)).first()[0] or 0
    few = F.broadcast(few) if size <= SENT_BYTES else few
    return docs.join(few, doc_id.eqNullSafe(F.col(known)) & (text_key == F.col(key)), "left").drop(known, key)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``docs``: its words, hit words and the items that occur in it."""
    hits = settled(lambda: found(docs, benchmark, window, id_col, text_col, block_bytes))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in tk.slices(b.column(2)):
                part = b.slice(piece.first, piece.last - piece.first)
                first = tk.spans(piece, tk.IS_PUNCTUATION)[2]
                yield batch("doc_id long,text_key long,n_words long", part.column(0), part.column(1), np.diff(first))

    counted = _with_hits(own.mapInArrow(count, "doc_id long, text_key long, n_words long"), hits, F.col("doc_id"), F.col("text_key"), "runs", "items")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x or b"", "<i8").reshape(-1, 2) for x in b.column(3).to_pylist()]
            names = [json.loads(x) if x else [] for x in b.column(4).to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            n_hit = np.array([int((x[:, 1] - x[:, 0]).sum()) for x in runs], np.int64)
            yield batch(REPORT, b.column(0), b.column(2), n_hit, [len(x) for x in names], digests, n_hit > 0)

    return counted.select("doc_id", "text_key", "n_words", "runs", "items").mapInArrow(judge, ", ".join(REPORT.split(",")))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without hit spans; rows with more than ``max_coverage`` of their words hit are gone.

    A span runs from the first to the last byte of consecutive hit words. ``length_col``, if given,
    gets the new length in characters where a text changed.
    """
    hits = settled(lambda: found(docs, benchmark, window, id_col, text_col, block_bytes))
    marks = free_name(docs, "hit_runs")
    marked = _with_hits(docs, hits, F.col(id_col).cast("long"), _text_key(text_col), marks).select(*docs.columns, marks)
    where = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            changed: dict[int, str] = {}
            touched = np.flatnonzero(pc.is_valid(b.column(b.num_columns - 1)).to_numpy(zero_copy_only=False))
            some = b.take(pa.array(touched))
            for piece in tk.slices(some.column(where)):
                starts, ends, first = tk.spans(piece, tk.IS_PUNCTUATION)
                raw = piece.data.tobytes()
                for r in range(piece.last - piece.first):
                    runs = np.frombuffer(some.column(b.num_columns - 1)[piece.first + r].as_py(), "<i8").reshape(-1, 2)
                    row = int(touched[piece.first + r])
                    if (runs[:, 1] - runs[:, 0]).sum() > max_coverage * (first[r + 1] - first[r]):
                        keep[row] = False
                        continue
                    turn = runs + first[r]
                    cuts = [piece.offsets[r], *(x for s, e in turn.tolist() for x in (starts[s], ends[e - 1])), piece.offsets[r + 1]]
                    changed[row] = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            columns = b.columns[:-1]
            if changed:
                flag = np.zeros(b.num_rows, bool)
                flag[list(changed)] = True
                rows = sorted(changed)
                columns[where] = pc.replace_with_mask(columns[where], pa.array(flag), pa.array([changed[r] for r in rows], columns[where].type))
                if length_at is not None:
                    columns[length_at] = pc.replace_with_mask(columns[length_at], pa.array(flag), pa.array([len(changed[r]) for r in rows], columns[length_at].type))
            b = pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])
            yield b if keep.all() else b.filter(pa.array(keep))

    return marked.mapInArrow(scan, docs.schema)
