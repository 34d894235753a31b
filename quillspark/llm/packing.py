"""Bounded-space online packing of tokenised documents into fixed windows.

Each task tokenises its rows and keeps at most ``OPEN_WINDOWS`` open windows. A
piece goes into the window that it fills best; when none has room the fullest
window is topped up with the head of the piece and emitted, and the tail is
placed in turn. Whole windows' worth of a long document is emitted at once.
What stays open at the end of a task (a bounded number of windows) is merged in
groups of tasks by the same rule; a group leaves one part-filled window at most.

Only pieces are shuffled, and ids only for the pieces of open windows. The first
step's rows are written to the shared folder, so that a task that runs again
after a loss can't disagree with what was merged.

Words recur, so the ids of each distinct unit are kept in a bounded table; see
``Encoder``.

Defined results: a null or empty text is one piece of one id, the end mark; text
that spells an added token gets that token's id, as the tokenizer's file says;
repeated rows are packed each on its own; of equally filled windows the one opened
first takes a piece; a very long text fills windows of its own and leaves one rest;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, written

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Tasks whose open windows are merged by one task.
MERGED_TASKS = 32
TABLE_ENTRIES = 600_000
PIECES = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"
OPEN = PIECES + ",origin long,ids binary"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A, 0x09, 0x0D]] = True
# Classes of bytes: 0 other, 1 ASCII letter, 2 digit, 3 punctuation that never joins letters, 4 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 3
_CLASS[_SPACE] = 4
# The rules of the tokenizer that ``Encoder`` follows unit by unit.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Encoder:
    """Ids of texts by a tokenizer, each text closed by the end mark.

    With the normaliser and splitter named in ``_NORMALIZER`` and ``_SPLIT``, tokens never span white
    space. Within it, runs of letters (ASCII and Latin-1), runs of ASCII punctuation and single digits
    are what the tokenizer looks at one by one, and it folds their case. Chunks with anything else, an
    apostrophe or an added token included, are looked up whole. Units are told apart by 64-bit hashes.
    A tokenizer with other rules encodes every text as it stands.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(Path(path).read_text())
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_units = rules.get("normalizer") == _NORMALIZER and len(splits) == 2 and splits[0].get("pattern") == _SPLIT and splits[1].get("type") == "ByteLevel" and not splits[1].get("add_prefix_space")
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.entry = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.n_ids = 0

    def _units(self, piece: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes, the units' starts and ends, which are whole chunks, and each text's first unit."""
        data = piece.data
        n = len(data)
        folded = _LOWER[data]
        kind = _CLASS[data]
        latin = np.zeros(n + 1, bool)  # second bytes of Latin-1 letters
        lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        second = data[lead + 1]
        good = (second != 0x97) & (second != 0xB7)
        lead, second = lead[good], second[good]
        latin[lead + 1] = True
        kind[lead] = kind[lead + 1] = 1
        upper = (second >= 0x80) & (second <= 0x9E)
        folded[lead[upper] + 1] += 32
        starts, ends, first = tk.spans(piece, _SPACE)
        odd = np.concatenate([[0], np.cumsum(kind == 0)])
        whole = odd[ends] > odd[starts]
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole[np.searchsorted(starts, at, side="right") - 1] = True
                at = raw.find(token, at + 1)
        mark = np.zeros(n + 1, bool)  # where a unit begins inside an ordinary chunk
        if n > 1:
            mark[1:n] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] != 4)
        for s, e in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True):
            mark[s:e] = False
        mark[starts] = True
        begin = np.flatnonzero(mark)
        chunk = np.searchsorted(starts, begin, side="right") - 1
        end = np.minimum(ends[chunk], np.append(begin[1:], n))
        return folded, begin, end, whole[chunk], np.searchsorted(begin, piece.offsets)

    def _learn(self, keys: np.ndarray, units: list[str], whole: list[bool]) -> None:
        found: list[np.ndarray] = [None] * len(keys)  # type: ignore[list-item]
        plain = [k for k, w in enumerate(whole) if not w]
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            e = self.tokenizer.encode(" ".join(units[k] for k in part), add_special_tokens=False)
            ids, of = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            at = np.searchsorted(of, np.arange(len(part) + 1))
            for j, k in enumerate(part):
                found[k] = ids[at[j] : at[j + 1]]
        odd = [k for k, w in enumerate(whole) if w]
        for i in range(0, len(odd), 512):
            part = odd[i : i + 512]
            for k, e in zip(part, self.tokenizer.encode_batch([units[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, np.uint32)
        sizes = np.array([len(x) for x in found], np.int64)
        total = int(sizes.sum())
        while len(self.ids) < self.n_ids + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + total] = np.concatenate(found)
        all_keys = np.concatenate([self.keys, keys])
        all_entries = np.concatenate([self.entry, len(self.begin) + np.arange(len(keys))])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.entry = all_keys[order], all_entries[order]
        self.begin = np.concatenate([self.begin, self.n_ids + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.n_ids += total

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """Which sorted keys are in the table."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def _encode_whole(self, piece: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        raw = piece.data.tobytes()
        texts = [raw[a:z].decode() for a, z in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)]
        made = [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in made for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)

    def encode(self, piece: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, each text closed by the end mark, and where each text's ids begin."""
        if not self.by_units:
            return self._encode_whole(piece)
        folded, starts, ends, whole, first = self._units(piece)
        keys = tk.span_hash(tk.prefix_hash(folded), starts, ends)
        if whole.any():  # added tokens are told apart before case is folded
            keys[whole] = tk.span_hash(tk.prefix_hash(piece.data), starts[whole], ends[whole]) ^ np.uint64(1)
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(distinct))
        if len(self.keys) + len(new) > TABLE_ENTRIES:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            raw = piece.data.tobytes()
            some = at[new]
            texts = [raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            self._learn(distinct[new], texts, whole[some].tolist())
        entry = self.entry[np.searchsorted(self.keys, distinct)]
        # the end mark stands behind each text's units
        order = np.insert(which, first[1:], len(distinct))
        begin, size = np.append(self.begin[entry], 0), np.append(self.size[entry], 1)
        take = size[order]
        out_at = np.concatenate([[0], np.cumsum(take)])
        source = np.repeat(begin[order] - out_at[:-1], take) + np.arange(out_at[-1])
        out = self.ids[source]
        text_at = out_at[first + np.arange(len(first))]
        out[text_at[1:] - 1] = self.end_id
        return out, text_at


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The process's encoder: loading it and what it has learned serve later tasks too."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class Packer:
    """Open windows of one task; ``emit`` is called with each closed window's pieces."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.limit = emit, window, open_windows
        self.open: list[list] = []
        self.used: list[int] = []

    def place(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, start + at, total, ids[at : at + self.window])])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            room = [self.window - u for u in self.used]
            fits = [(r, k) for k, r in enumerate(room) if r >= len(ids)]
            if fits:
                self._put(min(fits)[1], (doc, start, total, ids))
                return
            if len(self.open) < self.limit:
                self.open.append([(doc, start, total, ids)])
                self.used.append(len(ids))
                return
            fullest = min((r, k) for k, r in enumerate(room))[1]
            head = self.window - self.used[fullest]
            self._put(fullest, (doc, start, total, ids[:head]))
            start, ids = start + head, ids[head:]

    def _put(self, k: int, piece) -> None:
        self.open[k].append(piece)
        self.used[k] += len(piece[3])
        if self.used[k] == self.window:
            self.emit(self.open.pop(k))
            self.used.pop(k)


def _rows(sequences: list[tuple[int, list]]) -> list[tuple]:
    out = []
    for sequence, pieces in sequences:
        offset = 0
        for doc, start, total, ids in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
            offset += len(ids)
    return out


def _as_batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    return batch(fields, *(zip(*rows, strict=True) if rows else [[] for _ in fields.split(",")]))


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: where it starts there, its sequence and its place in it."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tool, done, closed = encoder(tokenizer_path, end_id), [], 0

        packer = Packer(lambda pieces: done.append(pieces), window, open_windows)
        for b in batches:
            for piece in tk.slices(b.column(1)):
                ids, at = tool.encode(piece)
                names = b.column(0).slice(piece.first, piece.last - piece.first).to_pylist()
                for r, doc in enumerate(names):
                    packer.place(doc, 0, int(at[r + 1] - at[r]), ids[at[r] : at[r + 1]])
                rows = [(*x, None, None) for x in _rows([((task << 33) + closed + k, p) for k, p in enumerate(done)])]
                closed += len(done)
                done.clear()
                yield _as_batch(rows, OPEN)
        left = sorted(zip(packer.used, packer.open, strict=True), key=lambda x: -x[0])
        rows = [(doc, start, len(ids), None, total, k, None, task, ids.astype("<u4").tobytes()) for k, (_, pieces) in enumerate(left) for doc, start, total, ids in pieces]
        yield _as_batch(rows, OPEN)
        tk.give_back()

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        done: list = []
        packer = Packer(lambda pieces: done.append(pieces), window, open_windows)
        ordered = rows.sort_by([(c, "ascending") for c in ("origin", "sequence_id", "doc_id", "start")])
        for doc, start, total, ids in zip(*(ordered.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
            packer.place(doc, start, total, np.frombuffer(ids, "<u4"))
        # the last open windows are filled one after the other, so that one stays part-filled at most
        last = Packer(packer.emit, window, 1)
        for _, pieces in sorted(zip(packer.used, packer.open, strict=True), key=lambda x: -x[0]):
            for doc, start, total, ids in pieces:
                last.place(doc, start, total, ids)
        group = key[0].as_py()
        return pa.Table.from_batches([_as_batch(_rows([((1 << 62) + (group << 33) + k, p) for k, p in enumerate([*done, *last.open])]), PIECES)])

    schema = ", ".join(OPEN.split(","))
    filled = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fill, schema))
    columns = [x.split()[0] for x in PIECES.split(",")]
    closed = filled.where(F.col("origin").isNull()).select(columns)
    merged = filled.where(F.col("origin").isNotNull()).withColumn("g", F.floor(F.col("origin") / MERGED_TASKS)).groupBy("g").applyInArrow(merge, ", ".join(PIECES.split(",")))
    return closed.unionByName(merged.select(columns))
