import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_threads, co_training, components, decontamination, language_id, line_dedup, near_duplicates, packing, pii, quality_rules, repeated_spans
from quillspark.llm import textkit as tk
from quillspark.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute
from tests.llm.conftest import odd_rows, passage


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("sent", [repeated_spans.SENT_BYTES, 0])
@pytest.mark.parametrize("which", ["odd", "documents"])
def test_repeated_spans(which, sent, request, monkeypatch):
    monkeypatch.setattr(repeated_spans, "SENT_BYTES", sent)
    df = request.getfixturevalue(which)
    rows = {(repeated_spans.NO_ID if d is None else d, (t or "").encode()) for d, t in texts(df)}
    want = brute.repeated(sorted(rows, key=lambda r: (r[0], repeated_spans._digest(r[1]))))
    by_id = collections.defaultdict(set)
    for (d, _), v in want.items():
        by_id[d].add(v)
    got = repeated_spans.report(df).collect()
    assert len(got) == df.count()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in by_id[repeated_spans.NO_ID if r.doc_id is None else r.doc_id] for r in got)


@pytest.mark.parametrize("length", [12, 20, 37, 300])
def test_other_lengths_and_hot_samples(length, spark, monkeypatch):
    monkeypatch.setattr(repeated_spans, "BUCKET_BYTES", 2_000)
    rows = [(i, f"{' ' * 40}{passage(3, i)}{' ' * 45}{passage(30, i % 4)} {'ab' * (i % 5) * 40}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.repeated([(d, t.encode()) for d, t in rows], length)
    own = repeated_spans._own(df, "doc_id", "text")
    assert length != 20 or len(repeated_spans._hot_samples(own, 60_000, length))
    got = {(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_spans.report(df, length).collect()}
    assert got == {d: v for (d, _), v in want.items()}


def test_impossible_lengths(documents):
    for length in (3, 70_000):
        with pytest.raises(ValueError):
            repeated_spans.report(documents, length)


def test_removed_text(spark):
    p = passage(40, 9)
    df = spark.createDataFrame([(1, "a " + p), (2, "b " + p + " é"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeated_spans.without_repeats(df).collect()}
    assert got[1] == "a " + p and got[3] is None and got[2] == "b é"


def test_language(spark, documents, odd):
    got = language_id.report(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    judged = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert judged and sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    odd_got = language_id.report(odd).collect()
    assert len(odd_got) == odd.count() and all(0 <= r.score <= 1 for r in odd_got)
    silent = {d for d, t in texts(odd) if not any(c.isalpha() for c in t or "")}
    assert all(r.lang_pred == "und" for r in odd_got if r.doc_id in silent and r.doc_id is not None)


def test_more_languages_than_one_mask(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(3 * i + k, (letters[i % 26] + letters[i // 26] + letters[(i * 7) % 26] + " ") * 40, f"l{i:02d}") for i in range(70) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learned(df, F.lit(True))
    assert filters.planes.shape[0] == 2
    got = language_id.predicted(df, filters).join(df, "doc_id").where("lang_pred = lang").count()
    assert got >= 0.9 * df.count()


def test_nothing_learned(spark, odd):
    df = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.report(df).collect()} == {"und"}


def plain_lines(rows, ratio=0.1, least=5):
    pages, counts = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        pages[s] += 1
        counts.update((s, x) for x in set((t or "").split("\n")) if t is not None and x.strip(" "))
    bad = {k for k, n in counts.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x) not in bad) for _, t, s in rows]


@pytest.mark.parametrize("sent", [line_dedup.SENT_LINES, -1])
def test_line_dedup(spark, sent, monkeypatch, odd):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)
    rows = [(i, f"head {i}\nmenu\n\n body {i % 2} \nfoot {i % 9}", ("a", "b", None)[i % 3]) for i in range(60)] + [(99, None, "a"), (98, "", "a"), (97, "menu", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).withColumn("line", F.lit("x"))
    got = {r.doc_id: r for r in line_dedup.without_boilerplate(df, length_col="n_chars").collect()}
    want = plain_lines(rows)
    assert [got[r[0]].text for r in rows] == want
    assert all(got[r[0]].n_chars == (None if w is None else len(w)) for r, w in zip(rows, want, strict=True))
    assert line_dedup.without_boilerplate(odd).columns == odd.columns
    assert line_dedup.report(odd).count() == odd.count()


def test_quotations(spark):
    rows = [
        (1, 0, "a", "First point.\n\nSecond point here."), (1, 1, "b", "> Second point here.\nI agree."), (1, 2, "a", "On Monday b wrote:\n> > Second point here.\n> I agree.\nThanks"),
        (1, 3, "c", "> nowhere said\nhm"), (1, 4, None, None), (1, 5, "d", ""), (2, 0, "a", "I agree."), (2, 1, "b", "> I  AGREE.\nok"), (None, None, None, "> ok\nx"), (1, 3, "c", "> nowhere said\nhm"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in chat_threads.threads(df).collect()}
    assert len(got) == 9 and chat_threads.threads(df).count() == 9
    assert [(got[1, t].reply_to, got[1, t].thread, got[1, t].depth) for t in range(6)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (None, 4, 0), (None, 5, 0)]
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].text) == (2, 2, "Thanks")
    assert (got[1, 3].n_quotes, got[1, 3].n_linked, got[1, 4].text) == (1, 0, "")
    assert got[2, 1].reply_to == 0 and got[2, 1].formatted == "<|b|>\nok"
    assert [(r.conv_id, r.turn) for r in chat_threads.reply_ordered(df.where("conv_id = 1")).collect()] == [(1, t) for t in range(6)]
    assert chat_threads.threads(df.limit(0)).count() == 0


def test_quoted_excerpts_and_nested_introductions(spark):
    rows = [
        (0, "One fine line.\nTwo fine lines.\nThree fine lines.\n\nSecond part\nwrapped.\n\nThird part."), (1, "One fine line.\nand more"),
        (2, "> One fine line.\n> Two fine lines.\nexcerpt of lines"), (3, "> Second part wrapped.\n>\n> Third part.\ntwo of three paragraphs"),
        (4, "On Tue d wrote:\n> two of three paragraphs\n>\n> On Mon a wrote:\n>> Third part.\nnested"), (5, "> and more\n> Two fine lines.\nlatest source"),
        (6, "> nested\n> this was never said by anyone in here\nmostly unknown"), (7, "> On Mon a wrote:\nnothing quoted"),
    ]
    got = {r.turn: r for r in chat_threads.threads(spark.createDataFrame([(1, t, "a", x) for t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t].reply_to for t in range(8)] == [None, None, 0, 0, 3, 1, None, None]
    assert [(got[t].n_quotes, got[t].n_linked) for t in range(2, 8)] == [(1, 1), (1, 1), (2, 2), (1, 1), (1, 0), (0, 0)]
    assert (got[4].thread, got[4].depth, got[4].text) == (0, 2, "nested")


def test_long_reply_chain(spark):
    rows = [(1, t, "a", (f"> message number {t - 1}\n" if t else "") + f"message number {t}") for t in range(40)]
    got = {r.turn: r for r in chat_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((got[t].thread, got[t].depth) == (0, t) for t in range(40))


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_quality_counts(which, request):
    df = request.getfixturevalue(which)
    got = quality_rules.report(df, np.zeros(1 << quality_rules.BUCKET_BITS, np.int64)).collect()
    want = sorted((d is None, d, *brute.rules(t)) for d, t in texts(df))
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)


def test_likelihood_ratio(spark, documents):
    """The model against counts made one n-gram at a time."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trusted = set(quality_rules.trusted_sample(labels))
    raw, good = collections.Counter(), collections.Counter()
    codes = {}
    for d, t in texts(documents):
        data = t.encode()
        mine = []
        for i in range(len(data) - 3):
            c = 0
            for k in range(4):
                c = (c * 0x01000193 & 0xFFFFFFFF) ^ data[i + k]
            c = ((c ^ c >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality_rules.BUCKET_BITS)
            mine.append(c)
        codes[d] = mine
        raw.update(mine)
        if d in trusted:
            good.update(mine)
    size = 1 << quality_rules.BUCKET_BITS
    a, b = sum(good.values()) + 0.5 * size, sum(raw.values()) + 0.5 * size
    ratio = {c: round((np.log((good[c] + 0.5) / a) - np.log((raw[c] + 0.5) / b)) * 65536) for c in raw}
    got = quality_rules.report(documents, quality_rules.fitted(documents, labels)).collect()
    for r in got:
        total, n = sum(ratio[c] for c in codes[r.doc_id]), len(codes[r.doc_id])
        assert r.n_grams == n and abs(r.llr - total / 65536 / max(n, 1)) < 1e-3
        assert r.kept == (not r.base_failed and total >= round(quality_rules.THRESHOLD * 65536) * n) or abs(r.llr - quality_rules.THRESHOLD) < 1e-3


def test_rules_keep_clean_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    ratios = quality_rules.fitted(documents, labels)
    judged = quality_rules.report(documents, ratios).join(labels, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() == 0 and judged.where("quality = 0 AND kept").count() == 0
    assert quality_rules.keep(documents, ratios).columns == documents.columns


def test_co_training(spark, documents, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = co_training.report(documents, labels).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    assert co_training.report(odd, labels).count() == odd.count()
    assert co_training.report(odd, labels.limit(0)).where("score > 0.99").count() == odd.count()
    assert co_training.report(empty, labels).count() == 0


def array_pool(views):
    """What ``trained`` does over all documents, over arrays."""

    def pool(weights, taken):
        out = []
        for k in range(2):
            p = co_training.sigmoid(co_training.linear(views[k], weights[k]))
            free = ~np.isin(np.arange(len(p)), sorted(taken[k]))
            out.append({int(r): (label, views[0][r], views[1][r]) for label, rows, _ in co_training.confident(p, np.arange(len(p)), free) for r in rows})
        return out

    return pool


def test_co_training_on_unseen_documents():
    """Pseudo-labels of one view teach the other: accuracy on rows that were never labelled."""
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 600)
    a = (y[:, None] * 1.0 + r.normal(0, 0.8, (600, 6))).astype(np.float32)
    b = (y[:, None] * 1.0 + r.normal(0, 0.8, (600, 6))).astype(np.float32)
    _, _, score = co_training.co_train(a[:60], b[:60], y[:60], array_pool((a[60:], b[60:]))).scores(a, b)
    assert ((score[60:] >= 0.5) == y[60:]).mean() > 0.9


def test_a_useless_view_is_calibrated_to_a_constant():
    r = np.random.default_rng(6)
    y = (r.random(400) < 0.7).astype(int)
    good = (y[:, None] + r.normal(0, 0.3, (400, 3))).astype(np.float32)
    bad = np.zeros((400, 3), np.float32)
    bad[np.concatenate([np.flatnonzero(y == k)[::5] for k in (0, 1)])] = 1  # only what is set aside
    bad *= (1 - 2 * y)[:, None]
    model = co_training.co_train(good, bad, y, lambda *_: [{}, {}])
    assert model.meta_scale[0] >= 0 and abs(co_training.sigmoid(np.array(model.meta_scale[1])) - 0.7) < 0.1


def test_copies_count_once_when_handed_over():
    ids = np.array([7] * 500 + [3, 4, 3])
    p = np.array([0.001] * 500 + [0.01, 0.03, 0.002])
    got = {label: (at.tolist(), unsure.tolist()) for label, at, unsure in co_training.confident(p, ids, np.ones(len(p), bool))}
    assert got == {0: ([7, 3, 4], [0.001, 0.002, 0.03]), 1: ([], [])}


def test_a_view_that_does_not_rank_hands_over_nothing():
    r = np.random.default_rng(7)
    y = (np.arange(600) % 3 > 0).astype(int)
    good = (y[:, None] + r.normal(0, 0.3, (600, 4))).astype(np.float32)
    noise = r.normal(0, 1, (600, 1)).astype(np.float32)
    seen = []

    def pool(weights, taken):
        seen.append([bool(np.any(w)) for w in weights])
        return [{}, {}] if len(seen) > 1 else array_pool((good, noise))(weights, taken)

    co_training.co_train(good, noise, y, pool)
    assert seen and all(s == [True, False] for s in seen)


def test_page_layout_features(spark):
    piece, = tk.slices(pa.array(["", "Ab 12\n\nx!", None, "é" * 40]))
    got = co_training.meta_features(piece, [0, 9, None, 40], [None, "en", None, "fr"], [None] * 4)
    lines, length = got[:, 128:160].argmax(1).tolist(), got[:, 160:176].argmax(1).tolist()
    assert lines == [0, 2, 0, 1] and length == [0, 2, 0, 7] and (got.sum(1) == 8).all()
    assert [got[1, k : k + 8].argmax() for k in (176, 184, 192)] == [6, 6, 6] and got[3, 176] == got[0, 192] == 1


def test_pool_covers_all_documents(spark):
    """Accuracy on labels that training never saw, and the same pool as one computed over arrays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string"))) % 2
    got = co_training.report(docs, labels.where(fold == 0)).join(labels.where(fold == 1), "doc_id").collect()
    assert len(got) > 100 and sum(r.kept == (r.quality == 1) for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 300])
@pytest.mark.parametrize("which", ["odd", "documents"])
def test_decontamination(which, block, request, spark):
    df = request.getfixturevalue(which)
    items = [(1, passage(60, 1)), (2, "b c"), (3, ""), (None, None), (4, passage(300, 2)[200:700]), (5, "!!"), (4, "same line same"), (6, "日本語 テキスト 日本語")]
    if which == "documents":
        items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()] + [(None, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(df, bench, block_bytes=block).collect()
    want = sorted((d is None, d or 0, *brute.contaminated(t, items)) for d, t in texts(df))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    clean = decontamination.cleaned(df, bench, length_col="n_chars", block_bytes=block)
    assert clean.columns == df.columns and clean.where("text IS NOT NULL AND n_chars <> length(text) AND doc_id < 500").count() == 0


def test_automaton_against_all_windows():
    random.seed(4)
    for _ in range(60):
        items = [(str(k), np.array([random.randint(1, 3) for _ in range(random.randint(0, 9))], np.uint64)) for k in range(4)]
        tool = decontamination.Automaton(items, 4)
        text = np.array([random.randint(1, 4) for _ in range(40)], np.uint64)
        wins = collections.defaultdict(set)
        for name, w in items:
            for i in range(max(1, len(w) - 3) if len(w) else 0):
                wins[tuple(w[i : i + 4].tolist())].add(name)
        want = {(i, i + s, tuple(sorted(wins[tuple(text[i : i + s].tolist())]))) for s in {len(w) for w in wins} for i in range(len(text) - s + 1) if tuple(text[i : i + s].tolist()) in wins}
        got = set()
        for a, b in tool.stretches(text, np.array([0, len(text)])):
            got |= {(a + i, a + j, tuple(sorted(n))) for i, j, n in tool.matches(text[a:b])}
        assert got == want


def check_packing(df, pieces, window=packing.WINDOW):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for d, t in texts(df):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids)] += len(ids)
    got = collections.Counter()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
        by_sequence[p.sequence_id].append(p)
    assert got == want
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))] and sum(p.length for p in ps) <= window
    single = {d: np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts(df) if d is not None}
    twice = {d for d, n in collections.Counter(d for d, _ in texts(df)).items() if n > 1}
    for p in pieces:
        if p.doc_id is not None and p.doc_id not in twice:
            assert zlib.crc32(single[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
    return len(by_sequence), sum(want.values())


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing(which, request):
    df = request.getfixturevalue(which)
    sequences, tokens = check_packing(df, packing.packed(df, tokenizer_path()).collect())
    assert sequences <= tokens / packing.WINDOW + 3


@pytest.mark.parametrize("by_units", [True, False])
def test_encoder_follows_the_tokenizer(by_units):
    from tokenizers import Tokenizer

    random.seed(21)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "\n", "a", "Zé", "it's", "12", "#!", "日本", "\x00", "…", "É", "ß", "'", "\u00a0", "\x85", "e\u0301", "\u00d7"]
    wanted = ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(3000)]
    tool, plain = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert tool.by_units
    tool.by_units = by_units
    for piece in tk.slices(pa.array(wanted), 4000):
        ids, at = tool.encode(piece)
        for r in range(piece.last - piece.first):
            assert ids[at[r] : at[r + 1]].tolist() == [*plain.encode(wanted[piece.first + r], add_special_tokens=False).ids, 1], wanted[piece.first + r]


def test_encoder_with_a_small_table(monkeypatch):
    monkeypatch.setattr(packing, "TABLE_ENTRIES", 50)
    wanted = [passage(40, k) for k in range(30)]
    tool, whole = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path())
    whole.by_units = False
    for piece in tk.slices(pa.array(wanted), 700):
        assert [x.tolist() for x in tool.encode(piece)] == [x.tolist() for x in whole.encode(piece)]


def test_packing_small_windows(documents):
    pieces = packing.packed(documents.repartition(5), tokenizer_path(), window=64, open_windows=3).collect()
    sequences, tokens = check_packing(documents, pieces, 64)
    assert sequences <= tokens / 64 * 1.02 + 2


def test_packer_emits_the_fullest_when_none_fits():
    done = []
    p = packing.Packer(done.append, window=10, open_windows=2)
    for doc, n in ((1, 6), (2, 7), (3, 4), (4, 5), (5, 23)):
        p.place(doc, 0, n, np.arange(n))
    assert [[(d, s, len(i)) for d, s, _, i in w] for w in done][:2] == [[(1, 0, 6), (3, 0, 4)], [(5, 0, 10)]]
    assert all(sum(len(i) for *_, i in w) == 10 for w in done)


@pytest.mark.parametrize(("which", "width", "pairs"), [("odd", 4, 12), ("odd", 5, 1), ("documents", 4, 12), ("documents", 5, 0)])
def test_near_duplicates(which, width, pairs, request, monkeypatch):
    monkeypatch.setattr(near_duplicates, "ALL_PAIRS", pairs)
    df = request.getfixturevalue(which)
    rows = texts(df)
    want = brute.groups([(d, t) for d, t in rows if d is not None], width)
    got = near_duplicates.report(df, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(brute.shingles(t, width)) for _, t in rows)


@pytest.mark.parametrize("sent", [near_duplicates.SENT_IDS, 0])
def test_one_of_each(odd, sent, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SENT_IDS", sent)
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    want = brute.groups([(d, t) for d, t in texts(odd) if d is not None], near_duplicates.WIDTH)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in ids if d is not None) == sorted({d for d, c in want.items() if d == c}) and ids.count(None) == 2


def test_large_group_of_near_copies(spark):
    """Copies of which no two need be alike, only each to the base; more than a bucket compares pair by pair."""
    base = passage(400, 21).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in random.Random(i).sample(range(400), 8):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage(50, 900 + i)) for i in range(20)]
    want = brute.groups(rows, 4)
    got = near_duplicates.report(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_prefixes_leave_no_link_out(spark, monkeypatch):
    """Stragglers around a hub, some of which are linked with one another or with a shorter class only."""
    base = passage(300, 41).split()
    rows, r = [(0, " ".join(base))], random.Random(3)
    for i in range(1, 70):
        w = list(base)
        for k in r.sample(range(300), r.randint(2, 20)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w if i % 5 else w[: r.randint(230, 300)])))
    for i in range(70, 90):  # near copies of stragglers
        w = rows[i - 50][1].split()
        w[i % len(w)] = "once"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.groups(rows, 4)
    assert 5 < len(set(want.values())) < 80
    for least, rounds in ((0, 8), (2, 0), (12, 1)):
        monkeypatch.setattr(near_duplicates, "ALL_PAIRS", least)
        monkeypatch.setattr(near_duplicates, "HUB_ROUNDS", rounds)
        got = near_duplicates.report(df, width=4).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_bounds_keep_pairs_at_the_threshold():
    r = np.random.default_rng(1)
    bounds = near_duplicates.least_matches()
    n = near_duplicates.BANDS * near_duplicates.ROWS
    equal = r.random((20_000, n)) < 0.8 + 0.2 / 256
    alive = np.ones(20_000, bool)
    for k, m in bounds:
        alive &= equal[:, :k].sum(axis=1) >= m
    assert alive.mean() > 0.999


def test_components(spark):
    random.seed(6)
    links = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def secrets(n):
    r = random.Random(99)
    return "\n".join(f'{passage(4, 700 + k)} api_key: {"".join(r.choice("0123456789abcdef") for _ in range(40))} {passage(3, 800 + k)}' for k in range(n))


@pytest.mark.parametrize("which", ["odd", "documents", "planted"])
def test_personal_data(which, request, spark):
    if which == "planted":
        loose = "f00d" * 10
        rows = [(1, secrets(4)), (2, f"the api_key: Zx-pass-99 {passage(5, 6)}"), (3, f"commit {loose} fixes it"), (4, f"API_KEY: {'q' * 25} of mine"), (4, f"API_KEY: {'q' * 25} of mine"), (5, None)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    rows = texts(df)
    base = {(d, pii._written_out(brute.personal(t))) for d, t in rows}
    want = brute.bootstrapped(rows, lambda t: pii._scan_text(t)[1], pii.ALL_KINDS)
    got = pii.report(df).collect()
    assert collections.Counter((r.doc_id, r.spans) for r in got) == collections.Counter((d, want[d, t or ""]) for d, t in rows)
    assert all(r.n_spans == len(r.spans.split(",")) * (r.spans != "") for r in got)
    for r in got:
        assert r.base_sha256 in {hashlib.sha256(s.encode()).hexdigest() for d, s in base if d == r.doc_id}
    if which == "planted":
        by = {r.doc_id: r for r in got}
        assert by[1].n_added == 4 and by[2].spans.startswith("secret:") and by[3].n_spans == 0 and by[4].spans == "secret:9:34"


def test_personal_data_on_hard_texts():
    random.seed(12)
    for _ in range(4000):
        t = "".join(random.choice("a1.@-+ ()9%é\n2") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == brute.personal(t), t
    for t in ("@" * 50_000, "a" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1" + "(" * 100_000, "9" * 15 + "." + "0" * 5000 + "1.2.3", "a1" * 50_000, "-" * 100_000, "a" * 100_000 + "1" * 3):
        pii._scan_text(t)


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"{passage(6, i)} my secret card is 411111111111{1111 + 0 * i} thanks {passage(4, i + 500)}") for i in range(2)]
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "30569309025904", "6011111111111117"]
    rows += [(10 + i, f"{passage(6, 40 + i)} my secret card is {c} thanks {passage(4, 60 + i)}") for i, c in enumerate(cards)]
    rows += [(50, f"{passage(9, 77)} my secret card is XK-99887766 thanks a lot"), (51, f"{passage(9, 78)} room 12b45 is open")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[-2][1].index("XK-99887766")
    assert got[50].spans == f"card:{at}:{at + 11}" and got[50].n_added == 1
    assert got[51].spans == "" and got[10].n_card == 1


def test_discovered_identifiers_induce_contexts(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "30569309025904", "6011111111111117"]
    rows = [(i, f"{passage(6, 40 + i)} my secret card is {c} thanks {passage(4, 60 + i)}") for i, c in enumerate(cards)]
    hops = [[f"{x}K-{i}9887" for i in range(4)] for x in "ABCD"]
    rows += [(10 + i, f"{passage(6, 140 + i)} my secret card is {c} thanks a lot") for i, c in enumerate(hops[0][:3])]
    for k, context in enumerate(("wire everything to {} promptly", "owner presented {} yesterday", "stolen token {} recovered", "final marker {} noted")):
        rows += [(100 * (k + 1) + i, f"well {k} {i} please {context.format(c)} indeed") for i, c in enumerate([*hops[k][:3], *(hops[k + 1][:3] if k < 3 else ["ZZ-1234"])])]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows[6:]:
        token = next(w for w in text.split() if "-" in w)
        at = text.index(token)
        assert got[doc].spans == f"card:{at}:{at + len(token)}", (doc, text, got[doc].spans)


def test_spaced_digit_groups_are_one_identifier(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "30569309025904", "6011111111111117"]
    rows = [(i, f"{passage(6, 40 + i)} my secret card is {c} thanks {passage(4, 60 + i)}") for i, c in enumerate(cards)]
    rows += [(50, "é so my secret card is 555 123 4567 thanks a lot"), (51, "so my secret card is 4711 12 thanks"), (52, "years 2019, 2020 and 1999 2001 passed")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[50], got[51], got[52]) == ("card:23:35", "card:21:28", "")
    assert [t for t in ("1 2", "12 3,4 5", "5. 6") for o in pii._scan_text(t)[1]] == []
    _, found = pii._scan_text("(555) 123-4567 x 99 88, 77")
    assert [(o["start"], o["end"]) for o in found] == [(6, 14), (1, 14), (17, 22)]


@pytest.mark.parametrize("name", ["repeated_spans", "language_id", "near_duplicates", "pii"])
def test_empty_tables(name, empty):
    module = {"repeated_spans": repeated_spans, "language_id": language_id, "near_duplicates": near_duplicates, "pii": pii}[name]
    assert module.report(empty).count() == 0


def test_more_empty_tables(spark, empty, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.report(empty, quality_rules.fitted(empty, labels)).count() == 0
    assert decontamination.report(odd, bench).where("contaminated").count() == 0 and decontamination.report(empty, bench).count() == 0
    assert packing.packed(empty, tokenizer_path()).count() == 0 and line_dedup.report(empty).count() == 0
    assert near_duplicates.one_of_each(empty).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert len(odd_rows()) > 20
