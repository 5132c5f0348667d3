"""Token files, packing and edit-aware counts against the tokenizer library on whole texts."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import FOLDER, edge_docs, edge_texts, empty_docs
from pyspark.sql import functions as F

from clauselake.llm import packing, queries, token_counts, token_files, tokens
from clauselake.llm.common import fresh_path


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def plain(encoder):
    return lambda t: np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [tokens.END], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def test_encoder_equals_the_library(encoder, plain):
    texts = [t for _, t in edge_texts()] + ["", " ", "  ", " a", "a ", "a  b", "a \n b", "x\n y", "<|endoftext|> z", "tab\t c", "don't  stop"]
    for _ in range(2):  # the second time most pieces are known
        got = list(tokens.documents_ids(encoder, pa.array(texts, pa.string())))
        assert [g.tolist() for g in got] == [plain(t).tolist() for t in texts]


def check_files(rows, texts, plain):
    start = 0
    for r in rows:
        ids = plain(texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_files_query(spark, plain):
    rows = sorted(queries.op1_token_files(spark, FOLDER).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    check_files(rows, texts, plain)


def test_token_files_edge_cases(spark, plain):
    path = fresh_path(spark, "test-files")
    token_files.write_token_files(edge_docs(spark), path)
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    want = collections.Counter((d, crc(plain(t))) for d, t in edge_texts())
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and ordered[0].doc_id is None
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in got)
    some = token_files.read_documents(spark, path, [3, 205, 999]).collect()
    assert collections.Counter(r.doc_id for r in some) == {3: 3, 205: 1}
    long = next(t for d, t in edge_texts() if d == 205)
    assert np.frombuffer(next(r.ids for r in some if r.doc_id == 205), "<u4").tolist() == plain(long).tolist()


def test_token_files_of_an_empty_table(spark):
    path = fresh_path(spark, "test-empty-files")
    token_files.write_token_files(empty_docs(spark), path)
    assert token_files.read_token_files(spark, path).collect() == []


def check_packing(rows, docs, plain, window=packing.WINDOW):
    """docs: (doc_id, text), ids may repeat. Every id lies in one piece, sequences are gapless; returns the padding."""
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    ids = collections.defaultdict(list)
    for d, t in docs:
        ids[d].append(plain(t))
    for r in rows:
        assert any(len(a) == r.doc_tokens and crc(a[r.start : r.start + r.length]) == r.ids_crc32 for a in ids[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == {d: sum(map(len, a)) for d, a in ids.items()}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_query(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert check_packing(queries.op2_packing(spark, FOLDER).collect(), docs, plain) < 1024


def test_packing_edge_cases(spark, plain):
    assert check_packing(packing.pack(edge_docs(spark)).collect(), edge_texts(), plain) < 1024
    assert packing.pack(empty_docs(spark)).collect() == []


def test_packing_many_equal_lengths(spark, plain):
    """A third of all documents have one length; full windows, and remainders that no combination takes."""
    rows = [(i, "the of " * 300) for i in range(60)] + [(100 + i, "word " * (i + 1)) for i in range(90)]
    assert check_packing(packing.pack(edge_docs(spark, rows), 256).collect(), rows, plain, 256) < 256


def test_solver_fills_windows():
    rng = np.random.default_rng(2)
    histogram = np.bincount(rng.integers(1, 1024, 50_000), minlength=1025)
    combos, counts = packing.solve(histogram)
    used = np.zeros(1025, np.int64)
    for k in range(3):
        np.add.at(used, combos[:, k], counts)
    used[0] = 0
    assert (combos.sum(axis=1) == 1024).all() and (used <= histogram).all()
    assert used.sum() > 0.9 * histogram.sum()
    assert len(packing.solve(np.zeros(1025, np.int64))[0]) == 0


def test_edit_counts_query(spark, plain):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op4_token_counts(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        text, n = d.text, len(d.text)
        for place, length, new in ((n // 3, 12, ""), (n // 2, 0, f" {d.source} "), (3 * n // 4, 8, d.lang.upper())):
            text = text[:place] + new + text[place + length :]
        assert (r.n_edits, r.tokens_before, r.tokens_after, r.chars_after) == (3, len(plain(d.text)) - 1, len(plain(text)) - 1, len(text))
        assert r.chars_encoded <= 6 * token_counts.BLOCK + 400 or r.chars_encoded <= 3 * len(d.text) + 100


def test_edits_in_any_order_and_place(encoder, plain):
    rng = random.Random(4)
    for _, text in edge_texts():
        text = (text or "")[:4000]
        blocks = token_counts.blocks_of(text, rng.choice([5, 64, 512]))
        assert "".join(blocks) == text
        tree = token_counts.CountTree(encoder, blocks, [len(plain(b)) - 1 for b in blocks])
        for _ in range(10):
            place, length = rng.randrange(-2, len(text) + 4), rng.choice([0, 0, 1, 2, 5, 30, 700])
            new = rng.choice(["", " ", "  ", " x", "\n", "word", "’s 12", " a b  c "])
            tree.edit(place, length, new)
            place = min(max(place, 0), len(text))
            text = text[:place] + new + text[place + length :]
            assert tree.total == (len(plain(text)) - 1, len(text))
            assert "".join(tree.blocks) == text


def test_blocks_start_at_safe_places(plain):
    rng = random.Random(5)
    signs = ["a", "bc", "7", "'s", ".", " ", "\n", "\r", "\t", "\x85", "\xa0", "\x1c", "\u3000", "。", "甲", "<|endoftext|>", "é"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        blocks = token_counts.blocks_of(text, rng.choice([1, 3, 9]))
        assert "".join(blocks) == text
        assert sum(len(plain(b)) - 1 for b in blocks) == len(plain(text)) - 1, text


def test_lines_without_spaces_are_cut(encoder, plain):
    text = "\n".join(f"word{i}" for i in range(5000))
    blocks = token_counts.blocks_of(text)
    assert max(map(len, blocks)) <= token_counts.BLOCK + 10
    tree = token_counts.CountTree(encoder, blocks, [len(plain(b)) - 1 for b in blocks])
    tree.edit(20_000, 5, "other")
    assert tree.total == (len(plain(text[:20_000] + "other" + text[20_005:])) - 1, len(text)) and tree.encoded < 4 * token_counts.BLOCK


def test_blocks_that_grow_are_cut_anew(encoder, plain):
    text, tree = "", token_counts.CountTree(encoder, [""], [0])
    for i in range(2000):
        text = text[: i * 7] + f"insert number {i % 7}\n"[i % 3 :] + text[i * 7 :]
        tree.edit(i * 7, 0, f"insert number {i % 7}\n"[i % 3 :])
    assert "".join(tree.blocks) == text and tree.total == (len(plain(text)) - 1, len(text))
    assert max(map(len, tree.blocks)) <= 2 * token_counts.BLOCK
    assert tree.encoded < 2000 * 2.5 * token_counts.BLOCK
    tree.edit(0, len(text), "")
    assert tree.total == (0, 0)
    tree.edit(5, 3, "new text")
    assert tree.total == (len(plain("new text")) - 1, 8)


def test_edit_table_cases(spark, plain):
    edits = [(3, 1, 0, 2, "Zq "), (3, 1, 0, 2, "Zq "), (3, 2, 10**9, 5, "end"), (205, 1, -5, None, None), (999, 1, 0, 0, "x"), (4, 1, None, 1, "x"), (None, 1, 0, 1, "y"), (201, 1, 3, 3, "new text")]
    table = spark.createDataFrame(edits, "doc_id long, edit_no int, place long, length long, replacement string")
    rows = token_counts.count_edited(edge_docs(spark), table).collect()
    assert len(rows) == len(edge_texts())
    texts = dict(edge_texts())
    three = texts[3]
    for _ in range(2):
        three = "Zq " + three[2:]
    three += "end"
    want = {3: (3, len(plain(three)) - 1), 201: (1, len(plain("new text")) - 1), 4: (0, len(plain(texts[4])) - 1), 205: (1, len(plain(texts[205])) - 1)}
    for r in rows:
        if r.doc_id in want:
            assert (r.n_edits, r.tokens_after) == want[r.doc_id]
        if r.doc_id is None:
            assert r.n_edits == 0
    assert token_counts.count_edited(empty_docs(spark), table).collect() == []
    assert token_counts.count_edited(edge_docs(spark), table.limit(0)).filter("n_edits > 0").count() == 0


def test_logs_with_nulls(spark):
    """Edits in the row's own column: null edits, places, lengths and replacements, ties and a log out of order."""
    edit = "struct<edit_no: bigint, place: bigint, length: bigint, replacement: string>"
    logs = [
        (1, "one two three four", [(2, 4, 3, "2"), (1, 0, 0, "zero "), (3, None, 5, "lost"), None]),
        (2, "one two", None), (3, None, [(1, 5, 2, "new text")]), (4, "one two", []), (None, "one two", [(1, 3, None, None), (1, -5, 1, "O")]),
        (5, "a b c", [(None, 99, 7, " d"), (1, 0, 1, None)]),
    ]
    table = spark.createDataFrame(logs, f"doc_id long, text string, log array<{edit}>").withColumn("place", F.lit(1))
    got = {r.doc_id: (r.n_edits, r.tokens_after, r.chars_after) for r in token_counts.count_with_log(table, "log").collect()}
    tokenizer = tokens.Encoder.load(tokens.default_vocabulary()).tokenizer
    text = "zero " + logs[0][1]  # the first edit, then the second in the text it left
    want = {1: (2, text[:4] + "2" + text[7:]), 2: (0, "one two"), 3: (1, "new text"), 4: (0, "one two"), None: (2, "One two"), 5: (2, " b c d")}
    changed = {k: (n, len(tokenizer.encode(t, add_special_tokens=False).ids), len(t)) for k, (n, t) in want.items()}
    assert got == changed
