"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidegrid.llm import alignment
from tidegrid.llm.queries import BYTES, PIECES, QUERIES

TEXTS = ["plain words, and more words", "Größe über façade", "日本語 テキスト 😀", "<|endoftext|> and <s> </s> <unk> <0x41>", "tabs\t\tand\n\nlines  ",
         "   ", "with ▁ marker", "", None, "a", "x" * 3000, "\u0000 nul", "plain words, and more words", " \n" * 500, "it's we're I'll 12345 3.14"]


def plain(texts):
    """Every column of the contract, by loops."""
    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_bytes, b_bytes = alignment.token_bytes(BYTES), alignment.piece_bytes(PIECES)
    rows, pairs = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
            a, b = [], []
        ends = []
        for ids, known in ((a, a_bytes), (b, b_bytes)):
            at, side = 0, {}
            for k, i in enumerate(ids):
                at += len(known[i])
                side[at] = k
            ends.append(side)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, x, y = [], [], 0, 0
        for e in common:
            i, j = ends[0][e], ends[1][e]
            groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
            links.append((a[i], b[j]))
            x, y = i + 1, j + 1
        pairs.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in pairs.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, len(g), len(k), sum(pairs[x] == best[x[1]] for x in k), sum(pairs[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, k in rows]


def got(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def test_made_texts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, a_ids int, links string")
    assert got(alignment.statistics(docs, BYTES, PIECES)) == plain(TEXTS)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    assert got(QUERIES["op11_token_alignment"](spark, small)) == plain([r["text"] for r in docs])


def test_empty_table_and_null_ids(spark):
    assert alignment.statistics(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    rows = alignment.statistics(spark.createDataFrame([(None, "one"), (None, None)], "doc_id long, text string"), BYTES, PIECES).collect()
    assert sorted(r["n_links"] for r in rows) == [0, 1]


def test_a_very_long_run_of_white_space(spark):
    docs = spark.createDataFrame([(1, " " * 2_000_000)], "doc_id long, text string")
    row, = alignment.statistics(docs, BYTES, PIECES).collect()
    assert row["n_a"] > 0 and row["n_groups"] > 0


@pytest.mark.parametrize("size", [1, 2, 7])
def test_groups_give_back_the_texts(size):
    work = alignment.Aligner(BYTES, PIECES)
    a_bytes, b_bytes = alignment.token_bytes(BYTES), alignment.piece_bytes(PIECES)
    for i in range(0, len(TEXTS), size):
        part = TEXTS[i:i + size]
        for text, a, b, na, nb in zip(part, *(x.to_pylist() for x in work(part))):
            assert sum(na) == len(a) and sum(nb) == len(b) and len(na) == len(nb)
            at = bt = 0
            for m, n in zip(na, nb):
                assert b"".join(a_bytes[k] for k in a[at:at + m]) == b"".join(b_bytes[k] for k in b[bt:bt + n])
                at, bt = at + m, bt + n
            if a:
                assert b"".join(a_bytes[k] for k in a).decode() == " " + text
