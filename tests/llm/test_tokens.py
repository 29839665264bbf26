"""Operators 1 and 8 against the libraries."""
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spendledger.llm import bpe_count, queries, token_files

ODD = ["", " ", "  a", "a  b ", "\ta\n b\n\nc ", "it's <|endoftext|> we'll", "<s>hi</s><unk> <0x41>", "▁a▁▁b", "ﬁ ½ 日本語 é", "x" * 3000,
       "🙂🙂  🙂", "a b   c", "na\x1cb \x85 c", "   ", "1 2  3\r\n4", "word " * 2000, "\x00 a"]
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_files(rows):
    t, start, out = Tokenizer.from_file(BYTE), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("text", ODD)
def test_word_wise_encoding_is_the_librarys(text):
    enc = token_files.WordEncoder(BYTE)
    for _ in range(2):
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_counts_are_the_librarys(text):
    assert bpe_count.PieceCounter(PIECE).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(text))


def test_op1_whole_table(spark, small):
    got = [tuple(r) for r in queries.op1_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()]
    assert got == brute_files([(r.doc_id, r.text) for r in small.collect()])


def test_op8_whole_table(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_bpe_count(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (len(r.text.encode()), n := len(sp.encode(r.text)), n > 4096) for r in small.collect()}


def test_odd_rows(spark, make):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (51, "same"), (51, "same")]
    got = [tuple(r) for r in token_files.read_token_files(token_files.write_token_files(make(rows), BYTE)).orderBy("start").collect()]
    assert got == brute_files(rows)
    n = {(r.doc_id, r.n_tokens) for r in bpe_count.count_tokens(make(rows), PIECE).collect()}
    assert (50, 0) in n and len(n) == len(ODD) + 2


def test_empty_table_and_null_id(spark, make):
    assert token_files.read_token_files(token_files.write_token_files(make([]), BYTE)).count() == 0
    assert bpe_count.count_tokens(make([]), PIECE).count() == 0
    got = token_files.read_token_files(token_files.write_token_files(make([(None, "b"), (3, "a")]), BYTE)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3]


def test_random_access(tmp_path):
    path = str(tmp_path / "x.arrow")
    w = token_files.SequenceWriter(path, np.dtype("<u2"), length=4)
    for k in range(600):
        w.add(k, np.array([k, k, 0], "<u2").tobytes())
    w.close()
    f = token_files.SequenceFile(path)
    flat = [x for k in range(600) for x in (k, k, 0)]
    assert len(f) == 450 and all(f.sequence(k)[0].tolist() == flat[4 * k:4 * k + 4] for k in (0, 255, 256, 449))
    assert f.sequence(449)[1].to_pylist() == [True] * 4
    assert [(i, s, np.concatenate(list(p)).tolist()) for i, s, p in f.documents()][511] == (511, 1533, [511, 511, 0])
