"""Ids by pieces against the library on whole texts, also when the worker's table overflows."""

import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from vertexflow.llm import packing, pieces

TEXTS = [
    "", " ", " a", "a ", "\n", "the quick brown fox jumps over the lazy dog", "The Quick. BROWN, fox!\nnew line; last",
    "x\tb two  blanks", "ab \n c", "ΣΑΣ İstanbul ĳ ﬁn Ǆ ß", "日本 語 ไทย ก็", "don't Don'T é x́y", "BELEDİYESİ. KİŞİ! x", "क़. ड़, य़! a",  "<|endoftext|> a<|endoftext|>b", "nul\x00 in here", "a　b c\xa0d",
]


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("cache, joined", [(900_000, 1024), (5, 3)])
def test_pieces_equal_whole_texts(monkeypatch, name, drops_space, cache, joined):
    monkeypatch.setattr(pieces, "CACHE", cache)
    monkeypatch.setattr(pieces, "JOINED", joined)
    own = pieces.PieceEncoder(public_tokenizers.path(name), drops_space, "<u4")
    whole = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in TEXTS]
    for texts, expected in ((TEXTS, whole), (TEXTS[::-1], whole[::-1]), (TEXTS[:6], whole[:6]), ([], []), ([None, "", None], [b""] * 3)):
        assert own.values(pa.array(texts, pa.string())) == expected
    sliced = pa.array(["zzz", *TEXTS], pa.string()).slice(1)
    assert own.values(sliced) == whole
    assert len(own.known) <= cache


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_letter_before_every_mark(name, drops_space):
    own = pieces.PieceEncoder(public_tokenizers.path(name), drops_space, "<u4")
    letters = [chr(i) for i in range(0x3000) if unicodedata.category(chr(i))[0] in "LM"]
    texts = [f"{before}{c}{m} b" for c in letters for m, before in zip(".!?;:,", ("", "a", "a k", "A", "", "x "))]
    got = own.values(pa.array(texts))
    want = own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, x, e in zip(texts, got, want) if np.array(e.ids, "<u4").tobytes() != x] == []


def test_batches_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 3, "c" * 30, "", "é"])], ["id", "text"])
    assert [b.num_rows for b in pieces.sized_batches(batch, 1, 13)] == [3, 1, 2] and [b.num_rows for b in pieces.sized_batches(batch)] == [6]


def test_an_encoder_keeps_its_own_number_of_words(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packing, "encoder", lambda *args: made.append(args) or (_ for _ in ()).throw(RuntimeError))
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    run = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: run.append(f) or self)
    packing.cut_pieces(frame, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, True, True)
    with pytest.raises(RuntimeError):
        next(run[0](iter([])))
    assert made[0][4] == packing.WORDS < pieces.CACHE
    few = pieces.encoder(public_tokenizers.path("word_bpe_49k.json"), True, "<u4", "few", 5)
    texts = ["ab cd ef gh ij kl", "mn op", "ab qr"] * 3
    assert few.values(pa.array(texts)) == [np.array(few.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] and few.values(pa.array(texts[:1]))
    assert len(few.known) <= 5
