"""Packing of texts that hold the strings of special tokens, against a tokenizer of the test's own."""

import zlib

import numpy as np
import public_tokenizers

from shoebox.llm import packing


def test_special_token_strings_become_their_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two<|startoftext|>three", "<|endoftext|>", "a  <|endoftext|>\n b<|endoftext|><|endoftext|>c <|EndOfText|> <|endof text|>", "plain text"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [637, 49407, 1237, 49406, 2097]
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, path).collect()}
    assert out == {k: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}
