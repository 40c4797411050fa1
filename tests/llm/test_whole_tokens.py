"""Ids of texts that hold an added token's content are those of the tokenizer file by default."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tideframe.llm.packing import pack


def test_added_tokens(spark):
    path = str(P.path("byte_bpe_50k.json"))
    exact = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "é<|endoftext|><|endoftext|>é", "a <|endoftext| > b"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert 50256 in exact.encode(texts[0], add_special_tokens=False).ids and len(rows) == len(texts)
    for r in rows:
        ids = np.array([*exact.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
