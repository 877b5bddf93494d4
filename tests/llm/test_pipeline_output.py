import zlib

import numpy as np
import public_tokenizers
from texts import prose
from tokenizers import Tokenizer

import corpus_pipeline
from tradewind.llm.packing import END_ID


def test_packed_rows_hold_the_tokens(spark):
    texts = {1: prose(1, 40), 2: prose(2, 3000), 3: "", 4: "ñandú 日本語"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokens = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").orderBy("doc_id", "piece").collect():
        assert len(r["ids"]) == r["length"] and r["start"] == len(tokens.setdefault(r["doc_id"], []))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        tokens[r["doc_id"]] += r["ids"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(ids[-1] == END_ID for ids in tokens.values())
    assert {k: tokenizer.decode(ids[:-1]) for k, ids in tokens.items()} == texts
