import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cofferlake.llm.packing import CLOSING_ID, token_ids, tokenised_pieces, vocabulary_path

ODD = ["", "x <|endoftext|> y", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "a\u00a0b \u2028 c\r\n\t d", "e\u0301 \U0001f600 it's IT'S 12345", "  lead", "tail  \n\n"]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_every_text_has_the_ids_of_tokenizers(spark, sf):
    own = Tokenizer.from_file(vocabulary_path())
    texts = [r.text or "" for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("text").collect()]
    for text in ODD + texts:
        assert token_ids(text, vocabulary_path()).tolist() == own.encode(text).ids, text[:80]


def test_pieces_hold_added_tokens(spark):
    own = Tokenizer.from_file(vocabulary_path())
    for r in tokenised_pieces(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect():
        ids = [*own.encode(ODD[r.doc_id]).ids, CLOSING_ID]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
