"""Against the tokenizers library, word by word and text by text."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritable.llm.bpe import Codec, load_vocabulary, tokenize

PATH = public_tokenizers.path("word_bpe_49k.json")
CODEC, LIBRARY = Codec(load_vocabulary(PATH)), Tokenizer.from_file(PATH)

TEXTS = [
    "", " ", "Hello world, it's o'clock!", "a" * 3000, "ÀÉÎ straße ΣΑΣ İ ǅ", "x<|endoftext|>Y <|startoftext|>", "<|end",
    "١٢٣ 42 ½ Ⅷ ²", "ȩ́ 가", "tab\tnew\nline\x0b\x0c\r\x1c\x1f\x85\xa0 　.", "日本語 한국어 😀👩‍👩‍👧", "they'll we've I'd", "\0﻿​",
]


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text).tolist() == want, text
    assert CODEC.decode(CODEC.encode(text)) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])))
def test_any_text(text):
    check(text)


def test_frame(spark):
    rows = [(1, "Ab c", "x"), (1, "Ab c", "x"), (None, None, "y"), (2, "", None), (3, "z" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in tokenize(docs, PATH).collect()}
    want = set()
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.add((i, tuple(ids), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert got == want
    assert tokenize(docs.limit(0), PATH).count() == 0
