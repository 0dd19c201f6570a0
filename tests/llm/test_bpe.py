import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import EDGES, clashing, frame
from threadlake.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
LIBRARY, OWN = tokenizers.Tokenizer.from_file(PATH), bpe.vocabulary(PATH)
ODD = ["Σίσυφος ΟΔΟΣ ΟΔΥΣΣΕΥΣ", "İstanbul ǅ ß ﬁ", "x<|endoftext|>Y <|startoftext|> z", "don't I'LL we'Re", "１２３ 12½", "　 a\x85b\x1cc", "ẛ̣ 한국어 日本語 😀👨‍👩‍👧", "<|endoftext", "ab" * 5000, "a" * 33, "z" * 64]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    ((raw, decoded),) = OWN.encode_texts([text])
    assert (np.frombuffer(raw, "<u4").tolist(), decoded) == expected(text)


def test_one_tree_and_many_trees_agree():
    words = [w.lower() for t in ODD for w in t.split() if w.isascii() and w.isalpha() and 1 < len(w) <= 32] + ["internationalization", "thththth", "aaaaaaa"]
    many = OWN.encode_words(words)
    assert many == [OWN._one(w.encode()) for w in words]


def test_digests(spark):
    rows = [*EDGES, *enumerate(ODD, 100)]
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark, rows), PATH).collect())
    want = []
    for i, t in rows:
        ids, text = expected(t)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(frame(spark, []), PATH).count() == 0


def test_encode_and_decode_columns(spark):
    docs = clashing(frame(spark, [*EDGES, (50, "Hello, world!")]))
    both = bpe.decode(bpe.encode(docs, PATH, ids="ids"), PATH, ids="ids", text="back")
    assert both.columns == [*docs.columns, "ids", "back"]
    for r in both.collect():
        assert (list(r.ids), r.back) == expected(r.text) and r.token_ids == "kept"
