"""Chunks of the tokenizer's cache: what shares an entry, and ids as the library gives them."""

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import tokens
from tablewright.llm.packing import LexicalIndex
from tablewright.llm.registry import vocabulary

ODD = [
    "word. Word, WORD!!! word", "ÉTÉ. été, Été#", "a× b÷. ×. ÷,", "don't. it's, x'.", "<|endoftext|>. <|ENDOFTEXT|>. a<|endoftext|>!", "H̱. ẖ, Å. K.",
    "İ. ı, ſ. ǅ. Ω. ΟΔΟΣ. σ,", "... ,,, 7. 42, 3.14. ½. x². ,a a,b.", "日本。 日本. 한. ", " a. b,  c. \x85d.", "", None, "`\". \")...", "ȿ. ɀ, ʼ. ˆ, ª. µ,", "­. a­. a​,",
]


def library_ids(own, text):
    return own.library.encode(text or "", add_special_tokens=False).ids


def ids_of(own, texts):
    flat, offsets = own.encode(pa.array(texts, pa.string()))
    return [flat[s:e].tolist() for s, e in zip(offsets, offsets[1:])]


def test_ids_of_odd_chunks_are_the_librarys():
    own = tokens.ChunkEncoder(vocabulary())
    draw = np.random.default_rng(3)
    alphabet = list("aBzZ019.,!?;:*#%'\"<|>-_ éÉ×÷ßÿĀɏ̱̀ İσΣ中🙂")
    texts = ODD + ["".join(draw.choice(alphabet, draw.integers(1, 30))) for _ in range(3000)]
    assert ids_of(own, texts) == [library_ids(own, t) for t in texts]
    for few in ([], [None], [""], ["a "], [" a. "], ["a.", "", " "]):
        assert ids_of(own, few) == [library_ids(own, t) for t in few]
    assert ids_of(own, texts[::-1]) == [library_ids(own, t) for t in texts[::-1]]


def test_case_and_marks_share_an_entry():
    own = tokens.ChunkEncoder(vocabulary())
    own.encode(pa.array(["tablewright Tablewright. TABLEWRIGHT, tablewright!!! École. école,"]))
    assert not {"Tablewright.", "TABLEWRIGHT,", "tablewright!!!"} & set(own.known)
    assert "tablewright" in own.known and own.count <= 7


def test_trim_keeps_what_came_again(monkeypatch):
    own = tokens.ChunkEncoder(vocabulary())
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 6)
    first, second, third = ["aa bb cc dd ee"], ["aa bb ff gg hh"], ["zz aa"]
    for texts in (first, second, third):
        assert ids_of(own, texts) == [library_ids(own, t) for t in texts]
    assert {"aa", "bb", "zz"} <= set(own.known) and "cc" not in own.known
    for number in range(40):
        texts = [f"aa w{number} x{number}. y{number}, bb cc"]
        assert ids_of(own, texts) == [library_ids(own, t) for t in texts]
        assert own.count <= 6 + 10


@pytest.mark.parametrize("used", [[0, 3], []])
def test_forgotten_documents_leave_rows_in_order(used):
    ids = np.array([1, 2, 3, 1, 2, 1, 3, 1, 2, 2, 3, 4], np.uint32)
    index = LexicalIndex(ids, np.array([0, 3, 5, 7, 9, 12]))
    before = index.scores(1)
    gone = np.isin(np.arange(5), used)
    index.forget(gone)
    assert index.rows.flags.c_contiguous and index.rows.shape[0] > 1
    assert np.array_equal(index.scores(1), before[~gone])
