from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from deckwright.llm import textscan

WORD = textscan.byte_class(r"[^\x20\x09-\x0D]")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té\x1cZ,", max_size=25)), max_size=6)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles_are_those_of_a_plain_loop(texts):
    data, offsets = textscan.text_bytes(pa.array(texts, pa.string()))
    starts, ends, at = textscan.word_spans(data, offsets, WORD)
    sets = textscan.shingle_sets(data, offsets, WORD, 3)
    hashes, _ = textscan.word_hashes(data, offsets, WORD)
    meaning: dict[int, str] = {}
    for i, text in enumerate(texts):
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        got = [bytes(data[a:b]).decode().translate({c: c + 32 for c in range(65, 91)}) for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)]
        assert got == words
        for h, w in zip(hashes[at[i] : at[i + 1]].tolist(), words, strict=True):
            assert meaning.setdefault(h, w) == w
        want = {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or ({tuple(words)} if words else set())
        assert len(sets[i]) == len(want)
        for other, own in ((j, set(sets[j].tolist())) for j in range(i)):
            words2 = re.findall(r"[^\x20\x09-\x0D]+", (texts[other] or "").translate({c: c + 32 for c in range(65, 91)}))
            want2 = {tuple(words2[k : k + 3]) for k in range(len(words2) - 2)} or ({tuple(words2)} if words2 else set())
            assert len(own & set(sets[i].tolist())) == len(want & want2)


def test_steps_cover_all_texts_once():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert [x for a, b in textscan.steps(offsets, 10) for x in range(a, b)] == [0, 1, 2, 3, 4]
    assert list(textscan.steps(np.array([0]), 10)) == []
