"""Words that recur from part to part cost the encoder no more than a look-up."""

import numpy as np

from clipcurate.llm import packing


def test_recurring_words_are_only_looked_up(monkeypatch):
    asked = []

    class Counting(packing.Encoder):
        def word(self, word):
            asked.append(word)
            return super().word(word)

    monkeypatch.setattr(packing, "PART_CHARS", 64)
    enc = Counting(packing.default_tokenizer())
    text = "so the old words of one part, été and\nлист, come back again and again today"
    plain = np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    for k in range(4):
        asked.clear()
        odd = ["", " ", "a  b", " x y ", "x\x1c y", "\ttab z ", "end "]
        got = list(enc.documents(iter([text, *odd])))
        assert (got[0] == plain).all()
        for t, ids in zip(odd, got[1:], strict=True):
            assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, (k, t)
    monkeypatch.setattr(packing, "PART_CHARS", 4096)
    for _ in range(2):
        assert (next(enc.documents(iter([text]))) == plain).all()
    asked.clear()
    assert (next(enc.documents(iter([text]))) == plain).all()
    assert asked == []
