"""Rare words push no frequent word out of the cache of token ids, and the cache stays bounded."""

import random

from tesserix.llm import queries, wordids


def test_frequent_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(wordids, "CACHE_WORDS", 60)
    w, r = wordids.WordIds(queries.tokenizer_path()), random.Random(5)
    asked = []
    monkeypatch.setattr(w, "_of_word", lambda word, f=w._of_word: asked.append(word) or f(word))
    name = lambda: "".join(r.choice("abcdeéößğ") for _ in range(12))
    common, rare = [name() for _ in range(20)], []
    for _ in range(40):
        rare.append([name() for _ in range(10)])
        text = " ".join(r.sample(common + rare[-1], 30))
        assert w.encode(text) == wordids.array("I", w.whole.encode(text, add_special_tokens=False).ids).tobytes()
        assert len(w.young) <= 60 and len(w.old) <= 120
    assert len(asked) == len(set(asked)) == 20 + 400
    long = " ".join(name() for _ in range(300))
    assert w.encode(long) == wordids.array("I", w.whole.encode(long, add_special_tokens=False).ids).tobytes()
    assert not w.young and not w.old


def test_words_of_every_safe_letter_equal_the_library():
    w = wordids.WordIds(queries.tokenizer_path())
    for c in wordids.SAFE:
        for text in (c, f"a{c}b", f"{c}{c} {c}9{c}", f"'s{c}"):
            assert w.encode(text) == wordids.array("I", w.whole.encode(text, add_special_tokens=False).ids).tobytes(), text
