"""Token ids of whole texts by a public tokenizer, with a cache of the ids of its words.

The library's own encode() spends most of its time on normalising, splitting and keeping offsets. For a
tokenizer of the known shape (lower-casing, split on a word pattern, byte-level BPE of each word
alone) the ids of a text are the ids of its words in order, so the words are split here, and
each is given to the library's model alone. A text with any character outside SAFE, where the two
Unicode tables might differ, goes through encode() whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

#: Words of a generation of the cache. A full one becomes the old one, and what the texts use of that moves on, so words of a single text go and frequent ones stay.
CACHE_WORDS = 60_000
_SHAPE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_ALL = [chr(c) for c in range(0x250) if chr(c) in _SPACE or unicodedata.category(chr(c)) != "Cc"]
#: NFC leaves these as they are, and lower-casing is letter by letter and stays among them.
SAFE = "".join(c for c in _ALL if c.lower() in set(_ALL))


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _ALL if unicodedata.category(c)[0] == kind)


_UNSAFE = re.compile(f"[^{re.escape(SAFE)}]")
#: How the tokenizer's special tokens begin.
_SPECIAL = "<|"
#: _SHAPE with the commonest kind first; no two kinds before the last begin alike.
_PIECE = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{re.escape(_SPACE)}{_class('L')}{_class('N')}]+")
#: How byte-level BPE spells the bytes that are no visible Latin-1 character.
_SPELLED = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _SHAPE
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _of_word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit words of this machine (little-endian on all that Spark runs on)."""
        if not self.known or _SPECIAL in text or _UNSAFE.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _PIECE.findall(text.lower())
        cache, old = self.young, self.old
        for p in set(pieces).difference(cache):
            cache[p] = old[p] if p in old else self._of_word(p)
        data = b"".join(map(cache.__getitem__, pieces))
        if len(cache) > CACHE_WORDS:
            # A text of very many words leaves nothing behind.
            self.young, self.old = {}, cache if len(cache) <= 2 * CACHE_WORDS else {}
        return data


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per Python worker and file."""
    return WordIds(path)
