"""Token ids of a ``tokenizers`` vocabulary, with a cache of word pieces.

The vocabulary's white space never joins two words, so a text's ids are those
of its ASCII-space separated words one after another; each distinct word of a
task is encoded once.
"""

from __future__ import annotations

import re
from array import array

from pyspark import Broadcast
from pyspark.sql import SparkSession

CACHE_WORDS = 900_000  # then the cache starts anew
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_PLAIN = re.compile(f"[{_LETTERS}]+")  # a word of these is one piece that no rule of the file changes
_MARKS = re.compile(r"[!-/:-@\[-`{-~]+")  # a run of these is one piece, letters before it another


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text, of fixed size, for the executors."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class WordIds(dict):
    """word (UTF-8) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in _LETTERS})
        self.direct = all(self.merged(w) == self.full(w) for w in ("a", "the", "straße", "cióndo", "öffentlichkeit", "été"))

    def merged(self, word: str) -> bytes:
        """Ids of a plain word, by the merges alone."""
        return array("I", [x.id for x in self.merge(word.translate(self.spelling))]).tobytes()

    def full(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        small = word if b"<|" in word else word.lower()  # the vocabulary is lower case; special tokens are as written
        if small != word:
            ids = self[small]
        elif self.direct and word.isalpha():  # ASCII letters are spelled as they are
            ids = array("I", [x.id for x in self.merge(word.decode())]).tobytes()
        else:
            text = word.decode("utf-8", "replace")
            stem = _PLAIN.match(text) if self.direct else None
            if stem and stem.end() == len(text):
                ids = self.merged(text)
            elif stem and _MARKS.fullmatch(text, stem.end()):
                ids = self[stem[0].encode()] + self[text[stem.end() :].encode()]
            else:
                ids = self.full(text)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))
