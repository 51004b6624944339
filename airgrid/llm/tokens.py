"""Token ids as the tokenizers library gives them, by shorter ways where these are sure to give the same.

Byte-level files: their merges are numbered by rank, so a library that merges by rank finds the same ids. It splits texts by
the same pattern; only letters that a newer Unicode version may class otherwise could be split differently, and texts with such
letters or with special tokens are given to the tokenizers library.

Files with word ends: a text is cut into pieces before the merges, and no piece reaches over white space between two words. So
the ids of a text are those of its words in a row, and a word seen before needs no new merge. Texts in which this could fail are
given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cached_property

# Letters and marks whose class is the same in every Unicode version: each run of one kind is a single piece.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
KEPT_WORDS = 250_000
# The pattern that byte-level files of this kind split a text with before they merge (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def byte_ranks(said: dict) -> dict[bytes, int] | None:
    """The bytes of each ordinary token of a byte-level file (read as JSON), by id; None if its ids do not follow its merges."""
    letters = {c: b for b, c in byte_letters().items()}
    special = {t["content"] for t in said.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    order = [ranks[bytes(letters[c] for c in a + b)] for a, b in merges]
    return ranks if order == sorted(order) and sorted(ranks.values()) == list(range(len(ranks))) else None


class ByteIds:
    """Ids of a byte-level file. With ``special`` the strings of special tokens in a text are those tokens, else plain text.

    Null and empty texts have no ids.
    """

    def __init__(self, path: str, special: bool = True):
        import tiktoken

        self.path, self.plain = path, not special
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        added = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        self.special = list(added) if special else []
        self.vocabulary = len(said["model"]["vocab"] | added)
        ranks = byte_ranks(said)
        self.merge = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        self.settled: set[str] = set()

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded where a text asks for it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = self.plain
        return own

    def sure(self, text: str) -> bool:
        """Whether each letter has had its class since early Unicode versions and no special token occurs."""
        new = set(text) - self.settled
        if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in new):
            return False
        self.settled |= new
        return not any(s in text for s in self.special)

    def tokens(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.merge and self.sure(text):
            return self.merge(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> bytes:
        return array("I", self.tokens(text)).tobytes()


class WordIds:
    """``ids(text)`` as unsigned little-endian 32-bit integers in a bytes object.

    ``path``: a file of the tokenizers library that drops white space, lower-cases and marks the ends of words. At most 2 x ``kept``
    words stay in memory: when the newer half is full the older half, words not seen for that long, is let go. Null and empty
    texts have no ids.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.merge(spelled)]).tobytes()

    def word(self, word: str) -> bytes:
        found = _PLAIN.fullmatch(word)
        if found is None:
            return self.whole(word)
        letters, marks = found.groups()
        if marks:  # the bare word is known more often than the word with this mark
            return (self.new.get(letters) or self.missing(letters)) + self.mark(marks)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        return self.piece(letters)

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            self.marks[marks] = self.piece(marks)
            if len(self.marks) > 10_000:
                return self.marks.pop(marks)
        return self.marks[marks]

    def missing(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.word(word)
        if len(self.new) >= self.kept:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "\x00" in text or any(s in text for s in self.special):
            return self.whole(text)
        try:
            text.encode("latin-1")  # these letters have one lower case each and are already normalized
        except UnicodeEncodeError:
            return self.whole(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return self.whole(text)
        get, missing = self.new.get, self.missing
        return b"".join([get(w) or missing(w) for w in text.lower().split()])


_LOADED: dict[tuple[str, bool], ByteIds | WordIds] = {}


def word_ids(path: str, spaced: bool) -> ByteIds | WordIds:
    """The tokenizer of this Python worker, kept between its tasks. ``spaced``: a byte-level file, whose pieces take the space before them along."""
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = ByteIds(path) if spaced else WordIds(path)
    return _LOADED[path, spaced]
