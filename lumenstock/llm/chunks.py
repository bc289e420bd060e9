"""Encoding texts by public tokenizers, one white-space chunk at a time.

Every boundary between a visible character and white space is also a boundary of the tokenizers used here, and no
rule looks past it, so a chunk (white space, then visible characters) has the same ids in every text. A worker
keeps the ids of chunks it has seen in two bounded generations and asks the library only for new ones. Special strings
of a vocabulary in a text have the ids that the library gives them.
"""

from __future__ import annotations

import array
import functools
import gc
import json
import os
import re
import string
import unicodedata
from collections.abc import Callable

SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_RARE = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GENERATION = 200_000


def chunk_keys(text: str) -> list:
    """Keys of the chunks of a text in order: a word stands for a space and that word, a 1-tuple for a literal chunk."""
    if not text:
        return []
    if not any(c in text for c in _RARE):
        keys: list = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:
                break
            words[0] = ("\n" + words[0] if i else words[0],)
            keys += words
        else:
            return keys
    return [(c,) for c in _CHUNK.findall(text)]


def slices(texts: list[str], size: int = 1 << 20):
    """Ranges of neighbouring texts of about `size` characters, so that the words of a batch are never held at once."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def literal(key) -> str:
    return key[0] if type(key) is tuple else " " + key


class Encodings(dict):
    """Values by chunk key. `encode` maps a list of chunks to a list of values; call `learn` before looking up."""

    def __init__(self, encode: Callable[[list[str]], list], size: int = GENERATION):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def learn(self, keys_of_texts: list[list]) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        new = set()
        for keys in keys_of_texts:
            new.update(keys)
        new.difference_update(self.keys())
        if self.old:
            known = new & self.old.keys()
            self.update((k, self.old[k]) for k in known)
            new -= known
        todo = list(new)
        for i in range(0, len(todo), 20_000):
            part = todo[i:i + 20_000]
            self.update(zip(part, self.encode([literal(k) for k in part])))


class Library(dict):
    """Ids of chunks by the tokenizers library, as little-endian unsigned 32-bit bytes; a chunk is encoded when first asked for.

    A chunk is cut before its trailing ASCII punctuation where the patterns never join that to what stands before; so a
    word is encoded once and not once with every mark. A word of letters is one piece for these vocabularies and goes
    straight to the library's model, after the same normalisation and byte mapping; all else takes the whole way. A text
    that may hold one of the vocabulary's special strings is encoded whole, since the library reads those before anything
    else. Chunks and words are kept in two generations of at most `size`.
    """

    def __init__(self, path: str, size: int = GENERATION):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.size = self.tokenizer.model.tokenize, size
        with open(path) as f:
            parts = json.load(f)
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        before = parts["pre_tokenizer"]
        self.lower = "Lowercase" in kinds
        self.space = "" if before["type"] == "Sequence" else "\u0120"
        known = kinds in ([], ["NFC", "Replace", "Lowercase"]) and (before["type"] == "ByteLevel" or before.get("pretokenizers", [{}])[-1].get("type") == "ByteLevel")
        self.direct = known and parts["model"]["type"] == "BPE"
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(seen))}
        added = [t["content"] for t in parts["added_tokens"]]
        self.special = os.path.commonprefix(added) if added else None
        self.old: dict = {}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _stem(self, stem: str) -> bytes:
        word = stem[1:] if stem[0] == " " else stem
        if not self.direct or not word.isalpha():
            return self.whole(stem)
        if not word.isascii():
            if max(word) >= "\u0370":
                return self.whole(stem)
            if self.lower:
                word = unicodedata.normalize("NFC", word).lower()
                if not word.isalpha():
                    return self.whole(stem)
            word = word.encode().decode("latin-1").translate(self.byte_chars)
        elif self.lower:
            word = word.lower()
        return array.array("I", [t.id for t in self.tokenize(self.space + word if stem[0] == " " else word)]).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.words.get(part)
        if ids is None:
            if len(self.words) >= self.size:
                self.words.clear()
            ids = self.words[part] = self._stem(part)
        return ids

    def __missing__(self, key) -> bytes:
        ids = self.old.get(key)
        if ids is None and self.direct and type(key) is str:
            ids = self._word(key)
        if ids is None:
            chunk = literal(key)
            stem = chunk.rstrip(string.punctuation)
            if stem and len(stem) < len(chunk) and self._ends(stem[-1]):
                ids = self._part(stem) + self._part(chunk[len(stem):])
            else:
                ids = self._part(chunk)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def _word(self, key: str) -> bytes | None:
        """Ids of a space and ASCII letters, perhaps with punctuation after them: most of a text, so no longer way is taken."""
        word = key.rstrip(string.punctuation)
        if not (word.isascii() and word.isalpha()):
            return None
        ids = self.spaced.get(word)
        if ids is None:
            if len(self.spaced) >= self.size:
                self.spaced.clear()
            found = self.tokenize(self.space + (word.lower() if self.lower else word))
            ids = self.spaced[word] = array.array("I", [t.id for t in found]).tobytes()
        return ids if len(word) == len(key) else ids + self._part(key[len(word):])

    def _ends(self, last: str) -> bool:
        """Whether a letter or digit is still the last thing once `last` is normalised; a mark would go with what follows."""
        if not last.isascii() and self.lower:
            last = unicodedata.normalize("NFC", last).lower()[-1]
        return last.isalnum()

    def forget(self) -> None:
        """Drop what is kept: at the end of a task, so that an idle worker holds no memory."""
        self.clear()
        self.old.clear()
        self.words.clear()
        self.spaced.clear()

    def texts(self, texts: list[str]):
        """Ids of each text. Nothing here makes reference cycles, and the collector's passes over the kept words cost a fifth of the time."""
        get, special, collects = self.__getitem__, self.special, gc.isenabled()
        gc.disable()
        try:
            for t in texts:
                yield self.whole(t) if special is not None and special in t else b"".join(map(get, chunk_keys(t)))
        finally:
            if collects:
                gc.enable()


def encode_texts(learned: Encodings | Library, texts: list[str]):
    """Joined values of each text's chunks, text by text."""
    if isinstance(learned, Library):
        yield from learned.texts(texts)
        return
    for cut in slices(texts):
        keys = [chunk_keys(t) for t in texts[cut]]
        learned.learn(keys)
        for k in keys:
            yield b"".join(map(learned.__getitem__, k))


@functools.cache
def library_encodings(path: str) -> Library:
    """Ids by chunk, from a vocabulary of the tokenizers library; one per worker."""
    return Library(path)


def default_path(name: str) -> str:
    """The place of a public vocabulary; the package is only needed where no path is given."""
    import public_tokenizers

    return public_tokenizers.path(name)
