"""Token ids of texts, through a bounded cache of white-space-separated chunks in two generations.

The tokenizers used here are byte-level, lower-case, drop white space and never join across it, so the
ids of a text are those of its chunks in order. The tokenizer encodes a chunk the first time it is met.
"""

from __future__ import annotations

import os
import re
from array import array

#: A lower-case word whose normal form is itself (letters up to U+024F, but for the dotted capital I), and marks behind it.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Byte-level vocabularies write a byte as the character of its number, unless that can't be printed: then as the next one above 255.
_UNPRINTED = [*range(33), *range(127, 161), 173]
_BYTES = {b: 256 + n for n, b in enumerate(_UNPRINTED)}
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_ENCODERS: dict[tuple, ChunkEncoder] = {}


class ChunkEncoder:
    """``encode(text)`` gives the text's ids as little-endian ``dtype`` bytes.

    Of the chunks met, ``most`` are remembered, none longer than ``longest``. When half as many are new, those become the old ones, from
    which a chunk that is met again is taken over, so frequent chunks are never learnt twice. A long text is encoded in slices; a chunk is never cut.
    """

    def __init__(self, path: str, dtype: str = "<u4", specials_are_text: bool = False, most: int = 300_000, slice_chars: int = 1 << 18, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        self.kind = {"<u4": "I", "<u2": "H"}[dtype]
        self.most, self.slice_chars, self.longest, self.known, self.old = most, slice_chars, longest, {}, {}

    def encode(self, text: str) -> bytes:
        if len(text) <= self.slice_chars:
            return self._encode(text)
        parts, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, min(len(text), at + self.slice_chars))
            end = cut.start() if cut else len(text)
            parts.append(self._encode(text[at:end]))
            at = end
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        # str.split() parts at four control characters besides, which the tokenizer doesn't take for white space.
        chunks = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        if len(self.known) > self.most // 2:
            self.known, self.old = {}, self.known
        known, old, new = self.known, self.old, []
        for c in set(chunks).difference(known):
            ids = old.get(c)
            if ids is None:
                new.append(c)
            else:
                known[c] = ids
        if new:
            self._learn(new)
        ids = b"".join(map(known.__getitem__, chunks))
        for c in new:
            if len(c) > self.longest:  # most are met once, and one may be as long as the text
                del known[c]
        return ids

    def _learn(self, chunks: list[str]) -> None:
        """Latin letters, and marks behind them, are one word each for the model; any other chunk takes the whole tokenizer."""
        known, old, tokenize, kind, rest = self.known, self.old, self.tokenizer.model.tokenize, self.kind, []
        for c in chunks:
            if c.isascii() and c.isalpha() and c.islower():
                known[c] = array(kind, [t.id for t in tokenize(c)]).tobytes()
                continue
            plain = _PLAIN(c.lower())
            if not plain:
                rest.append(c)
                continue
            word, mark = plain.groups()
            ids = known.get(word) or old.get(word)
            if ids is None:
                symbols = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                ids = array(kind, [t.id for t in tokenize(symbols)]).tobytes()
                if len(word) <= self.longest:
                    known[word] = ids
            if mark:
                marks = known.get(mark)
                if marks is None:
                    known[mark] = marks = array(kind, self.tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
                ids += marks
            known[c] = ids
        if rest:
            for chunk, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
                known[chunk] = array(kind, e.ids).tobytes()


def encoder(path: str, dtype: str = "<u4", specials_are_text: bool = False) -> ChunkEncoder:
    """One encoder for each Python worker and setting."""
    key = (path, dtype, specials_are_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, dtype, specials_are_text)
    return _ENCODERS[key]
