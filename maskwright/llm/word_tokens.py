"""Fast whole-text encoding with a lower-casing word BPE tokenizer.

No token spans a blank and a word's ids depend on the word alone, so what stands between
blanks is encoded once by the ``tokenizers`` library's model and then looked up. The quick way is taken for texts made of
characters whose classes and case are the same in every Unicode version and without the string of an
added token; any other text goes through the library as a whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

#: Texts of other characters are encoded by the library itself.
_QUICK = "".join(map(chr, range(0x20, 0x7F))) + "\t\n\r" + "".join(chr(c) for c in range(0xA1, 0x180) if c != 0x130) + "‐‑‒–—‘’‚“”„•…€"
#: A word cache is emptied when it holds this many bytes of words and ids, with what Python needs for each entry; it only saves time.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200


def _escaped(kind: str) -> str:
    return "".join(re.escape(c) for c in _QUICK if unicodedata.category(c)[0] == kind)


def _others() -> str:
    return "".join(re.escape(c) for c in _QUICK if unicodedata.category(c)[0] not in "LN" and not c.isspace())


_ALL_QUICK = re.compile(f"[{''.join(re.escape(c) for c in _QUICK)}]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_escaped('L')}]+|[{_escaped('N')}]|[{_others()}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte value: printable ones for themselves, the others in turn from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class _Parts(dict):
    """What stands between blanks -> ids."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.letters = _byte_letters()
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        words = _WORD.findall(part)
        if len(words) == 1:
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
            ids = np.array([t.id for t in tokens], "<u4").tobytes()
        else:
            ids = b"".join(map(self.__getitem__, words))
        if len(part) <= 64:
            if self.held > CACHE_BYTES:
                self.clear()
                self.held = 0
            self[part] = ids
            self.held += ENTRY_BYTES + len(part) + len(ids)
        return ids


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer.model)
        # looked for without regard to case, so no form of an added token takes the quick way
        added = [re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")

    def ids(self, text: str) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if _ALL_QUICK.fullmatch(text) is None or self.added.search(low := text.lower()):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, low.split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
