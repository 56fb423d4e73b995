"""Words of letters through the tokenizers library, many at a time.

For a byte-level vocabulary such a word, with a blank before it or without, is one
pre-token, and white space never lies inside one. So the library's model gets the words
in the vocabulary's own characters, one for each byte, and cuts at white space only: the
search for pre-tokens and the normaliser, most of its time for new words, have nothing to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Latin letters: the same in every version of Unicode, composed, with one lower-case letter each (not \u0130).
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
JOINED = 4000  # words given to the library at once
_NEWLINE = 10


def only_letters(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, rf"\A[{LETTERS}]+\z").to_numpy(zero_copy_only=False)


def _characters() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = np.zeros(256, np.uint16)
    found[own] = own
    others = np.setdiff1d(np.arange(256), own)
    found[others] = 256 + np.arange(len(others))
    return found


class ByteWords:
    """Ids of words, given the library's tokenizer and how many bytes each id stands for."""

    def __init__(self, tokenizer, sizes: np.ndarray):
        from tokenizers import Tokenizer, pre_tokenizers

        self.sizes = sizes
        self.library = Tokenizer(tokenizer.model)
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.characters = _characters()
        self.characters[_NEWLINE] = _NEWLINE

    def __call__(self, words: list[str], blank: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids of each word), each after a blank or none; None if ids do not end where words do."""
        before = " " if blank else ""
        data = np.frombuffer((before + ("\n" + before).join(words)).encode(), np.uint8)
        text = self.characters[data].tobytes().decode("utf-16-le")
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(data == _NEWLINE), len(data)) - np.arange(len(words))
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends)
        if not len(reached) or reached[-1] != ends[-1] or (reached[last] != ends).any():
            return None
        return ids, np.diff(last + 1, prepend=0)
