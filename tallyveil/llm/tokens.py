"""Token ids as the tokenizers library gives them, with quicker ways for plain text.

Both ways hold only for texts of code points under U+0250 without special strings; any other text is
encoded by the library as a whole. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

#: Texts that take the library's own way: other scripts, characters of disputed class, special strings.
_OTHER = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f²³¹¼½¾İɐ-\U0010ffff]|<\\|")
#: Bytes of Latin letters, spaces, newlines, commas and dots: a text of these alone, which is quick to tell, is none of the above.
_LETTERS = bytes([*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,.\n", *range(0x80, 0xC0), *range(0xC3, 0xC9)])


def _other(text: str) -> bool:
    return bool(text.encode().translate(None, _LETTERS) or "İ" in text) and bool(_OTHER.search(text))


def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def _ranks(path: str, special, end: bytes = b"") -> dict[bytes, int]:
    """The file's vocabulary as bytes; `end` stands for the suffix of a word's last piece.

    Bytes that print stand for themselves in the file; the others, in order, for code points from 256.
    """
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(prints)))}
    model = json.load(open(path, encoding="utf-8"))["model"]
    suffix = model.get("end_of_word_suffix") or ""

    def raw(word: str) -> bytes:
        ends = bool(suffix) and word.endswith(suffix)
        return bytes(back[c] for c in (word[: -len(suffix)] if ends else word)) + end * ends

    pairs = [(raw(word), i) for word, i in model["vocab"].items() if word not in special]
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("two pieces of the vocabulary are the same bytes")
    return found


def _merger(pattern: str, ranks: dict[bytes, int]):
    """tiktoken joins the pair of the lowest rank first, as the file's list of merges says, for ids are in that order."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """A byte-level BPE file of the tokenizers library; plain texts go through tiktoken with the same vocabulary as ranks."""

    def __init__(self, path: str):
        self.library = _library(path)
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.quick = _merger(pattern, _ranks(path, {t.content for t in self.library.get_added_tokens_decoder().values()}))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [
            _packed(self.library.encode(t, add_special_tokens=False).ids if _other(t) else self.quick.encode_ordinary(t))
            for t in texts
        ]


class WordBpe:
    """A BPE file whose text is lower-cased and cut into runs of letters, single digits and runs of marks.

    Plain texts are written with a space after every piece, which then stands for the end of a word in
    the ranks: one pass of tiktoken merges the whole text.
    """

    #: The file's pieces, for texts of the quick way: contractions, letters, a digit, other marks.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    #: What a text of _LETTERS must not have to be letters and single commas and dots.
    MARKS = ("×", "÷", "İ", ",,", "..", ",.", ".,")

    def __init__(self, path: str):
        self.library = _library(path)
        ranks = _ranks(path, {t.content for t in self.library.get_added_tokens_decoder().values()}, b" ")
        self.quick = _merger("[^ ]+ ", ranks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for t in texts:
            if t.encode().translate(None, _LETTERS) or any(x in t for x in self.MARKS):
                if _OTHER.search(t):
                    out.append(_packed(self.library.encode(t, add_special_tokens=False).ids))
                    continue
                spaced = " ".join(self.PIECE.findall(t.lower()))
            else:
                spaced = t.lower().replace(".", " . ").replace(",", " , ").replace("\n", " ")
            out.append(_packed(self.quick.encode_ordinary(spaced + " ")))
        return out


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
