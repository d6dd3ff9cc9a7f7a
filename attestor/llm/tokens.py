"""Token ids of whole texts under public BPE vocabularies: byte-level ones, and one of lower-case words.

A byte-level vocabulary file is that of the ``tokenizers`` library; its ids are encoded by the BPE engine of ``tiktoken``, which gives the same
ids (``tests/llm/test_packing.py`` compares them) at four times the speed and keeps nothing between texts. The strings of special
tokens are encoded as those tokens, as ``tokenizers`` does by default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: The pre-tokens of the byte-level BPE files (a fixed value of those tokenizers).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path) as f:  # a file of the installed package, on every executor
            model = json.load(f)
        byte, special = _letters(), {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._special = tuple(special)
        self.lengths = np.zeros(max(*ranks.values(), *special.values(), 0) + 1, "i8")  # UTF-8 bytes that each id stands for
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for content, i in special.items():
            self.lengths[i] = len(content.encode())
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        plain = not any(s in text for s in self._special)
        ids = self._bpe.encode_ordinary(text) if plain else self._bpe.encode(text, allowed_special="all")
        return np.array(ids, "<u4").tobytes()


#: The pre-tokens of the lower-case word vocabulary (a fixed value of that tokenizer).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Texts of these characters only (ASCII, Latin, the basic letters of Cyrillic, kana, ideographs, Hangul, dashes and quotes) are in NFC, fold letter by letter and
#: split alike under every Unicode version; all others go to the library whole.
PLAIN = r"[\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u012F\u0131-\u017F\u0410-\u044F\u0401\u0451\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\u2010-\u2027]*+"


#: In place of the mark at a word's end, and after what stood between white space: neither is in PLAIN.
_WORD_END, _CHUNK_END = "\x01", "\x02"


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts under a vocabulary with word ends, as the library gives them.

    Words are encoded independently of each other, so what stands between white space is looked up as a whole, and kept once its ids are known: at most KEPT
    entries of at most LONGEST characters, then anew. New ones are encoded by the engine of ``tiktoken``, a text's at once, with one byte as the word's end:
    its merges with the byte before it come first in this vocabulary, as they have to.
    """

    KEPT, LONGEST = 300_000, 64

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._special = tuple(t.content for t in self._library.get_added_tokens_decoder().values())
        self._words, self._plain = regex.compile(WORDS), regex.compile(PLAIN)
        byte, end, ranks = _letters(), "</w>", {}
        for token, i in self._library.get_vocab(with_added_tokens=False).items():
            whole = token.removesuffix(end) if token != end else token
            ranks[bytes(byte[c] for c in whole) + _WORD_END.encode() * (whole != token)] = i
        self._separator = ranks[_CHUNK_END.encode()]
        self._bpe = tiktoken.Encoding("word_bpe", pat_str=rf"[^{_WORD_END}{_CHUNK_END}]+{_WORD_END}|{_CHUNK_END}", mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks, kept but for long ones, which are given back."""
        find, long, start = self._words.findall, {}, 0
        text = "".join([_WORD_END.join([*find(c), _CHUNK_END]) for c in chunks])
        ids = np.array(self._bpe.encode_ordinary(text), "<u4")
        for chunk, stop in zip(chunks, np.flatnonzero(ids == self._separator).tolist(), strict=True):
            (self._known if len(chunk) <= self.LONGEST else long)[chunk] = ids[start:stop].tobytes()
            start = stop + 1
        return long

    def __call__(self, text: str) -> bytes:
        if not self._plain.fullmatch(text) or any(s in text for s in self._special):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks, known, long = text.lower().split(), self._known, {}
        if new := [c for c in {*chunks} if c not in known]:
            if len(known) > self.KEPT:
                known.clear()
                new = [*{*chunks}]
            long = self._learn(new)
        if long:
            return b"".join([long[c] if c in long else known[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process and file."""
    return WordEncoder(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def byte_bpe() -> str:
    """The default tokenizer file; a parameter wherever it is used."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    """The tokenizer file of the lower-case word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
