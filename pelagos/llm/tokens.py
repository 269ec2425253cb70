"""Token ids of whole texts by a public tokenizer file, with a store of words already seen.

For the word tokenizer, cutting a text at ASCII white space changes nothing: its rules drop white space and no rule
reaches over it. So ids are looked up word by word, and only words not seen before go to the tokenizer.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Words kept by a Python worker; when there are more, it starts over.
STORE_WORDS = 400_000

_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
# letters, digits and marks of ASCII, and precomposed Latin letters: lower-casing and composing them goes letter by letter
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


#: Stands for the end of a word; no UTF-8 text has this byte.
_END = b"\xff"


class WordTokenizer:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit numbers, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Words of plain Latin letters and ASCII are cut and merged here, by the file's own vocabulary, in order of ids, which is
    the order of its merges; all others, and the texts of special tokens, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store: dict[bytes, bytes] = {}
        # the file writes each byte as one printable character
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks, special = {_END: 1 << 20}, set(self.tokenizer.get_added_tokens_decoder())
        with open(path, encoding="utf-8") as f:
            for token, i in json.load(f)["model"]["vocab"].items():
                if i not in special:
                    body = token.removesuffix("</w>")
                    ranks[bytes(byte[c] for c in body) + _END * (body != token)] = i
        self.merged = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _new(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if b"<|" in word or not _PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        ids = array("I")
        for piece in _CUT.findall(text.lower()):
            ids.extend(self.merged(piece.encode() + _END))
        return ids.tobytes()

    def encode(self, text: bytes) -> bytes:
        words = text.split()
        store = self.store
        try:
            return b"".join(map(store.__getitem__, words))
        except KeyError:
            if len(store) > STORE_WORDS:
                store.clear()
            for word in words:
                if word not in store:
                    store[word] = self._new(word)
            return b"".join(map(store.__getitem__, words))


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file, so that its store outlives a task."""
    return WordTokenizer(path)
