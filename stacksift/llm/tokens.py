"""Token ids of a public byte-level vocabulary, inside tasks.

Texts of Latin letters, ASCII signs and plain white space are encoded whole by a second
library with the same ranks, which gives the same ids at a fraction of the time. Of other
texts only the words with other characters, or with strings of special tokens, go to the
tokenizer: a single space between two characters that are no white space always starts a
new piece of the pattern, so a text can be cut there without changing its ids.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import cached_property, lru_cache
from itertools import groupby

#: Characters on which libraries may differ: beyond Latin letters, and control characters.
OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\u024f]")
CUT = re.compile(r"(?<=\S)(?= \S)")

DEFAULT = "byte_bpe_50k"


def vocabulary(name: str = DEFAULT, folder: str | None = None) -> tuple[str, str]:
    """Paths of the tokenizer file and of the same vocabulary as ranks."""
    if folder is not None:
        return f"{folder}/{name}.json", f"{folder}/{name}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Encodes texts to little-endian ids of four bytes.

    ``special``: strings of special tokens in a text become their id, as the tokenizer does
    by default; otherwise they are ordinary text.
    """

    def __init__(self, json_path: str, ranks_path: str, special: bool) -> None:
        import public_tokenizers
        import tiktoken

        self.json_path, self.special = json_path, special
        with open(json_path, encoding="utf-8") as text:
            self.marks = [t["content"] for t in json.load(text).get("added_tokens", [])] if special else []
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.latin = tiktoken.Encoding(
            json_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @cached_property
    def tokenizer(self):
        """Loaded when the first text needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.json_path)
        tokenizer.encode_special_tokens = not self.special
        return tokenizer

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def is_plain(self, text: str) -> bool:
        return not OTHER.search(text) and not any(m in text for m in self.marks)

    def plain(self, text: str) -> bytes:
        return array("I", self.latin.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text``."""
        if self.is_plain(text):
            return self.plain(text)
        out: list[bytes] = []
        for plain, words in groupby(CUT.split(text), self.is_plain):
            part = "".join(words)
            out.append(self.plain(part) if plain else self.whole(part))
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str, special: bool) -> Encoder:
    """The encoder of this worker."""
    return Encoder(json_path, ranks_path, special)
