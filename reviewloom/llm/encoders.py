"""Public tokenizers as plain functions from a text to ids. Their files are given by path.

Objects of this module are made in the task that uses them and go with it.
"""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np

# Up to here the two libraries part a text in the same way, whatever Unicode they know.
_SAME_CLASSES = "ɐ"


class ByteEncoder:
    """Ids of the byte-level vocabulary of a ``tokenizers`` file; special strings are plain text.

    With its rank file, which has the same vocabulary and merges, texts of Latin letters,
    digits and signs are encoded as a whole by ``tiktoken``; other scripts go to ``tokenizers``.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        self.file, self.by_rank = tokenizer, None
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                self.table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.by_rank = tiktoken.Encoding(
                "ranks", pat_str=PATTERN, mergeable_ranks=self.table, special_tokens={}
            )

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.file)
        found.encode_special_tokens = True
        return found

    @cached_property
    def size(self) -> int:
        return max(self.table.values()) + 1 if self.by_rank else self.whole.get_vocab_size()

    @cached_property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def ids(self, text: str) -> list[int]:
        if self.by_rank and (text.isascii() or max(text) < _SAME_CLASSES):
            return self.by_rank.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id, in the order of the ids."""
        if self.by_rank:
            found = {number: token for token, number in self.table.items()}
        else:
            # Printable characters stand for themselves, the others follow from 256 on.
            plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
            rest = [b for b in range(256) if b not in plain]
            byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
            found = {
                number: bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
                for token, number in self.whole.get_vocab().items()
            }
        return [found.get(number, b"") for number in range(max(found) + 1)]


class PieceEncoder:
    """Ids of a SentencePiece model, which puts a space before the text."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        self.size = self.model.get_piece_size()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every piece; U+2581 is a space, and a byte piece is its byte."""
        found = []
        for number in range(self.size):
            piece = self.model.id_to_piece(number)
            if self.model.is_byte(number):
                found.append(bytes([int(piece[3:5], 16)]))
            else:
                found.append(piece.replace("▁", " ").encode())
        return found
