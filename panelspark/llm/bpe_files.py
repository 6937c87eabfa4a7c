"""A byte-level BPE tokenizer file (the ``tokenizers`` JSON format), read for the operators that use one."""

from __future__ import annotations

import json
from dataclasses import dataclass

import regex


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable Latin-1 bytes stand for themselves,
    the others, in order, are the code points from 256."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " " and b != 0xAD]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class BpeFile:
    pieces: dict[int, bytes]  # bytes of each id, added tokens too
    merges: list[tuple[int, int, int]]  # (left id, right id, merged id) by rank
    bytes_to_id: list[int]
    added: dict[str, int]  # strings that are one token wherever they stand
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> BpeFile:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        pieces |= {i: t.encode() for t, i in added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        one = {b: vocab[c] for c, b in letters.items()}
        return cls(pieces, merges, [one[b] for b in range(256)], added, pattern)

    def splitter(self) -> regex.Pattern | None:
        """Finds the added tokens, longest first."""
        if not self.added:
            return None
        return regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")


#: Fixed value: how byte-level BPE of this kind splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
