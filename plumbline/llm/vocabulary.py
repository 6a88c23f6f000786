"""Byte-level BPE vocabularies of tokenizers' JSON files, and their split of texts into words."""

from __future__ import annotations

import json
import re

import regex

#: Fixed value: the byte-level pre-tokenization pattern, as the vocabulary's README gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters that \s stands for there (Unicode's white space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
#: A space that begins a word; and one that doesn't.
CUT, UNEVEN = re.compile(f" (?=[^{SPACE}])"), re.compile(f" (?:[{SPACE}]|\\Z)")


def byte_names() -> list[str]:
    """The character that stands for each byte in the file: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """``ids`` maps a token's bytes to its id, ``rank`` a pair of ids (first << 32 | second) to its merge's rank, ``made`` a rank to the merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_names())}
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.split: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.split.setdefault(self.made[r], (vocab[a], vocab[b], r))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = t
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(names)})") if names else None

    def pieces(self, text: str):
        """(special token or None, stretch of ordinary text) in order."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(None, text)]
        return [(p, "") if p in self.special else (None, p) for p in self.cut.split(text) if p]


def load(path: str) -> Vocabulary:
    """A vocabulary; who uses it keeps it (see ``stores.kept``), so that it goes with what else they keep."""
    return Vocabulary(path)


def units(text: str) -> list[str]:
    """The text cut before each space that a character other than white space follows; these spaces are left off.

    Such a space always begins a word, and white space before it ends one. So the words of the text are those of the first
    part and of each later one with its space before it.
    """
    return CUT.split(text) if UNEVEN.search(text) else text.split(" ")


def spans(text: str, most: int = 1_000_000) -> list[str]:
    """The text cut in the same places into parts of about ``most`` characters, as far as it has such places; no space is left off."""
    out, start = [], 0
    while len(text) - start > most and (m := CUT.search(text, start + most)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def chunks(texts: list[str], most: int = 1_000_000):
    """Runs of texts of about ``most`` characters, or single longer texts."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def byte_path() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
