"""Splitting texts into the words that a tokenizer's merges work within, as the tokenizers library does.

Words come from the vocabulary's own pattern by the regex module.  Characters that this Python's Unicode tables don't
know yet may fall into other classes there than in the library; texts that hold any are split by the library itself.

Known are two kinds of vocabulary file: byte-level words by BYTE_LEVEL_PATTERN without a normalizer, and words that match
a stated pattern, of texts in NFC, lower-cased, whose runs of white space are one space.  Any other raises an error.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import regex
from tokenizers import Tokenizer

#: The pattern of byte-level pre-tokenizers, a fixed value.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _unknown() -> re.Pattern:
    cn = [c for c in range(0x378, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
    ranges, first = [], cn[0]
    for a, b in zip(cn, [*cn[1:], -1], strict=True):
        if b != a + 1:
            ranges.append(f"{chr(first)}-{chr(a)}")
            first = b
    return re.compile(f"[{''.join(ranges)}]")


def _word_pattern(spec: dict) -> str | None:
    """The pattern that a vocabulary file states for words; None if it is the byte-level one.  Raises for unknown kinds."""
    normalizer, pre = spec["normalizer"], spec["pre_tokenizer"] or {"type": "none"}
    levels = {"type": "ByteLevel", "add_prefix_space": False}
    has = lambda part, want: all(part.get(k) == v for k, v in want.items())
    if normalizer is None and has(pre, levels | {"use_regex": True}):
        return None
    parts, steps = pre.get("pretokenizers", []), (normalizer or {}).get("normalizers", [])
    spaces = [x for x in steps if x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "]
    kinds = [x["type"] for x in steps if x not in spaces]
    if len(parts) == 2 and has(parts[0], {"type": "Split", "behavior": "Removed", "invert": True}) and "Regex" in parts[0]["pattern"] and has(parts[1], levels | {"use_regex": False}) and kinds == ["NFC", "Lowercase"]:
        return parts[0]["pattern"]["Regex"]
    raise ValueError(f"unknown normalizer or pre-tokenizer: {normalizer}, {spec['pre_tokenizer']}")


class Splitter:
    """Segments between special tokens and the words of a segment, for the vocabulary file at path."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        own = _word_pattern(self.spec)
        if self.spec["model"].get("dropout") or any(t.get(k) for t in self.spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("vocabularies with dropout, or with added tokens that are single words, stripped or normalized, aren't known")
        self.words = regex.compile(own or BYTE_LEVEL_PATTERN).findall
        self.lower = own is not None
        self.late, self.unknown = re.compile("[^\x00-ͷ]").search, _unknown().search
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}

    def segments(self, text: str) -> Iterator[str | int]:
        """Texts between special tokens, and the special tokens' ids."""
        if self._special is None or not any(s in text for s in self.special):
            yield text
            return
        for part in self._special.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                yield part

    def split(self, text: str) -> list[str]:
        """Words of a segment, normalised if the vocabulary normalises."""
        if not text.isascii() and self.late(text) and self.unknown(text):
            if self.tokenizer.normalizer is not None:
                text = self.tokenizer.normalizer.normalize_str(text)
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in pieces]
        if self.lower:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return self.words(text)
