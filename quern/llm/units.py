"""Ids and numbers of ids of whole texts by public vocabulary files.

Texts are cut only where no id can span the cut, so the parts' ids are those of the whole text;
``tests/llm`` compares both on random texts.
"""

from __future__ import annotations

import sys
from array import array

from .common import vocabulary_file

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are written as little-endian unsigned 32-bit numbers")

#: A cache of encoded units is emptied when it holds so many.
CACHE = 800_000


def piece_units(text: str) -> list[str]:
    """Cut at each space with another character before it: pieces hold a space in front only.

    ``" ".join(piece_units(text)) == text``; the model puts the lost space in front again.
    """
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, held = [], ""
    for part in parts:
        if part:
            out.append(held + part)
            held = ""
        else:
            held += " "
    if held:
        if out:
            out[-1] += held
        else:
            out.append(held[:-1])
    return out


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level files write for bytes: themselves, else 256 and on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by a byte-level BPE file.

    The file's own library gives the ids of texts with a special string in them, and of everything
    if the file is not of the kind whose ids are merge ranks. Otherwise ``tiktoken`` merges by those
    ranks, which gives the same ids some four times sooner.
    """

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path := vocabulary_file(file))
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        self.fast = self._ranked(told)

    def _ranked(self, told: dict):
        import tiktoken

        model, pre = told.get("model", {}), told.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        to, special = _byte_of(), set(self.special)
        ranks = {bytes(to[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_order = [model["vocab"][a + b] for a, b in merges]
        if in_order != sorted(in_order) or model.get("ignore_merges") or len(ranks) != 256 + len(merges):
            return None
        #: Fixed value: the pattern of byte-level pre-tokenizers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class PieceCounter:
    """Numbers of ids of whole texts by a sentencepiece file."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_file(file))
        self.cache: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = " a ﬁ  b①"
        self.safe = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and self.model.decode(self.model.encode(probe)) == probe

    def count(self, texts: list[str]) -> list[int]:
        """One call of the model for what is new in all texts, so give it many."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        cut, new = [], set()
        for text in texts:
            if not self.safe or "▁" in text or "\x00" in text:
                cut.append([text])
                new.add(text)
                continue
            lines = text.split("\n")
            parts = piece_units(lines[0])
            for line in lines[1:]:
                # A line break is an id of its own; nothing merges with it, and no space precedes it.
                more = piece_units(line)
                more[0] = "\n" + more[0]
                parts += more
            cut.append(parts)
            new.update(parts)
        new = list(new - self.cache.keys())
        ids = self.model.encode(new, num_threads=1)
        self.cache.update((x, len(i) - (x[:1] == "\n")) for x, i in zip(new, ids))
        cache = self.cache
        # The space that the model puts in front stands alone before a line break.
        return [sum([cache[p] for p in parts]) + (text[:1] == "\n") for text, parts in zip(texts, cut)]
