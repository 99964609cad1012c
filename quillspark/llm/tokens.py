"""Byte-level BPE vocabularies: exact pre-token splitting, with the library itself as the way for everything else."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import regex

#: How a byte-level pre-tokenizer without prefix space splits text (fixed by the vocabulary's format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: ASCII and the Latin-1 letters: for texts of these alone the standard library's engine splits the same way, and faster.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = frozenset(chr(c) for c in [*range(0x1C), *range(0x20, 0x80), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
PLAIN_PATTERN = BYTE_LEVEL_PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LATIN}0-9]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")

#: Places where a pre-token ends whatever stands farther off: before a single space between ASCII characters.
CUT = regex.compile(r"(?<=[!-~])(?= [!-~])")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others go to 256 and up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(keep))
    return [out[b] for b in range(256)]


def stable(ch: str) -> bool:
    """Whether every Unicode version since 3.2 puts the character in the same class, so that all regex engines agree on it."""
    old = unicodedata.ucd_3_2_0.category(ch)
    return ch.isascii() or (old[0] == unicodedata.category(ch)[0] and old not in ("Cn", "Cf", "Cc") and ch != "᠎")


class Library:
    """Any tokenizer file through its own library: ``.json`` by tokenizers, ``.model`` by sentencepiece."""

    def __init__(self, path: str):
        self.path = path
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: self.model.encode(text, add_bos=False, add_eos=False)
            self.encode_many = lambda texts: self.model.encode(texts, add_bos=False, add_eos=False, num_threads=1)
            self.decode = self.model.decode
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.encode = lambda text: self.model.encode(text, add_special_tokens=False).ids
            self.encode_many = lambda texts: [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            self.decode = lambda ids: self.model.decode(ids, skip_special_tokens=False)


class ByteLevel(Library):
    """A byte-level BPE vocabulary whose texts can be split into independently encoded pre-tokens."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self._any, self._plain = regex.compile(BYTE_LEVEL_PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._safe: set[str] = set()

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the file is a plain byte-level BPE for which pre-token splitting is exact."""
        if not path.endswith(".json"):
            return False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        bare = not (spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        flags = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or [])
        return model.get("type") == "BPE" and plain and bare and flags

    def splittable(self, text: str) -> bool:
        """False if a character's class differs between Unicode versions."""
        if text.isascii():
            return True
        new = set(text) - self._safe
        if not new:
            return True
        good = {c for c in new if stable(c)}
        self._safe |= good
        return len(good) == len(new)

    def pretokens(self, text: str) -> list[str]:
        """Pieces in order whose ids, behind one another, are the text's: pre-tokens, special strings, and whole
        stretches around characters whose class differs between Unicode versions (``splittable`` is false for those)."""
        if self.splittable(text):
            return self._split(text)
        if any(" " in s for s in self.specials):
            return [text]
        cuts = [0, *(m.start() for m in CUT.finditer(text)), len(text)]
        out: list[str] = []
        done = 0
        for m in regex.finditer("[" + "".join(map(regex.escape, sorted(set(text) - self._safe))) + "]", text):
            if m.start() < done:
                continue
            begin, end = cuts[bisect_right(cuts, m.start()) - 1], cuts[bisect_left(cuts, m.end())]
            if begin >= done:
                out += self._split(text[done:begin])
                out.append(text[begin:end])
            done = end
        return out + self._split(text[done:])

    def _split(self, text: str) -> list[str]:
        findall = self._plain if PLAIN.issuperset(text) else self._any
        if self._special is None or not any(s in text for s in self.specials):
            return findall(text)
        out: list[str] = []
        for part in self._special.split(text):
            out.extend([part] if part in self.specials else findall(part))
        return out


class Pieces(dict):
    """What ``value`` makes of each pre-token's ids: a cache of the first ``most`` that are met, of ``longest`` characters at most."""

    def __init__(self, lib: ByteLevel, value: Callable, most: int = 600_000, longest: int = 128):
        super().__init__()
        self.lib, self.value, self.most, self.longest = lib, value, most, longest

    def __missing__(self, piece: str) -> object:
        made = self.value(self.lib.encode(piece))
        if len(self) < self.most and len(piece) <= self.longest:
            self[piece] = made
        return made

    def of(self, text: str) -> Iterator:
        """The values of a text's pieces."""
        return map(self.__getitem__, self.lib.pretokens(text))


_LOADED: dict[str, Library] = {}


def load(path: str) -> Library:
    """The tokenizer of a path, once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteLevel(path) if ByteLevel.fits(path) else Library(path)
    return _LOADED[path]
