"""Encoding of whole texts by the tokenizers library with a memo of text chunks.

A byte-pair tokenizer encodes each of its pre-tokens alone, so a text may be cut wherever a
pre-token is sure to end and each chunk be encoded once.  Chunks are runs up to the next blank
or line break.  Texts with rarer white space, on which libraries differ, are encoded whole, as
are all texts where the tokenizer's own rules are not known to allow the cut.  Strings of the file's
added tokens get those tokens' ids, as the library does by default; they hold no white space and
look at none beside them, so the cuts don't touch them."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import own_memo

_RARE_SPACE = re.compile(r"[^\S \n]")
_UNSURE_SPACE = re.compile(r"[\x1c-\x1f]")
_LED_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: A line break, a word of common Latin letters and signs, each of which is a pre-token under either
#: set of rules and left alone by composition.  They go straight to the merging model.
_PLAIN_CHUNK = re.compile(r"(\n)?( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")
#: Chunks kept at most where nothing else is asked for, and the longest that is kept.
MEMO_CHUNKS, MEMO_CHARS = 1_000_000, 48


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others get the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()

_loaded: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cut = self._cut(json.loads(self.tokenizer.to_str()))
        self.memo, self.memo_chunks = Memo(self), memo_chunks

    @staticmethod
    def _cut(spec: dict) -> str:
        """How texts may be cut: before white space that leads a word, at white space that is
        dropped, or not at all."""
        for t in spec.get("added_tokens") or []:
            if re.search(r"\s", t["content"]) or _PLAIN_CHUNK.fullmatch(t["content"]) or any(t.get(x) for x in ("lstrip", "rstrip", "single_word", "normalized")):
                return "whole"
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return "led"
        steps = pre.get("pretokenizers", [])
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and not steps[1].get("add_prefix_space") and kinds == ["NFC", "Replace", "Lowercase"]:
            return "dropped"
        return "whole"

    def chunks(self, text: str) -> list[str]:
        if self.cut == "led" and not _RARE_SPACE.search(text):
            return _LED_CHUNK.findall(text)
        if self.cut == "dropped" and not _UNSURE_SPACE.search(text):
            return text.split()
        return [text] if text else []

    def _plain(self, chunk: str) -> bytes | None:
        """Ids of a plain chunk by the merging model alone, or None for any other chunk."""
        if len(chunk) > MEMO_CHARS or not (m := _PLAIN_CHUNK.fullmatch(chunk)):
            return None
        lead, word, signs = m.groups()
        if lead and (self.cut == "dropped" or word[0] == " "):
            return None
        return (self._part(lead) if lead else b"") + self._part(word) + (self._part(signs) if signs else b"")

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token; as it is a chunk as well, the memo keeps it."""
        if (ids := self.memo.get(part)) is None:
            letters = part.lower() if self.cut == "dropped" else part
            letters = letters.replace(" ", BYTE_LETTERS[32]) if letters.isascii() and letters != "\n" else letters.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.memo[part] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > self.memo_chunks:
            self.memo.clear()
        get = self.memo.__getitem__
        return [b"".join(map(get, self.chunks(t))) for t in texts]

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


class Memo(dict):
    """Ids of chunks; one that is missing is encoded, and kept unless it is long."""

    def __init__(self, owner: ChunkEncoder):
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        own = self.owner
        ids = own._plain(chunk) if own.cut != "whole" else None
        if ids is None:
            ids = own.whole(chunk)
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids


def encoder(path: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """One encoder a Python worker and file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = ChunkEncoder(path)
    _loaded[path].memo_chunks = memo_chunks
    own_memo("chunks", _loaded.clear)
    return _loaded[path]
