"""Token ids of whole texts by a byte-level BPE tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow.fs as pafs

#: Characters on which both libraries split alike, whatever their Unicode versions.
PLAIN = re.compile("[^\x00-\x84\x86-˿‐-‧€]")
#: The split of this kind of tokenizer (fixed value; the pre-tokenizer of the files names it only by kind).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_file(path: str) -> bytes:
    """A vocabulary file, local or in a store that pyarrow knows."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_stream(inner) as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            letters[chr(0x100 + extra)] = b
            extra += 1
    return letters


class Tokens:
    """``ids(text)`` as uint32. Texts that only hold plain characters take the faster of two equal ways."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        text = read_file(path).decode()
        spec, self.slow = json.loads(text), Tokenizer.from_str(text)
        self.size = self.slow.get_vocab_size()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): k for piece, k in model["vocab"].items() if piece not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in pairs]
        if made != sorted(set(made)):  # ids must rise with the order of the merges
            return None
        import tiktoken

        return tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and not PLAIN.search(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
