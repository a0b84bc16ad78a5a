"""Token ids of whole texts under a public byte-level BPE file, which is given by path and never copied or trained."""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np

#: The split pattern of byte-level BPE files in this format (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The characters that such files write for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """encode(text) gives the ids of tokenizers' encode(text, add_special_tokens=False).

    Where the file is a plain byte-level BPE whose ids follow its merges, tiktoken computes the same ids in a quarter of the time;
    texts that hold the string of an added token, and other kinds of files, go through tokenizers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.size = 1 + max([*spec["model"].get("vocab", {}).values(), *[x["id"] for x in spec.get("added_tokens", [])]]) if isinstance(spec["model"].get("vocab"), dict) else self.slow.get_vocab_size()
        self.fast = self._fast(spec)

    @cached_property
    def slow(self):  # noqa: ANN201
        """Loaded by the first text that needs it: it takes as much memory as the fast one."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_padding()
        out.no_truncation()
        return out

    @staticmethod
    def _fast(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        bytes_of = byte_of_character()
        added = {x["content"] for x in spec.get("added_tokens", [])}
        words = {w: i for w, i in model["vocab"].items() if w not in added}
        merged = [words.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(c not in bytes_of for w in words for c in w):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(bytes_of[c] for c in w): i for w, i in words.items()}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if not text:
            return np.empty(0, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.slow.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(2)
def ids_of(path: str) -> Ids:
    """One for each worker process."""
    return Ids(path)
