"""Ids of a byte-level BPE vocabulary of the tokenizers library, by tiktoken's faster merging where the two are the same."""

from __future__ import annotations

import json
import os

import numpy as np


def _bytes_of_characters() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """encode(text): ids as numpy unsigned 32-bit numbers, as tokenizers gives them with add_special_tokens=False.

    tiktoken merges by id, so it serves when the file's merges are in the order of their ids and the file has neither
    normaliser nor other settings; else the tokenizers library itself encodes, as it does for a text that tiktoken refuses.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library, self.fast = path, None, None
        model, vocab = spec["model"], spec["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        same = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        same = same and not model.get("ignore_merges") and not model.get("dropout") and merged == list(range(merged[0], merged[0] + len(merged))) and merged[0] == 256
        if same and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            import public_tokenizers
            import tiktoken

            byte = _bytes_of_characters()
            ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)

    def slow(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # the Rust side panics on some texts with long runs of white space
                raise
            return self.slow(text)


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
