"""Byte-level BPE in tasks: the ids of a ``tokenizers`` file, and texts from ids.

Texts of Latin letters go through ``tiktoken`` with the file's own vocabulary
(several times faster); it gives the file's ids as long as merges are ranked by
id, which is tested when a file is loaded. Everything else - other scripts,
special tokens, runs of thousands of characters without a space - is encoded
by the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from hearth.llm.common import worker_store

#: The pre-tokeniser's pattern of byte-level BPE files with ``use_regex`` (fixed value).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts for the library itself: code points beyond the Latin blocks, or very long runs.
ELSE = re.compile("[^\x00-ɏ]|\\S{1000}|\\s{1000}")


def byte_values() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one tokenizer file; ids are little-endian uint32 bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_values()
        vocab = spec["model"]["vocab"]
        added = {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
        self.special = tuple(added.values())
        self.pieces = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in vocab.items():
            if i not in added:
                self.pieces[i] = bytes(byte[c] for c in token)
        ranks = {p: i for i, p in enumerate(self.pieces) if p}
        for i, token in added.items():
            self.pieces[i] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout"))
        self.fast = None
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.fast = own.encode_ordinary

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """The worker's one instance for ``path``."""
        store = worker_store("tokens")
        return store.get(path) or store.setdefault(path, cls(path))

    def raw(self, text: str) -> bytes:
        """Ids straight from the library, special tokens recognised in the text."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as :meth:`raw` gives them."""
        if self.fast is None or ELSE.search(text) or any(s in text for s in self.special):
            return self.raw(text)
        return array("I", self.fast(text)).tobytes()

    def text(self, ids: np.ndarray) -> str:
        """The text of ids: their bytes joined; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
