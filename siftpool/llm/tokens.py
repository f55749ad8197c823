"""Token ids for batches of texts with a public byte-level BPE vocabulary.

Texts are cut before each single space that stands before a visible character:
there a new pre-token begins whatever stands around it, so pieces can be encoded
by themselves. A batch's equal pieces are encoded once, and frequent ones are
kept between batches, up to a fixed number. Where a text holds an added token
of the vocabulary literally, it is cut before and after it.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from siftpool.llm.textops import word_hashes

KEEP = 1_000_000  # pieces kept between batches
#: After a space: white space, separators, and first bytes of characters that may be white space.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_of() -> dict[str, int]:
    """The byte behind each printable stand-in of byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(buf, offs) of textops.text_bytes gives all ids end to end, and where each text's ids begin.

    Where the file is a plain byte-level BPE whose ids follow its merges, the
    same vocabulary runs as ranks, which is several times as fast; else the
    file's own library encodes the pieces. With added, texts that hold an added
    token of the file literally get its id, as the library has it by default;
    without, they are plain text (its encode_special_tokens).
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        self.vocab_size = len(vocab) + sum(t["content"] not in vocab for t in spec["added_tokens"])
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not (added and any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")))
        plain = plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        if plain:
            import public_tokenizers
            import tiktoken

            at, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(at[c] for c in word): i for word, i in vocab.items() if word not in special}
            ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = not added
            ordinary = lambda text: own.encode(text, add_special_tokens=False).ids
        tokens = spec["added_tokens"] if added else []
        self._added = {t["content"]: t["id"] for t in tokens}
        #: Added tokens that take white space with them or stand at word borders only need their surroundings: no cuts then.
        self._whole = any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word"))
        self._find = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self._added, key=len, reverse=True))) if tokens and not self._whole else None
        self._one = ordinary if self._whole else lambda text: [self._added[text]] if text in self._added else ordinary(text)
        self._clear()

    def _literal(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        """Start and end of each added token in the texts, in order; none crosses texts."""
        if not self._find or not self._find.search(raw):
            return np.zeros((0, 2), np.int64)
        return np.array([m.span() for a, b in zip(offs.tolist(), offs[1:].tolist()) for m in self._find.finditer(raw, a, b)], np.int64).reshape(-1, 2)

    def _clear(self) -> None:
        self._keys, self._check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._at, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, self.dtype)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buf)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        raw = buf.tobytes()
        cut = np.zeros(n + 1, bool)
        if not self._whole:
            cut[: n - 1] = (buf[:-1] == 0x20) & ~_UNSAFE[buf[1:]]
        cut[offs[offs > 0] - 1] = False  # a text's last byte
        literal = self._literal(raw, offs)
        for a, b in literal.tolist():
            cut[max(a - 1, 0) : b] = False  # what stands before it ends there, as a text does
        cut[literal] = True
        cut[offs] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys, first, back = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        other = word_hashes(buf, starts, ends, 1)
        check = other[first]
        at, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if len(self._keys):
            where = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            known = (self._keys[where] == keys) & (self._check[where] == check)
            at[known], size[known] = self._at[where[known]], self._size[where[known]]
        new = np.flatnonzero(~known)
        found = [self._one(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
        size[new] = [len(x) for x in found]
        flat = np.fromiter((i for x in found for i in x), self.dtype, int(size[new].sum()))
        at[new] = len(self._ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self._ids, flat])
        if (check[back] != other).any():  # two pieces with one hash
            got = [np.array(self._one(raw[a:b].decode("utf-8", "replace")), self.dtype) for a, b in zip(starts.tolist(), ends.tolist())]
            sizes, out = np.array([len(x) for x in got]), np.concatenate(got)
        else:
            sizes = size[back]
            shift = at[back] - (np.cumsum(sizes) - sizes)
            out = ids[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)]
        if not self._whole and len(self._keys) + len(new) <= KEEP:
            room = np.concatenate([self._keys, keys[new]])
            order = np.argsort(room, kind="stable")
            self._keys, self._ids = room[order], ids
            self._check = np.concatenate([self._check, check[new]])[order]
            self._at, self._size = np.concatenate([self._at, at[new]])[order], np.concatenate([self._size, size[new]])[order]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return out, total[np.searchsorted(starts, offs)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file, added tokens included."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]
