"""What the two token operators share: values of white-space-free chunks, remembered by each Python worker."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

#: Entries that a generation of a memory holds; two generations are kept, so each memory stays near 60 MB a worker.
KEPT = 200_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kept_by_worker(key, build: Callable):
    """build(), made once a Python worker: later tasks of the worker find it again under its key. Worker code travels by value, so it
    has no module to keep things in; one is registered in the worker for that."""
    import types

    kept = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def plain_path(vocabulary: str) -> bool:
    """Is this a tokenizer that lower-cases, drops white space and never looks across it? Only then may texts be taken apart below; all
    others read whole texts themselves. The answer is read from the tokenizer's own description."""
    import json

    with open(vocabulary, encoding="utf-8") as f:
        it = json.load(f)
    steps = (it.get("normalizer") or {}).get("normalizers", [it.get("normalizer") or {}])
    splits = (it.get("pre_tokenizer") or {}).get("pretokenizers", [it.get("pre_tokenizer") or {}])
    lower = any(x.get("type") == "Lowercase" for x in steps) and all(x.get("type") in ("NFC", "Replace", "Lowercase") for x in steps)
    byte_level = any(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in splits)
    drops = any(x.get("type") == "Split" and x.get("invert") and x.get("behavior") == "Removed" for x in splits)
    return lower and drops and byte_level and it.get("model", {}).get("end_of_word_suffix") == "</w>"


#: ASCII without the apostrophe, its plainest white space, and the letters of Latin-1: here the split into words and the lower case below are
#: the tokenizer's own.
PLAIN = re.compile("[ \\t\\n\\r\\x21-\\x26\\x28-\\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PARTS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \\t\\n\\ra-z0-9\xdf-\xf6\xf8-\xff]+")


def encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> their ids as little-endian 32-bit bytes. With a vocabulary of ``plain_path``, plain texts are taken apart here and each
    lower-case part is encoded once while it is remembered; other texts go through the tokenizer chunk by chunk. With any other vocabulary
    the tokenizer gets whole texts."""
    import os
    from array import array

    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; a pool of threads in each only spins
    whole, bare = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
    bare.normalizer, bare.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(tk):
        def make(xs):
            out = [array("I", e.ids) for e in tk.encode_batch_fast(xs, add_special_tokens=False)]
            if sys.byteorder != "little":
                for a in out:
                    a.byteswap()
            return [a.tobytes() for a in out]

        return make

    if not plain_path(vocabulary):
        return ids(whole)
    parts, chunks = Memory(ids(bare)), Memory(ids(whole), KEPT // 4)

    def encode(texts: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        split = [PARTS.findall(t.lower()) if p else split_chunks(t) for t, p in zip(texts, plain, strict=True)]
        of_parts = parts({x for s, p in zip(split, plain, strict=True) if p for x in s})
        of_chunks = chunks({x for s, p in zip(split, plain, strict=True) if not p for x in s})
        return [b"".join(map((of_parts if p else of_chunks).__getitem__, s)) for s, p in zip(split, plain, strict=True)]

    return encode


def split_chunks(text: str) -> list[str]:
    """The text without ASCII white space. The tokenizers used here drop white space and never look across it, so a text's ids are its
    chunks' ids one after the other. Other white space stays inside a chunk and is left to the tokenizer."""
    return [c for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]


class Memory:
    """value(chunk) for many chunks, each made once while it is in use. make: list of chunks -> list of values."""

    def __init__(self, make: Callable[[list[str]], list], kept: int = KEPT):
        self.make, self.kept, self.young, self.old = make, kept, {}, {}

    def __call__(self, chunks: set[str]) -> dict:
        """A mapping that holds all the given chunks."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for c in chunks:
            if c not in young:
                if (v := old.get(c)) is None:
                    new.append(c)
                else:
                    young[c] = v
        if new:
            young.update(zip(new, self.make(new), strict=True))
        return young
