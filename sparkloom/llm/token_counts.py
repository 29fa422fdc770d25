"""Token counts by linear longest match: a trie with failure links and counts of the pieces popped, so no piece is ever built."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Memory, kept_by_worker, plain_path, split_chunks, vocabulary_path
from .common import lean_batches, released, spare, table


class LongestMatch:
    """Greedy longest-match lengths of byte strings in time linear in their length.

    ``first`` are the pieces that may begin a word, ``later`` those that may follow (None: the same). A node stands for the bytes
    read since the last piece that is certain. Its failure link leads to the node for what is left after popping the pieces that greedy
    matching would fix there, and ``popped`` counts them. Links follow the published LinMaxMatch construction (Song et al., 2021), breadth first.
    """

    FEW = 64

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes] | None = None):
        edges: list[dict[int, int]] = [{}]
        final = [False]

        def add(root: int, piece: bytes):
            u = root
            for b in piece:
                if b not in edges[u]:
                    edges[u][b] = len(edges)
                    edges.append({})
                    final.append(False)
                u = edges[u][b]
            final[u] = True

        later_root = 0
        for p in first:
            if p:
                add(0, p)
        if later is not None:
            later_root = len(edges)
            edges.append({})
            final.append(False)
            for p in later:
                if p:
                    add(later_root, p)
        fail, popped = [-1] * len(edges), [0] * len(edges)
        level = [(r, b, v) for r in {0, later_root} for b, v in edges[r].items()]
        while level:
            nodes = []
            for u, b, v in level:
                if final[v]:
                    fail[v], popped[v] = later_root, 1
                else:
                    z, n = fail[u], popped[u]
                    while z >= 0 and b not in edges[z]:
                        z, n = fail[z], n + popped[z]
                    if z >= 0:
                        fail[v], popped[v] = edges[z][b], n
                nodes += [(v, c, w) for c, w in edges[v].items()]
            level = nodes
        pairs = sorted((u * 256 + b, v) for u, e in enumerate(edges) for b, v in e.items())
        self.keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.to = np.array([v for _, v in pairs] or [0], np.int32)
        self.fail, self.popped, self.root = np.array(fail, np.int32), np.array(popped, np.int32), later_root
        self.edges, self.links = dict(pairs), list(zip(fail, popped, strict=True))

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word; 1 for a word that cannot be matched (the unknown token), 0 for an empty one. All words step at once while
        ``FEW`` or more are left; the few long ones then walk on alone, since a step of arrays costs as much as hundreds of their steps."""
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        state, count, dead = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        live = len(words)
        for k in range(int(size.max(initial=0))):
            while live and size[order[live - 1]] <= k:
                live -= 1
            if live < self.FEW:
                for i in order[:live]:
                    if not dead[i]:
                        self._alone(i, words[i][k:], state, count, dead)
                break
            todo = order[:live]
            todo = todo[~dead[todo]]
            while len(todo):
                key = state[todo] * 256 + flat[start[todo] + k]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[at] == key
                state[todo[ok]] = self.to[at[ok]]
                todo = self._pop(todo[~ok], state, count, dead)
        todo = np.flatnonzero(~dead & (size > 0))
        todo = todo[state[todo] != self.root]
        while len(todo):
            todo = self._pop(todo, state, count, dead)
            todo = todo[state[todo] != self.root]
        return np.where(dead, 1, count)

    def _alone(self, i: int, rest: bytes, state, count, dead):
        """The walk of one word over the rest of its bytes."""
        edges, links, u, n = self.edges, self.links, int(state[i]), int(count[i])
        for b in rest:
            while (v := edges.get(u * 256 + b)) is None:
                u, more = links[u]
                if u < 0:
                    dead[i] = True
                    return
                n += more
            u = v
        state[i], count[i] = u, n

    def _pop(self, todo, state, count, dead):
        f = self.fail[state[todo]]
        dead[todo[f < 0]] = True
        todo, f = todo[f >= 0], f[f >= 0]
        count[todo] += self.popped[state[todo]]
        state[todo] = f
        return todo


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces_of(vocabulary: str, end_mark: str = "</w>") -> set[bytes]:
    """The strings of a byte-level vocabulary, without its mark for word ends and without special tokens."""
    from tokenizers import Tokenizer

    letters = byte_letters()
    plain = (t.removesuffix(end_mark) for t in Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=False))
    return {bytes(letters[c] for c in t) for t in plain if t and all(c in letters for c in t)}


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs' columns, then n_words, n_tokens (long): the words of the vocabulary's own pre-tokenizer and their greedy longest-match pieces.

    Null and empty texts count 0; repeated rows and ties are rows of their own; an empty table gives an empty result. Texts are read whole,
    however long. A chunk's counts are made once a worker and remembered; no shuffle. Vocabularies that look across white space are given
    whole texts. Added names that docs already has get "_" appended.
    """
    vocabulary = vocabulary or vocabulary_path()
    own, *names = spare(docs, "_text_", "n_words", "n_tokens")
    apart = split_chunks if plain_path(vocabulary) else lambda t: [t] if t else []

    def count(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        letters = byte_letters()
        tk, match = kept_by_worker(("longest match", vocabulary), lambda: (Tokenizer.from_file(vocabulary), LongestMatch(pieces_of(vocabulary))))

        def make(chunks):
            words, owner = [], []
            for i, c in enumerate(chunks):
                for w, _ in tk.pre_tokenizer.pre_tokenize_str(tk.normalizer.normalize_str(c) if tk.normalizer else c):
                    words.append(bytes(map(letters.__getitem__, w)))
                    owner.append(i)
            n = np.bincount(np.array(owner, int), minlength=len(chunks))
            pieces = np.bincount(np.array(owner, int), weights=match.lengths(words), minlength=len(chunks)).astype(int)
            return list(zip(n.tolist(), pieces.tolist(), strict=True))

        memory = kept_by_worker(("lengths", vocabulary), lambda: Memory(make))
        for batch in batches:
            texts, counts = batch.column(0), []
            for at in range(0, batch.num_rows, 256):
                split = [apart(t or "") for t in texts.slice(at, 256).to_pylist()]
                known = memory({c for s in split for c in s})
                for s in split:
                    got = [known[c] for c in s]
                    counts.append((sum(x for x, _ in got), sum(y for _, y in got)))
            new = [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = lean_batches(docs).select(F.col(text).cast("string").alias(own), *docs.columns)
    return rows.mapInArrow(released(count), ", ".join(x for x in (fields, f"`{names[0]}` long, `{names[1]}` long") if x))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: words and greedy longest-match pieces of the whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_words", "n_tokens")


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
