"""PII: exact patterns for four kinds, and a skip-chain conditional random field that carries labels between repeated and similar tokens."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, released, spare, table

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts at most that the field's weights are fitted on, those of least hash among those with a candidate token, and labelled tokens
#: of each at most, neighbours from a place that the hash picks.
SAMPLE, TOKENS = 4_000, 2_000
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of [local]+@domain, found from each @ outwards, so long runs of letters cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, by start. No kind's matches depend on another's."""
    found: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) <= 64 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# --- the field -----------------------------------------------------------------------------------------------------------------

#: A candidate: a maximal run without white space that holds a digit, an @ or a dot inside. All other tokens are outside by definition.
_TOKEN = re.compile(r"[^\s,;|<>\"'(\[{]+[^\s,;|<>\"'.!?)\]}]")
_GAP = re.compile(r"[\x20()]{1,3}")
_CUES = {"email": ("mail", "e-mail", "email", "contact"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"), "phone": ("phone", "tel", "call", "fax", "mobile", "telefon")}
LABELS = 1 + len(KINDS)
N_FEATURES = 24


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold for a token: its shape, its digits, and cue words just before it."""
    token = text[start:end]
    digits = sum(c.isdigit() for c in token)
    dots, before = token.count("."), text[max(0, start - 24) : start].lower()
    holds = [True, "@" in token, token[0] == "+", digits == 0, 1 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 12, digits >= 13, digits == len(token), dots == 0, dots == 3 and digits + 3 == len(token), dots in (1, 2) and digits < len(token) / 2, "-" in token, token[:1].isalpha(), token[-1:].isalpha(), len(token) > 24]
    holds += [any(c in before for c in _CUES[k]) for k in KINDS]
    holds += [digits >= 13 and luhn(re.sub("[^0-9]", "", token)) if digits <= 19 else False, "/" in token or "=" in token, before.endswith("+"), "_" in token]
    return [k for k, yes in enumerate(holds) if yes]


def keys_of(token: str) -> list[str]:
    """What a token shares with repeated or similar ones. Its own form: lower case, or digits alone where they are most of the token. Then what
    similar tokens share: the last seven digits of a number, and the name of an address, which may also stand alone."""
    digits, low = "".join(c for c in token if c.isdigit()), token.lower()
    if "@" in token:
        name = low.partition("@")[0]
        return ["=" + low, "@" + name] if name else ["=" + low]
    if len(digits) < 7 or 2 * len(digits) < len(token):
        return ["=" + low, "@" + low]
    dotted = token.count(".") == 3
    return ["=" + ("." if dotted else "#") + digits] + ([] if dotted else ["~" + digits[-7:]])


class SkipChain:
    """Labels O, email, ip, card, phone over a document's candidate tokens. Potentials: features x labels, a chain between neighbouring
    candidates, and skip edges between tokens that share a key. Loopy sum-product messages run a few damped rounds.

    All tokens of a key hang on one hub (a factor tying each to the key's label), so a key with n tokens has n edges, not n².
    """

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: float, rounds: int = 8):
        self.weights, self.chain, self.skip, self.rounds = weights, chain, skip, rounds

    def marginals(self, feats: list[list[int]], keys: list[list[str]], clamp: dict[int, int] | None = None) -> np.ndarray:
        n = len(feats)
        unary = np.array([self.weights[f].sum(0) for f in feats])
        for i, y in (clamp or {}).items():
            unary[i] = np.where(np.arange(LABELS) == y, 8.0, -8.0)
        often = Counter(k for own in keys for k in own)
        number = {k: h for h, k in enumerate(k for k, m in often.items() if m > 1)}
        ties = [(i, number[k]) for i, own in enumerate(keys) for k in own if k in number]
        at, hub = (np.array([t[x] for t in ties], int) for x in (0, 1))
        right, left, down = np.zeros((n, LABELS)), np.zeros((n, LABELS)), np.zeros((len(ties), LABELS))
        tie = np.where(np.eye(LABELS, dtype=bool), self.skip, 0.0)

        def out(x, pair):
            m = x[:, :, None] + pair[None]
            top = m.max(1, keepdims=True)
            r = np.log(np.exp(m - top).sum(1)) + top[:, 0]
            return r - r.max(1, keepdims=True)

        def gathered(x, to, size):
            total = np.zeros((size, LABELS))
            np.add.at(total, to, x)
            return total

        for _ in range(self.rounds):
            own = unary + gathered(down, at, n)
            if n > 1:
                new_right, new_left = np.zeros_like(right), np.zeros_like(left)
                new_right[1:] = out((own + right)[:-1], self.chain)
                new_left[:-1] = out((own + left)[1:], self.chain.T)
                right, left = 0.5 * right + 0.5 * new_right, 0.5 * left + 0.5 * new_left
            if len(ties):
                up = out((own + right + left)[at] - down, tie)
                down = 0.5 * down + 0.5 * out(gathered(up, hub, len(number))[hub] - up, tie)
            elif n <= 1:
                break
        b = unary + right + left + gathered(down, at, n)
        b = np.exp(b - b.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)


def candidates(text: str) -> list[tuple[int, int]]:
    """Where a document's candidate tokens are. Text without a digit or an @ has none."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    return [m.span() for m in _TOKEN.finditer(text) if "@" in m[0] or _DIGIT.search(m[0])]


def labelled(tokens: list[tuple[int, int]], spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """The kind (1 to 4) of each token that a base span overlaps, else 0; both lists go by start, so one walk along each does."""
    y = np.zeros(len(tokens), int)
    for kind, own in enumerate(spans, 1):
        k = 0
        for start, end in own:
            while k < len(tokens) and tokens[k][1] <= start:
                k += 1
            j = k
            while j < len(tokens) and tokens[j][0] < end:
                y[j] = y[j] or kind
                j += 1
    return y


def fit(data: list[tuple[list[list[int]], list[list[str]], list[int]]], rounds: int = 200) -> SkipChain:
    """data: a document's features, keys and base labels. Weights by pseudo-likelihood: every token's label given its neighbours'
    labels and the labels of other tokens with its keys, so each is a softmax regression and no message passing is needed to learn."""
    feats, y, prev, nxt, mates = [], [], [], [], []
    for fs, keys, labels in data:
        group = defaultdict(lambda: np.zeros(LABELS))
        for own, lab in zip(keys, labels, strict=True):
            for k in own:
                group[k][lab] += 1
        for i, (f, lab) in enumerate(zip(fs, labels, strict=True)):
            row = np.zeros(N_FEATURES)
            row[f] = 1
            feats.append(row)
            y.append(lab)
            prev.append(labels[i - 1] if i else -1)
            nxt.append(labels[i + 1] if i + 1 < len(labels) else -1)
            others = sum((group[k] for k in keys[i]), np.zeros(LABELS))
            others[lab] -= len(keys[i])
            mates.append(np.minimum(others, 3))
    w, chain, skip = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 1.0
    if not y:
        return SkipChain(w + np.where(np.arange(LABELS) == 0, 1.0, 0.0), chain, 2.0)
    x, y, prev, nxt, mates = np.array(feats), np.array(y), np.array(prev), np.array(nxt), np.array(mates)
    hot = np.eye(LABELS)[y]
    for _ in range(rounds):
        s = x @ w + skip * mates
        s += np.where(prev[:, None] >= 0, chain[prev], 0) + np.where(nxt[:, None] >= 0, chain[:, nxt].T, 0)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (hot - p) / len(y)
        w += 1.0 * (x.T @ g - 1e-4 * w)
        grad = np.zeros_like(chain)
        np.add.at(grad, prev[prev >= 0], g[prev >= 0])
        np.add.at(grad.T, nxt[nxt >= 0], g[nxt >= 0])
        chain += 0.5 * (grad - 1e-3 * chain)
        skip = float(np.clip(skip + 2.0 * (g * mates).sum(), 0.5, 6.0))
    return SkipChain(w, chain, skip)


def prepared(text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]], list[list[int]], list[list[str]], np.ndarray]:
    spans, tokens = base_spans(text), candidates(text)
    return tokens, spans, [features(text, *t) for t in tokens], [keys_of(text[a:b]) for a, b in tokens], labelled(tokens, spans)


def find(text: str, field: SkipChain, sure: float = 0.9) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
    """(base spans of each kind, spans that the field adds as kind, start, end). Tokens that a base span covers keep its label and send it
    along their edges; every other candidate whose label is not O with ``sure`` or more is added, whether its shape and context, its
    neighbours or tokens that share a key with it make it so."""
    if "@" not in text and not _DIGIT.search(text):
        return [[], [], [], []], []
    tokens, spans, feats, keys, y = prepared(text)
    if not len(tokens) or y.all():
        return spans, []
    p = field.marginals(feats, keys, {int(i): int(y[i]) for i in np.flatnonzero(y)})
    best, more = p.argmax(1), []
    for i, (start, end) in enumerate(tokens):
        if y[i] or not best[i] or p[i, best[i]] < sure:
            continue
        kind = int(best[i]) - 1
        if more and more[-1][0] == kind and y[i - 1] == 0 and more[-1][2] == tokens[i - 1][1] and _GAP.fullmatch(text, more[-1][2], start):
            start = more.pop()[1]  # one number written in groups
        more.append((kind, start, end))
    return spans, more


def learn(docs: DataFrame, sample: int = SAMPLE, most_tokens: int = TOKENS) -> SkipChain:
    """Fit on at most ``sample`` distinct texts with candidates, labelled by the exact patterns, and at most ``most_tokens`` tokens of each.
    Half of the texts by hash lose the features that repeat the patterns (luhn, three dots, the @ and + signs), so that context, chain
    and skip edges carry weight of their own. Null and empty texts have no candidates; exact copies count once, however many there
    are; without any text the field calls everything O. Other columns are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = lean_batches(docs).select(text.alias("text")).filter(F.col("text").rlike(r"@|\+[0-9]|[0-9]{7}|[0-9]\.[0-9]")).withColumn("h", F.xxhash64("text"))
    last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return fit([])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for t, h in zip(pdf["text"], pdf["h"], strict=True):
                _, _, feats, keys, y = prepared(t)
                a = h % max(1, len(y) - most_tokens + 1)
                hidden = {1, 2, 10, 20} if h % 2 else set()
                out.append(([[k for k in f if k not in hidden] for f in feats[a : a + most_tokens]], keys[a : a + most_tokens], y[a : a + most_tokens].tolist()))
            yield pd.DataFrame({"h": pdf["h"], "f": [o[0] for o in out], "keys": [o[1] for o in out], "y": [o[2] for o in out]})

    once = some.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text"))
    rows = sorted(once.mapInPandas(released(run), "h long, f array<array<int>>, keys array<array<string>>, y array<int>").collect(), key=lambda r: r["h"])
    return fit([([list(f) for f in r["f"]], [list(k) for k in r["keys"]], list(r["y"])) for r in rows if r["y"]])


def scan(docs: DataFrame, field: SkipChain) -> DataFrame:
    """docs' columns, then n_email, n_ip, n_card, n_phone (long), base and spans (arrays of kind, start, end) and masked: the text with
    every span's characters replaced by its kind in brackets. Null text counts as empty (masked stays null); texts are read whole; repeated
    rows stay; an empty table gives an empty result; clashing names get "_" appended to the added ones."""
    whole, *names = spare(docs, "_text_", *(f"n_{k}" for k in KINDS), "base", "spans", "masked")

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for t in batch.column(0).to_pylist():
                own, more = find(t or "", field)
                base = [(k, a, b) for k, s in enumerate(own) for a, b in s]
                every = sorted({*base, *more})
                for k in range(len(KINDS)):
                    cols[k].append(len(own[k]))
                for c, spans in zip(cols[4:6], (base, every), strict=True):
                    c.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
                cols[6].append(mask(t, every))
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [kind] * 2 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*batch.schema.names[1:], *names])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {t}" for n, t in zip(names, ["long"] * 4 + [span] * 2 + ["string"], strict=True)]
    return lean_batches(docs).select(F.col("text").cast("string").alias(whole), *docs.columns).mapInArrow(released(run), ", ".join(fields))


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with [KIND] in place of spans; of overlapping spans the first to start names the place."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: the contract's counts and digest, and all spans as one string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    counts = [f"n_{k}" for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def pipeline_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their spans masked and n_chars counted again."""
    found = scan(docs, learn(docs.select("text")))
    new = {"text": F.col(found.columns[-1])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(found.columns[-1])).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(new).select(*docs.columns)


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
