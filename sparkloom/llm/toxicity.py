"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model over them, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_batches, released, spare, stored, table

#: Labelled rows, about, that the lexicon is mined from and the classifier is fitted on, picked by a hash of their id; and as many unlabelled ones.
SAMPLE = 20_000
#: Labelled rows that a feature must stand in to be mined, whatever the size of the sample.
LEAST = 3
#: How sure a label of the learning fold is, as one more voter on its row, and how much a row without a label weighs.
SURE, UNLABELLED = 0.999, 0.1
THRESHOLD = 0.3
LEXICON_VOTERS = 8
#: Insults that are voters whatever the labels hold. Mined entries join them.
CURATED = (
    "idiot idiots stupid moron morons scum trash garbage pathetic worthless loser losers disgusting clown dumb dumbass imbecile cretin "
    "bastard bitch asshole shit fuck fucking retard retarded whore slut vermin filth subhuman "
    "idiota estúpido imbécil basura mierda asqueroso inútil puta "
    "crétin connard imbécile ordure merde salope débile "
    "dummkopf vollidiot abschaum arschloch scheiße hure missgeburt drecksau"
).split()
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
_TEMPLATE = re.compile(r"\b(?:you are|you're|du bist|tu es|eres) (?:a|an|ein|eine|un|una|such a|so) \w+", re.I)
_MASKED = re.compile(r"\b[A-Za-z]+[*@$#]{1,3}[A-Za-z]+\b")
_THREAT = re.compile(r"\b(?:kill|die|hate|shut up|get lost|verrecke|hasse|crève|muere|odio)\b", re.I)


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> set[str]:
    """Distinct words in lower case; as "4:..." to "6:..." their first letters, stems that only inflected forms show; and as "4+..." to
    "6+..." the stems of two distinct words or more, which ordinary words hardly share."""
    ws = distinct_words(text)
    out = set(ws)
    for k in STEMS:
        n = Counter(w[:k] for w in ws if len(w) > k)
        out.update(f"{k}:{s}" for s in n)
        out.update(f"{k}+{s}" for s, m in n.items() if m > 1)
    return out


def is_stem(feature: str) -> bool:
    return feature[1:2] in (":", "+")  # words hold neither


class Entries:
    """Looks up words and stems without writing out a text's features. entries: feature -> value."""

    def __init__(self, entries: dict):
        self.words = {f: v for f, v in entries.items() if not is_stem(f)}
        self.stems: dict[int, dict[str, list]] = {}
        for f, v in entries.items():
            if is_stem(f):
                self.stems.setdefault(int(f[0]), {}).setdefault(f[2:], [None, None])[f[1] == "+"] = v

    def __call__(self, ws: set[str]) -> list:
        """The values of the features that hold, one each."""
        out = [self.words[w] for w in ws & self.words.keys()]
        for k, stems in self.stems.items():
            for s, n in Counter(s for w in ws if (s := w[:k]) in stems and len(w) > k).items():
                out += [v for v in stems[s][: 1 + (n > 1)] if v is not None]
        return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Votes:
    """The voters. A vote is one bit; all of them make one int."""

    def __init__(self, lexicon: list[str]):
        self.of = Entries({w: k % LEXICON_VOTERS for k, w in enumerate(lexicon)})
        self.count = LEXICON_VOTERS + 7

    def __call__(self, text: str) -> int:
        low = text.lower()
        ws = set(_WORD.findall(low))
        hits, bits = self.of(ws), 0
        for v in hits:
            bits |= 1 << v
        # a few letters (İ) get longer in lower case and would shift all that follows: then letter by letter
        n, loud = len(hits), sum(map(operator.ne, text, low if len(low) == len(text) else map(str.lower, text)))
        more = (n >= 3, n * 100 >= max(len(ws), 1), bool(_TEMPLATE.search(text)), bool(_MASKED.search(text)), loud * 3 > len(text), bool(_THREAT.search(text)), n == 0)
        return bits | sum(1 << LEXICON_VOTERS + k for k, yes in enumerate(more) if yes)


class LabelModel:
    """Two classes; voters are independent given the class but for pairs found to be correlated, which are modelled jointly. A voter
    (or pair) that does not fire abstains, which is no evidence; that no lexicon entry stands in a text is a vote of its own.

    Fitted by EM on counts of vote patterns, with rows of known class (the learning fold's) as anchors that keep their class: voters for
    different languages hardly ever fire together, and without anchors their class would drift. After a first fit, the correlation that is left between two voters given the class is
    estimated; pairs above ``linked``, strongest first, each voter in one pair at most, become one voter of four values, and EM runs again.
    """

    def __init__(self, voters: int, linked: float = 0.15):
        self.voters, self.linked, self.groups = voters, linked, [(k,) for k in range(voters)]

    def _values(self, patterns: np.ndarray) -> np.ndarray:
        bits = patterns[:, None] >> np.arange(self.voters) & 1
        return np.stack([sum(bits[:, v] << i for i, v in enumerate(g)) for g in self.groups], 1)

    def _maximise(self, values, counts, post):
        self.prior = np.clip((counts * post).sum() / counts.sum(), 0.005, 0.5)
        self.tables = []
        for k, g in enumerate(self.groups):
            both = [np.bincount(values[:, k], counts * p, 1 << len(g)) + s for p, s in ((1 - post, 1.0), (post, 0.1))]
            self.tables.append(np.log([b / b.sum() for b in both]))
            self.tables[-1][:, 0] = 0

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        values = self._values(np.asarray(patterns, np.int64))
        odds = np.log(self.prior / (1 - self.prior)) + sum(t[1][values[:, k]] - t[0][values[:, k]] for k, t in enumerate(self.tables))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def fit(self, patterns, counts, start, known=(), known_class=(), known_counts=()) -> LabelModel:
        n, known_class = len(patterns), np.asarray(known_class, float)
        patterns = np.concatenate([np.asarray(patterns, np.int64), np.asarray(known, np.int64)])
        counts = np.concatenate([np.asarray(counts, float), np.asarray(known_counts, float)])
        post = np.concatenate([np.asarray(start, float), known_class])
        for again in (False, True):
            if again:
                self._pair(patterns, counts, post)
            values = self._values(patterns)
            for _ in range(50):
                self._maximise(values, counts, post)
                before, post = post, np.concatenate([self.posterior(patterns[:n]), known_class])
                if np.abs(before - post).max() < 1e-4:
                    break
        return self

    def _pair(self, patterns, counts, post):
        bits = (patterns[:, None] >> np.arange(self.voters) & 1).astype(float)
        left = np.zeros((self.voters, self.voters))
        for p in (post, 1 - post):
            w = counts * p
            x = bits - (w @ bits) / max(w.sum(), 1e-9)
            c = (x * w[:, None]).T @ x
            d = np.sqrt(np.maximum(np.diag(c), 1e-9))
            left = np.maximum(left, np.abs(c / d / d[:, None]))
        free, pairs = set(range(self.voters)), []
        for r, i, j in sorted(((left[i, j], i, j) for i in range(self.voters) for j in range(i)), reverse=True):
            if r >= self.linked and {i, j} <= free:
                free -= {i, j}
                pairs.append((j, i))
        self.groups = [(k,) for k in sorted(free)] + pairs


def fit_linear(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, l1: float = 2e-5, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features (row and column of each 1) and soft labels of weighted rows: proximal gradient with momentum, L1 on
    weights."""
    n, w, v, b, vb, t = len(y), np.zeros(width), np.zeros(width), -2.0, -2.0, 1.0
    total, heavy = max(weight.sum(), 1e-9), np.bincount(rows, minlength=max(n, 1)).max(initial=1)
    step = 4.0 * total / max(np.bincount(cols, weight[rows], minlength=max(width, 1)).max(initial=0), total) / max(1.0, np.sqrt(heavy))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(rows, v[cols], n), -40, 40)))
        g = weight * (p - y) / total
        new = v - step * np.bincount(cols, g[rows], width)
        new, nb = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0), vb - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b)


def _counted(sample: DataFrame, target: str, least: int) -> list:
    """(feature, rows, sum of target, z) of all features in ``least`` rows or more that lean to either side; counted on the executors. As many
    as a sample of bounded rows shows."""

    def count(batches):
        import pandas as pd

        n: dict[str, float] = {}
        s: dict[str, float] = {}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf[target], strict=True):
                for f in features(text):
                    n[f] = n.get(f, 0) + 1
                    s[f] = s.get(f, 0.0) + y
            if len(n) > 50_000:
                yield pd.DataFrame({"f": list(n), "n": list(n.values()), "s": [s[f] for f in n]})
                n, s = {}, {}
        yield pd.DataFrame({"f": pd.Series(list(n), dtype=str), "n": pd.Series(list(n.values()), dtype=float), "s": pd.Series([s[f] for f in n], dtype=float)})

    total = sample.agg(F.count("*"), F.sum(target)).first()
    base = (total[1] or 0.0) / max(total[0], 1)
    counted = sample.select("text", target).mapInPandas(released(count), "f string, n double, s double").groupBy("f").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter(F.col("n") >= least)
    z = (F.col("s") - F.col("n") * base) / F.sqrt(F.col("n") * max(base * (1 - base), 1e-6))
    return counted.withColumn("z", z).filter(F.abs("z") >= 4).orderBy(F.desc(F.abs("z")), "f").collect()


def _own(found: list) -> list:
    """Without stems that one word alone makes: those say no more than the word, and meet other words elsewhere."""
    alone: dict[str, float] = {}
    for r in found:
        if not is_stem(r["f"]):
            for k in STEMS:
                stem = f"{k}:{r['f'][:k]}"
                alone[stem] = max(alone.get(stem, 0), r["n"])
    return [r for r in found if alone.get(r["f"], 0) < 0.8 * r["n"]]


def signatures(batches):
    """_r and 16 least hashes of each text's five-word shingles."""
    import hashlib

    import pandas as pd

    odd = np.random.default_rng(0).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            ws = text.lower().split()
            grams = {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
            h = np.array([int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for g in grams], np.uint64)
            with np.errstate(over="ignore"):
                out.append((h[:, None] * odd[None, :]).min(0).view(np.int64))
        yield pd.DataFrame({"_r": pdf["_r"], "sig": out})


def without_copies(rows: DataFrame, alike: int = 10) -> DataFrame:
    """rows: _r, text, y. One row of each group of near copies, so that the rare words of one text with many copies look as rare as they are.

    Rows that agree on ``alike`` of 16 least hashes with a row that stays (a Jaccard of about 0.6 and more) are copies of it; the least key
    stays. A shared passage alone makes no copy. Only the signatures of the bounded sample come to the driver.
    """
    found = sorted((r["_r"], r["sig"]) for r in rows.select("_r", "text").mapInPandas(released(signatures), "_r long, sig array<long>").collect())
    sigs = np.array([sig for _, sig in found], np.int64).reshape(-1, 16)
    met: list[dict[int, list[int]]] = [{} for _ in range(16)]
    copies = []
    for i, (key, sig) in enumerate(found):
        near = {j for at, h in zip(met, sig, strict=True) for j in at.get(h, ())}
        if near and ((sigs[list(near)] == sigs[i]).sum(1) >= alike).any():
            copies.append((key,))
        else:
            for at, h in zip(met, sig, strict=True):
                at.setdefault(h, []).append(i)
    if not copies:
        return rows
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(copies, "_r long")), "_r", "left_anti")


def mine(found: list, base: float, least: int = LEAST) -> list[str]:
    """Entries that are toxic in most rows where they stand, and stand in ``least`` toxic rows or more (near copies counted once). Forms of a
    stem that is itself an entry are left out."""
    kept: list[str] = []
    stems: set[str] = set()
    for f in sorted((r for r in found if r["z"] > 0 and r["s"] >= least and r["s"] / r["n"] >= max(0.8, 3 * base)), key=lambda r: (-r["z"], r["f"])):
        word = f["f"][2:] if is_stem(f["f"]) else f["f"]
        if not any(word[:k] in stems for k in STEMS):
            kept.append(f["f"])
            if f["f"][1:2] == ":":
                stems.add(word)
    return kept


class Model:
    """What a scoring pass needs: a few thousand weights."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.entries, self.bias = Entries(weights), bias

    def score(self, text: str) -> float:
        s = self.bias + math.fsum(self.entries(distinct_words(text)))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, s))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic; only rows of the learning fold are used.

    The lexicon is mined from about ``sample`` labelled ids at most, picked by hash, one text each (the least where an id has more). The label
    model's counts of vote patterns are taken over all documents; there are 2 to the number of voters patterns at most. The classifier learns
    posteriors: of the labelled rows, where the label is one more voter, and, with less weight, of about ``sample`` rows of the learning
    fold without a label. Null labels and ids without a document are left out, null texts count as empty; without labels the curated
    entries vote alone, and without documents the model is empty.
    """
    docs = lean_batches(docs)
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    share = sample / max(known.count(), 1)
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(text).alias("text"), F.max("y").alias("y"))
    rows = stored(rows.select(F.xxhash64("doc_id", "text").alias("_r"), "text", "y"))
    rows = stored(without_copies(rows).select("text", "y"))
    base = rows.agg(F.avg("y")).first()[0] or 0.0
    lexicon = list(dict.fromkeys([*mine(_own(_counted(rows, "y", LEAST)), base), *CURATED]))
    votes = Votes(lexicon)

    def vote(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"votes": [votes(t) for t in pdf["text"]]})

    def vote_known(batches):
        for pdf in batches:
            yield pdf.assign(votes=[votes(t) for t in pdf["text"]])[["votes", "y"]]

    patterns = docs.select(text).mapInPandas(released(vote), "votes long").groupBy("votes").count().collect()
    bits, counts = np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], float)
    if not len(bits):
        return Model({}, -3.0)
    start = np.where(bits & ((1 << LEXICON_VOTERS) - 1), 0.8, 0.02)
    anchors = rows.select("text", "y").mapInPandas(released(vote_known), "votes long, y double").groupBy("votes", "y").count().collect()
    label = LabelModel(votes.count).fit(bits, counts, start, *([r[k] for r in anchors] for k in range(3)))
    if (counts * label.posterior(bits)).sum() <= 0:
        return Model({}, -3.0)

    def posterior(batches):
        for pdf in batches:
            p = np.clip(label.posterior(np.array([votes(t) for t in pdf["text"]], np.int64)), 1e-6, 1 - 1e-6)
            y = pdf["y"].to_numpy(float)
            odds = np.log(p / (1 - p)) + np.where(np.isnan(y), 0.0, np.sign(y - 0.5) * math.log(SURE / (1 - SURE)))
            yield pdf.assign(weight=np.where(np.isnan(y), UNLABELLED, 1.0), y=1 / (1 + np.exp(-odds)))

    share = min(1.0, sample / counts.sum())
    other = docs.filter(~held_out(F.col("doc_id")) & (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    other = other.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").groupBy("doc_id").agg(F.min(text).alias("text"))
    every = rows.unionByName(other.select("text", F.lit(None).cast("double").alias("y")))
    soft = stored(every.mapInPandas(released(posterior), "text string, y double, weight double"))
    names = [r["f"] for r in _own(_counted(soft.filter("weight = 1"), "y", LEAST))]
    at = {f: i for i, f in enumerate(names)}

    def columns(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "weight": pdf["weight"], "at": [sorted(at[f] for f in features(t) if f in at) for t in pdf["text"]]})

    data = soft.mapInPandas(released(columns), "y double, weight double, at array<int>").toPandas()
    data["at"] = data["at"].map(tuple)
    data = data.sort_values(["weight", "y", "at"], kind="stable", ignore_index=True)
    if not len(data) or not names:
        return Model({w: 3.0 for w in lexicon}, -3.0)
    rows_of = np.repeat(np.arange(len(data)), [len(a) for a in data["at"]])
    cols = np.concatenate([np.asarray(a, np.int64) for a in data["at"]])
    w, b = fit_linear(rows_of, cols, data["y"].to_numpy(), data["weight"].to_numpy(), len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, b)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns, then held_out, score, predicted. Null text counts as empty, a null id as held out or not by the empty text; equal texts
    score alike; repeated rows stay; an empty table gives an empty result; clashing names get "_" appended to the added ones."""
    own, *names = spare(docs, "_text_", "held_out", "score", "predicted")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = np.array([model.score(t or "") for t in batch.column(0).to_pylist()], float)
            cols = [pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *names[1:]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    scored = lean_batches(docs).select(F.col("text").cast("string").alias(own), *docs.columns).mapInArrow(released(run), f"{fields}, `{names[1]}` double, `{names[2]}` int")
    return scored.withColumn(names[0], held_out(F.col("doc_id"))).select(*docs.columns, *names)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: the fold, the score of the whole text, and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def pipeline_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the threshold."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.filter(F.col(scored.columns[-1]) == 0).select(*docs.columns)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
