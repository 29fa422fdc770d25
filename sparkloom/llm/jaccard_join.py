"""N-gram Jaccard self-join by chosen paths: sets are split again and again on sampled shared tokens, small buckets compared in full."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, freed, lean_batches, released, spare, stored, table

WIDTH, LEAST = 5, 0.8
RECALL = 0.9999
SMALL, DEPTH, BLOCK = 500, 6, 1024
#: Shingles of all sets that one task holds at once (8 bytes each), besides a set that is longer alone.
TOKENS = 4_000_000
#: A large bucket is settled by its core where at most one in so many of its sets is loose.
DENSE = 2
#: Common children, on average at the least, of a pair below a bucket that is split on by what its core lacks.
CHILDREN = 5.0
#: Keys of rows up to so many are sent to the texts (16 bytes each); beyond it texts and keys meet by a shuffle.
BROADCAST = 2_000_000


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until every pair at the bound is met with that probability. A pair that shares o tokens has o / (LEAST * the larger size) common
    children at a node on average, as Poisson or surer. At the bound that is 2 / (1 + LEAST) for equal sizes and least, 1, where one set
    holds the other, so 1 is taken for the first two levels; below, in large buckets, it is CHILDREN or more (see ``kids``)."""
    lost = 0.0
    for level in range(depth, 0, -1):
        lost = math.exp((CHILDREN if level > 2 else 1.0) * (lost - 1))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending. A shingle is five words in lower case; fewer words make one shingle, none make none."""
    import pandas as pd

    table_ = str.maketrans(dict.fromkeys(SPACES, " "))
    split = [[w for w in (t or "").lower().translate(table_).split(" ") if w] for t in texts]
    sizes = np.array([len(s) for s in split])
    flat = np.array([w for s in split for w in s], dtype=object)
    h = pd.util.hash_array(flat, categorize=False).astype(np.uint64) if len(flat) else np.zeros(0, np.uint64)
    prime, out = np.uint64(0x9E3779B97F4A7C15), []
    with np.errstate(over="ignore"):
        every = np.zeros(max(len(h) - WIDTH + 1, 0), np.uint64)
        for k in range(WIDTH):
            every = mixed(every * prime + h[k : k + len(every)])
        at = 0
        for n in sizes:
            if n >= WIDTH:
                out.append(np.unique(every[at : at + n - WIDTH + 1]))
            elif n:
                one = np.uint64(n)
                for x in h[at : at + n]:
                    one = mixed(np.array([one * prime + x], np.uint64))[0]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def set_key(s: np.ndarray) -> np.uint64:
    """One number for a set: equal sets have equal keys."""
    with np.errstate(over="ignore"):
        return mixed(np.array([s.sum(dtype=np.uint64) * np.uint64(3) + np.uint64(len(s)), np.bitwise_xor.reduce(mixed(s)) if len(s) else np.uint64(7)], np.uint64)).sum(dtype=np.uint64)


def children(s: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of node, child) for each token of s chosen at each node: with probability 1 / (LEAST |s|), by a hash of node and token."""
    if not len(s) or not len(nodes):
        return np.zeros(0, int), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        x = mixed(mixed(nodes)[:, None] + s[None, :])
    bar = np.uint64(min(2**64 - 1, int(2**64 / (LEAST * len(s)))))
    i, j = np.nonzero(x <= bar)
    return i, mixed(x[i, j] ^ nodes[i])


def roots_of(first: int, last: int) -> np.ndarray:
    """The roots of runs first to last - 1."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def row_key() -> Column:
    """Rows with equal ids and equal keys hold the same text, but for chance."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def few(keys: DataFrame) -> DataFrame:
    """keys marked for broadcast if they are at most BROADCAST rows, counted; else as they are."""
    keys = stored(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def marked(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, _r (the row's key), _k (key of the document's set), _n (its size), _paths (the nodes it chooses two levels below the root of
    each run: one shared passage puts many documents together at the first level, hardly ever at the second)."""
    roots = roots_of(0, runs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(2).to_pylist())
                keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
                paths = [children(s, children(s, roots)[1])[1].view(np.int64) for s in sets]
                new = [pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(paths, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], names=["doc_id", "_r", "_k", "_n", "_paths"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return lean_batches(docs).select("doc_id", row_key().alias("_r"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), f"doc_id {kind}, _r long, _k long, _n long, _paths array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """_k, _set for the wanted (doc_id, _r, _k): their texts are read again, so no set of a document without a partner is ever stored. Rows
    are met by id and key of the row, so rows without an id, or with one id, do not meet one another.
    ``repeated``: some rows have equal ids and equal sets, so a wanted set may come more than once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ks = part.column(0).to_numpy(zero_copy_only=False)
                sets = shingle_sets(part.column(1).to_pylist())
                own = [i for i, s in enumerate(sets) if set_key(s).view(np.int64) == ks[i]]
                yield pa.RecordBatch.from_arrays([pa.array(ks[own], pa.int64()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["_k", "_set"])

    w = few(wanted.select(F.col("doc_id").alias("_id"), F.col("_r").alias("_own"), "_k"))
    texts = docs.select("doc_id", row_key().alias("_r"), F.col("text").cast("string").alias("text"))
    found = texts.join(w, (F.col("_r") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.select("_k", "text").mapInArrow(released(run), "_k long, _set array<long>")
    return found.dropDuplicates(["_k"]) if repeated else found


def groups(batches, key: str):
    """Whole groups of a key from batches that are sorted by it."""
    import pandas as pd

    held = None
    for pdf in batches:
        if held is not None and len(held):
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        v = pdf[key].to_numpy()
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        for a, b in zip([0, *cut[:-1]], cut, strict=False):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cut[-1] if len(cut) else 0 :]
    if held is not None and len(held):
        yield held


def links(sets: list[np.ndarray], cells: int = 8_000_000) -> np.ndarray:
    """Which pairs have Jaccard >= LEAST, as a square of booleans. Tokens in one set only are left out; the others' incidence matrix is
    multiplied with itself a stripe of columns at a time, so memory stays near ``cells`` numbers."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = np.array([[size[0], len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        both[1] = both[0][::-1]
        both[1, 1] = size[1]
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        often = np.bincount(column, minlength=len(values)) > 1
        number = np.cumsum(often) - 1
        keep = often[column]
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both, wide = np.zeros((n, n), np.float32), max(1, cells // n)
        for a in range(0, int(number[-1]) + 1 if len(number) else 0, wide):
            lo, hi = np.searchsorted(column, [a, a + wide])
            m = np.zeros((n, min(wide, int(column[hi - 1]) - a + 1) if hi > lo else 0), np.float32)
            m[row[lo:hi], column[lo:hi] - a] = 1
            both += m @ m.T
    either = size[:, None] + size[None, :] - both
    found = both >= LEAST * either - 1e-6 * either
    np.fill_diagonal(found, False)
    return found


def compared(rows: DataFrame, emit, schema: str) -> DataFrame:
    """rows: _g, _k, _weight, _set. emit(keys, weights, linked) for each _g. Groups lie together by a hash partitioning and are read one at a time."""

    def run(batches):
        import pandas as pd

        for g in groups(batches, "_g"):
            if len(g) < 2:
                continue
            out = emit(g["_k"].to_numpy(), g["_weight"].to_numpy(), links([np.asarray(s, np.int64).view(np.uint64) for s in g["_set"]]))
            if len(out[0]):
                yield pd.DataFrame(dict(zip([x.split()[0] for x in schema.split(", ")], out, strict=True)))

    return rows.select("_g", "_k", "_weight", "_set").repartition("_g").sortWithinPartitions("_g").mapInPandas(released(run), schema)


# --- large groups: all pairs without dealing all sets over pairs of blocks -----------------------------------------------------------
#
# Let C be any set of shingles, the core. A set x lacks d shingles of C and has e others; _d is both kinds together, its delta, and
# _w = 5 d + 4 e. Two sets share |C| - d - d' + s shingles, where s counts what their deltas share, so
#     Jaccard >= 4/5   if and only if   w + w' <= |C| + 9 s.
# Near copies lie close to a core: most pairs are decided by two numbers, and the deltas of the rest are a fraction of the sets.


def overlaps(a: list[np.ndarray], b: list[np.ndarray], cells: int = 8_000_000) -> np.ndarray:
    """How many numbers each of a shares with each of b, a stripe of numbers at a time."""
    (ta, ra), (tb, rb) = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b))
    shared, out = np.intersect1d(ta, tb), np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    wide = max(1, cells // max(len(a), len(b)))

    def placed(t, r):
        at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
        keep = shared[at] == t
        order = np.argsort(at[keep], kind="stable")
        return at[keep][order], r[keep][order]

    (ca, ra), (cb, rb) = placed(ta, ra), placed(tb, rb)
    for lo in range(0, len(shared), wide):
        m = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            i, j = np.searchsorted(c, [lo, lo + wide])
            x = np.zeros((n, min(wide, len(shared) - lo)), np.float32)
            x[r[i:j], c[i:j] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def parts_of(block: int) -> Column:
    """Into how many parts a group of _m sets with _t shingles in all is cut."""
    return F.greatest(F.ceil(F.col("_m") / block), F.ceil(F.col("_t") / TOKENS), F.lit(1)).cast("int")


def spread(one: DataFrame) -> DataFrame:
    """A row a group (_g, _nb, ...) as a row a part, so that a large group's rows do not meet in one task to learn of it."""
    return one.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))


def deltas(members: DataFrame, own: DataFrame) -> DataFrame:
    """members: _g, _nb, _k, _weight. own: _k, _set. A row a member: _g, _nb, _c (its part), _k, _weight, _w, _n (size of the core), _s (size of
    the set), _d.

    A group's core is what more than half of its first part's sets hold. Which core is taken only changes how much work is left.
    """

    def cores(batches):
        import pandas as pd

        for g in groups(batches, "_g"):
            values, n = np.unique(np.concatenate([np.asarray(s, np.int64) for s in g["_set"]]), return_counts=True)
            yield pd.DataFrame({"_g": [g["_g"].iloc[0]], "_nb": [g["_nb"].iloc[0]], "_core": [values[2 * n > len(g)]]})

    def differences(batches):
        for pdf in batches:
            w, n, size, d = [], [], [], []
            for s, core in zip(pdf.pop("_set"), pdf.pop("_core"), strict=True):
                s, core = np.asarray(s, np.int64), np.asarray(() if core is None else core, np.int64)
                delta = np.setxor1d(s, core, assume_unique=True)
                more = (len(delta) + len(s) - len(core)) // 2
                w.append(5 * (len(delta) - more) + 4 * more)
                n.append(len(core))
                size.append(len(s))
                d.append(delta)
            yield pdf.assign(_w=w, _n=n, _s=size, _d=d)

    rows = members.withColumn("_c", F.pmod(F.xxhash64(F.lit(11), "_k"), F.col("_nb")).cast("int"))
    first = rows.filter("_c = 0").join(own, "_k").select("_g", "_nb", "_set").repartition("_g").sortWithinPartitions("_g")
    core = spread(first.mapInPandas(released(cores), "_g long, _nb int, _core array<long>")).drop("_nb")
    rows = rows.join(own, "_k").join(core, ["_g", "_c"], "left")
    return rows.select("_g", "_nb", "_c", "_k", "_weight", "_set", "_core").mapInPandas(released(differences), "_g long, _nb int, _c int, _k long, _weight long, _w long, _n long, _s long, _d array<long>")


def met(rows: DataFrame, counting: bool) -> DataFrame:
    """Loose sets against all sets of their groups. rows: as ``deltas`` gives them, with _loose. Each loose set visits every part of its group;
    a part's own sets are held, the visitors stream by.

    Not counting: edges a, b that join what is linked; sets that are not loose count as joined already. Counting: _k, n, the documents
    that a set is linked with through a pair that its two numbers do not decide. A pair of loose sets is met twice, and counts for the
    visitor; a pair with one loose set is met once, and counts for both.
    """

    def run(batches):
        import pandas as pd

        at, own = None, None

        def fresh():
            return {c: [] for c in ("_k", "_weight", "_w", "_n", "_d", "_loose")}

        def closed(own):
            out = {c: np.array(v) for c, v in own.items() if c != "_d"} | {"_d": own["_d"]}
            out["label"] = np.where(out["_loose"], np.arange(1, len(out["_k"]) + 1), 0)
            out["n"] = np.zeros(len(out["_k"]), np.int64)
            return out

        def counts(own):
            return pd.DataFrame({"_k": own["_k"], "n": own["n"]})[own["n"] > 0]

        for pdf in batches:
            g, c, side = (pdf[x].to_numpy() for x in ("_g", "_c", "_side"))
            cut = np.flatnonzero((g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, len(pdf)], strict=True):
                if i == j:
                    continue
                part = pdf.iloc[i:j]
                if (g[i], c[i]) != at:
                    if counting and own is not None and "n" in own:
                        yield counts(own)
                    at, own = (g[i], c[i]), fresh()
                if not side[i]:
                    for x in own:
                        own[x] += [np.asarray(d, np.int64) for d in part[x]] if x == "_d" else part[x].tolist()
                    continue
                if "n" not in own:
                    if not own["_k"]:
                        continue
                    own = closed(own)
                k, w, weight = (part[x].to_numpy() for x in ("_k", "_w", "_weight"))
                far = w[:, None] + own["_w"][None, :] - own["_n"][None, :]
                found = 9 * overlaps([np.asarray(d, np.int64) for d in part["_d"]], own["_d"]) >= far - 0.5
                found &= k[:, None] != own["_k"][None, :]
                if counting:
                    found &= far > 0
                    own["n"] += np.where(own["_loose"], 0, weight @ found)
                    n = found @ own["_weight"]
                    yield pd.DataFrame({"_k": k, "n": n})[n > 0]
                    continue
                a, b, label = [], [], own["label"]
                for x in np.flatnonzero(found.any(1)):
                    to = np.flatnonzero(found[x])
                    names, first = np.unique(label[to], return_index=True)
                    a += [k[x]] * len(names)
                    b += own["_k"][to[first]].tolist()
                    if len(names) > 1:
                        label[np.isin(label, names)] = names[0]
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
        if counting and own is not None and "n" in own:
            yield counts(own)

    cols = ["_k", "_weight", "_w", "_n", "_d", "_loose"]
    home = rows.select("_g", "_c", F.lit(0).alias("_side"), *cols)
    away = spread(rows.filter("_loose").drop("_c")).select("_g", "_c", F.lit(1).alias("_side"), *cols)
    both = home.unionByName(away).repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_side")
    return both.mapInPandas(released(run), "_k long, n long" if counting else "a long, b long")


def settled(large: DataFrame, own: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """large: _p, _nb, _k. (edges a, b; the children _p, _k, _n of the buckets that are split on, None with ``last``).

    The set nearest to the core is the hub. Sets that are linked to it by their two numbers get an edge to it; the others are loose. In
    a bucket with few loose sets, and with ``last`` in all, those meet all others. Other buckets are split on.
    """
    members = large.select(F.col("_p").alias("_g"), F.col("_nb"), "_k", F.lit(1).cast("long").alias("_weight"))
    d = stored(deltas(members, own))
    hubs = d.groupBy("_g", "_nb").agg(F.min(F.struct("_w", "_k")).alias("_hub"))
    d = d.join(spread(hubs).drop("_nb"), ["_g", "_c"]).withColumn("_loose", F.col("_w") + F.col("_hub._w") > F.col("_n"))
    sums = d.groupBy("_g", "_nb").agg(F.count("*").alias("_m"), F.sum(F.col("_loose").cast("long")).alias("_l"))
    sums = stored(sums.withColumn("_done", F.lit(last) | (DENSE * F.col("_l") <= F.col("_m"))))
    d = d.join(spread(sums).select("_g", "_c", "_done", "_l"), ["_g", "_c"])
    near = d.filter("NOT _loose AND _k <> _hub._k").select(F.col("_hub._k").alias("a"), F.col("_k").alias("b"))
    edges = near.unionByName(met(d.filter("_done AND _l > 0"), False))
    if last or sums.filter("NOT _done").isEmpty():
        return edges, None
    return edges, d.filter("NOT _done").select("_g", "_k", "_w", F.col("_hub._w").alias("_h"), "_n", "_s", "_d").mapInPandas(released(kids), "_p long, _k long, _n long")


def kids(batches):
    """The children of a bucket that is split on: tokens of a set's delta, chosen by a hash of bucket and token; the core, which all hold, splits
    nothing. A set is linked with no set by fewer than t = (_w + the hub's _w - |C|) / 9 shared tokens of their deltas, if one of the two
    is loose, and chooses each token with probability CHILDREN / t: so linked sets have CHILDREN common children or more on average."""
    import pandas as pd

    for pdf in batches:
        ps, ks, ns = [], [], []
        for g, k, w, h, n, size, d in zip(pdf["_g"], pdf["_k"], pdf["_w"], pdf["_h"], pdf["_n"], pdf["_s"], pdf["_d"], strict=True):
            least = max(1, -(-(w + h - n) // 9))
            node = mixed(np.array([g], np.int64).view(np.uint64))
            with np.errstate(over="ignore"):
                x = mixed(node + np.asarray(d, np.int64).view(np.uint64))
            x = x if least <= CHILDREN else x[x <= np.uint64(int(2**64 * (CHILDREN / least)))]
            ps.append(mixed(x ^ node).view(np.int64))
            ks.append(np.full(len(x), k, np.int64))
            ns.append(np.full(len(x), size, np.int64))
        if ps:
            yield pd.DataFrame({"_p": np.concatenate(ps), "_k": np.concatenate(ks), "_n": np.concatenate(ns)})


def counted(members: DataFrame, own: DataFrame) -> DataFrame:
    """members: _g, _nb, _k, _weight, in large groups. _k, n: documents that a set is linked with inside its group, other than its own: those
    by the two numbers alone from the histogram of one of them, the others by meeting."""
    d = stored(deltas(members, own))
    every = d.groupBy("_g", "_nb", "_w").agg(F.sum("_weight").alias("_sum"))

    def below(key, own, all_):
        import pandas as pd

        all_ = all_.sort_values("_w")
        up_to = np.concatenate([[0], np.cumsum(all_["_sum"].to_numpy())])
        w, core = own["_w"].to_numpy(), own["_n"].to_numpy()
        n = up_to[np.searchsorted(all_["_w"].to_numpy(), core - w, "right")] - np.where(2 * w <= core, own["_weight"].to_numpy(), 0)
        return pd.DataFrame({"_k": own["_k"], "n": n})

    sure = d.select("_g", "_c", "_k", "_weight", "_w", "_n").groupBy("_g", "_c").cogroup(spread(every).select("_g", "_c", "_w", "_sum").groupBy("_g", "_c")).applyInPandas(below, "_k long, n long")
    top = d.groupBy("_g", "_nb").agg(F.max("_w").alias("_top"))
    d = d.join(spread(top).drop("_nb"), ["_g", "_c"]).filter("_w + _top > _n").withColumn("_loose", F.expr("2 * _w > _n"))
    return sure.unionByName(met(d, True))


def star(k: np.ndarray, _, found: np.ndarray):
    """Edges that join every connected part of the found links, at most one a member."""
    left, a, b = found.any(1), [], []
    while left.any():
        part = front = np.eye(len(k), dtype=bool)[int(left.argmax())]
        while front.any():
            front = found[front].any(0) & ~part
            part = part | front
        root, *rest = k[part]
        a += [root] * len(rest)
        b += rest
        left &= ~part
    return np.array(a, np.int64), np.array(b, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node, root (its part's least node) for all nodes of the edges (a, b), by alternating large and small stars until nothing changes."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(docs: DataFrame, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _r and _k of every row; _k, _class, _links, _weight, _first, _row of every distinct set).

    1. Documents with equal sets are one set, with their number as weight. 2. In each of ``runs_for(recall, depth)`` runs a set chooses
    tokens and goes to a bucket for each, two levels down. A bucket of one set ends; one of up to ``small`` sets and ``TOKENS`` shingles is
    compared in full by one task. A larger one is settled by its core where most of its sets lie close to that; where they do not, it is
    split once more by tokens that its core lacks (see ``settled``), down to ``depth``, and compared in full there. 3. Buckets with the
    same members are one. Only edges that span what is linked leave a bucket. 4. Connected parts are the classes. 5. Inside each class all
    pairs are decided once more to count each document's links, so links that no run met count too: small classes in full, large ones by
    their core (``counted``). Rows of a large group grow with its size, and with its loose sets times its parts of ``block`` sets.
    """
    rows = stored(marked(docs, runs_for(recall, max(depth, 2))))
    sets = rows.groupBy("_k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_r")).alias("_one"), F.count("*").alias("_weight"), F.first("_n").alias("_n"), F.first("_paths").alias("_paths"))
    sets = stored(sets.select("_k", F.col("_one.doc_id").alias("doc_id"), F.col("_one._r").alias("_r"), "_weight", "_n", "_paths"))

    def shared(open_: DataFrame) -> DataFrame:
        """open_: _p, _k, _n. The buckets of two sets or more; of those with the same members one."""
        # sums are partial, so a bucket that a third of all sets share is one row a task; the join with a written table can be split where it is skewed
        sized = open_.groupBy("_p").agg(F.count("*").alias("_m"), F.sum("_n").alias("_t"), F.bit_xor(F.xxhash64("_k")).alias("_sig")).filter("_m > 1")
        return freed(stored(open_.select("_p", "_k", "_n").join(stored(sized), "_p").withColumn("_nb", parts_of(block))))

    kept = shared(sets.select(F.explode(F.array_distinct("_paths")).alias("_p"), "_k", "_n"))
    wanted = kept.select("_k").distinct().join(sets.select("_k", "doc_id", "_r"), "_k")
    repeated = not rows.groupBy("doc_id", "_r").count().filter("count > 1").isEmpty()
    own = freed(stored(sets_of(docs, wanted, repeated)))

    leaves, edges, seen, same = [], [], [], ["_m", "_sig"]
    fits = (F.col("_m") <= small) & (F.col("_t") <= TOKENS)
    for level in range(2, max(depth, 2) + 1):
        leaves.append(kept.filter(fits))
        large = kept.filter(~fits)
        one = large.groupBy(*same).agg(F.min("_p").alias("_p"))
        for before in seen:
            one = one.join(before, same, "left_anti")
        one = stored(one)
        if one.isEmpty():
            break
        seen.append(one.select(*same))
        found, more = settled(large.join(one.select("_p"), "_p", "left_semi"), own, level >= depth)
        edges.append(stored(found))
        if more is None:
            break
        kept = shared(stored(more.distinct()))
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionByName(x)
    one = leaf.groupBy("_m", "_sig").agg(F.min("_p").alias("_p")).select("_p")
    leaf = leaf.join(one, "_p", "left_semi").select(F.col("_p").alias("_g"), "_k", F.lit(1).cast("long").alias("_weight")).join(own, "_k")
    every = compared(leaf, star, "a long, b long")
    for x in edges:
        every = every.unionByName(x)
    parts = freed(stored(components(every)))

    weights = sets.select("_k", "_weight", "_n")
    members = parts.select(F.col("root").alias("_g"), F.col("node").alias("_k")).join(weights, "_k")
    sized = members.groupBy("_g").agg(F.count("*").alias("_m"), F.sum("_n").alias("_t")).withColumn("_nb", parts_of(block))
    large = sized.filter("_nb > 1").select("_g", "_nb")
    found = compared(members.join(sized.filter("_nb = 1").select("_g"), "_g").join(own, "_k"), lambda k, weight, linked: (k, linked @ weight), "_k long, n long")
    if not large.isEmpty():
        found = found.unionByName(counted(members.join(large, "_g").select("_g", "_nb", "_k", "_weight"), own))
    found = found.groupBy("_k").agg(F.sum("n").alias("n"))
    every = sets.select("_k", "doc_id", "_r", "_weight").join(parts.select(F.col("node").alias("_k"), "root"), "_k", "left").join(found, "_k", "left")
    every = every.select("_k", F.coalesce("root", "_k").alias("_class"), (F.coalesce("n", F.lit(0)) + F.col("_weight") - 1).cast("long").alias("_links"), "_weight", F.col("doc_id").alias("_first"), F.col("_r").alias("_row"))
    return rows.select("doc_id", "_r", "_k"), freed(stored(every))


def join(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, class_id, n_links for every row: the least doc_id of its class, and how many other rows have Jaccard >= 0.8 with it.

    Texts without words (null ones too) have equal, empty sets and are copies of each other. Repeated rows and equal ids are rows of their
    own. class_id is null only where no row of a class has an id. An empty table gives an empty result. Other columns are not carried.
    """
    rows, sets = classes(docs, **limits)
    names = sets.groupBy("_class").agg(F.min("_first").alias("class_id"))
    found = sets.join(names, "_class").select("_k", "class_id", F.col("_links").alias("n_links"))
    return rows.join(found, "_k").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **limits) -> DataFrame:
    """docs' columns: of every class the row with the least doc_id stays; of rows that share that id and text, one.

    Null and empty texts are one class, of which one row stays; a class whose rows have no id keeps one of those; a null id counts only
    where there is no other. An empty table gives an empty result. A caller's columns may have any names.
    """
    cols, (id_, row, mine) = docs.columns, spare(docs, "_id", "_row", "_mine")
    rows, sets = classes(docs, **limits)
    keep = sets.groupBy("_class").agg(F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "_row")).alias("one"))
    keep = keep.select(F.col("one._first").alias(id_), F.col("one._row").alias(row))
    same = lambda r: (r == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(id_))
    gone = rows.join(keep, same(F.col("_r")), "left_anti").select(F.col("doc_id").alias(id_), F.col("_r").alias(row)).distinct()
    # the rows that go are the fewer, so their keys are sent to the texts
    own = docs.withColumn(mine, row_key()).join(few(gone), same(F.col(mine)), "left_anti")
    if not rows.groupBy("doc_id", "_r").count().filter("count > 1").isEmpty():
        own = own.dropDuplicates(["doc_id", mine])
    return own.select(*cols)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: the class and the number of links."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return one_of_each(docs)


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLES: dict[str, str] = {}
