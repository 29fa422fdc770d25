"""Secret scans through a trigram inverted index: Boolean trigram queries from the rules' patterns, postings intersected, candidates verified."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running_sums, spare, stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Its pattern must mean the same to Java, Python and RE2; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the contract's. A run of n or more is the longest run's match, so {24,} stands for the drop of shorter ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("url", r"[a-z]{3,10}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]{3,}@[A-Za-z0-9.-]+"),
)
BASE = 3

# --- trigram queries: a conjunction of clauses, a clause a disjunction of trigram sets ------------------------------------------------

Query = list[list[frozenset[str]]]
_MOST = 64


def trigram_query(pattern: str) -> Query:
    """What every text that the pattern matches must hold, in lower case. Empty: no mandatory trigram, so the rule scans all texts.

    The parsed pattern is walked with the set of strings that end here (while that set is small). A part that can be anything closes the
    set: its strings become a clause, each as the set of its trigrams; a string of under three letters demands nothing, and with it the
    whole clause.
    """
    clauses: Query = []

    def close(ends: set[str]):
        sets = [frozenset(e[i : i + 3] for i in range(len(e) - 2)) for e in ends]
        if all(sets):
            clauses.append(sorted(set(sets), key=sorted))

    def walk(seq, ends: set[str]) -> set[str]:
        for op, arg in seq:
            new: set[str] | None = None
            if op is sre.LITERAL:
                new = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                new = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                new = exact(arg[-1])
                if new is None:
                    close(ends)
                    ends = walk(arg[-1], {""})
                    continue
            elif op is sre.BRANCH:
                new = exact([(op, arg)])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and (inner := exact(arg[2])) is not None:
                new = inner | {""}
            if new is None or len(ends) * len(new) > _MOST:
                close(ends)
                ends = {""}
                if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                    ends = walk(arg[2], {""})
                    close(ends)
                    ends = {""}
                elif new is not None:
                    ends = new
            else:
                ends = {e + n for e in ends for n in new}
        return ends

    def exact(seq) -> set[str] | None:
        """All strings of a part, if they are few."""
        out = {""}
        for op, arg in seq:
            if op is sre.LITERAL:
                new = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
                new = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                new = exact(arg[-1])
            elif op is sre.BRANCH:
                each = [exact(b) for b in arg[1]]
                new = None if None in each else set().union(*each)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
                new = None if (inner := exact(arg[2])) is None else inner | {""} if arg[0] == 0 else inner
            else:
                new = None
            if new is None or len(out) * len(new) > _MOST:
                return None
            out = {o + n for o in out for n in new}
        return out

    close(walk(parser.parse(pattern), {""}))
    return clauses


# --- the index and its use ----------------------------------------------------------------------------------------------------------


#: Candidates up to so many are sent to every executor (12 bytes each); more are joined by a shuffle.
BROADCAST = 500_000
SIZES = "array<struct<gap:int,hit:int,good:boolean>>"


def row_key(docs: DataFrame) -> Column:
    """Rows with equal keys hold the same text, but for chance; a chance meeting only makes more candidates, which are verified."""
    ident = [F.col("doc_id")] if "doc_id" in docs.columns else []
    return F.xxhash64(*ident, F.col("text"))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The inverted index: trigram, key; a row a distinct trigram of a text in lower case, for the trigrams that some query can ask for.

    All trigrams whose three letters stand in the wanted ones at their place are read off in one pass over the text, overlapping ones too.
    """
    place = lambda k: "[" + "".join(sorted({f"\\x{{{ord(w[k]):x}}}" for w in wanted})) + "]"
    every = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(f"(?s)(?=({place(0)}{place(1)}{place(2)}))"), F.lit(1))
    return docs.select(row_key(docs).alias("_key"), F.explode(F.array_intersect(every, F.array(*map(F.lit, wanted)))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """_key, _rules: as bits of an int, the rules whose trigram query a text meets; texts that meet none are left out.

    Postings are brought together by key, at most as many as the queries ask for, and intersected as each query says: all trigrams of a
    set, one set of each clause, all clauses. Only keys and trigrams are shuffled, never texts.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({g for q in queries for clause in q for part in clause for g in part}) or ["\0\0\0"]
    held = postings(docs, wanted).groupBy("_key").agg(F.collect_set("trigram").alias("_held"))

    def all_of(part: frozenset[str]) -> Column:
        return F.size(F.array_intersect("_held", F.array(*map(F.lit, sorted(part))))) == len(part)

    bits = F.lit(0)
    for k, q in enumerate(queries):
        if q:
            met = reduce(and_, (reduce(or_, map(all_of, clause)) for clause in q))
            bits = bits + F.when(met, F.lit(1 << k)).otherwise(F.lit(0))
    return held.select("_key", bits.alias("_rules")).filter("_rules <> 0")


def sizes_of(text: Column, rule: Rule) -> Column:
    """A rule's matches in a text: lengths of the gap before each and of the match, and whether it is long enough."""
    cells = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("own"))
    sizes = F.transform(F.filter(cells, lambda h: h["hit"].isNotNull()), lambda h: F.struct(F.length(h["gap"]).alias("gap"), F.length(h["hit"]).alias("hit"), (F.length(h["own"]) >= rule.least).alias("good")))
    return F.when(text.rlike(rule.pattern), sizes).otherwise(F.array().cast(SIZES))


def placed(found: Column) -> Column:
    """The spans of one rule: where matches start is the sum of all gaps and matches before."""

    def span(c, at):
        start = (at + c["gap"]).cast("int")
        return F.struct(start.alias("start"), found["rank"].alias("rank"), found["kind"].alias("kind"), (start + c["hit"]).alias("end"))

    before = running_sums(F.transform(found["cells"], lambda c: c["gap"] + c["hit"]))
    spans = let(before, lambda at: F.transform(found["cells"], lambda c, i: F.when(c["good"], span(c, F.get(at, i)))))
    return F.filter(spans, lambda s: s.isNotNull())


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast: int = BROADCAST) -> DataFrame:
    """docs' columns, then secrets: array of (start, rank, kind, end) by start, then rule; code points, end exclusive.

    Only candidates are verified; rules without mandatory trigrams look at every text. The candidates' keys are a written table; up to
    ``broadcast`` of them go to the texts, so texts do not move; more are joined by a shuffle. Null text counts as empty (no secret), repeated
    rows stay, ties go by rule, empty tables give empty results, and a column that docs already calls secrets moves the added one to secrets_.
    """
    (name,) = spare(docs, "secrets")
    key, found = spare(docs, "_key", "_rules")
    near = stored(candidates(docs, rules).select(F.col("_key").alias(key), F.col("_rules").alias(found)))
    if near.count() <= broadcast:
        near = F.broadcast(near)
    joined = docs.withColumn(key, row_key(docs)).join(near, key, "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(SIZES)
    full = {k for k, r in enumerate(rules) if not trigram_query(r.pattern)}
    near_rule = lambda k: F.lit(True) if k in full else F.coalesce(F.col(found).bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
    each = [F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), F.when(near_rule(k), sizes_of(text, r)).otherwise(none).alias("cells")) for k, r in enumerate(rules)]
    return joined.withColumn(name, F.array_sort(F.flatten(F.transform(F.array(*each), placed)))).select(*docs.columns, name)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a row each: the contract's counts and digest, and all spans as one string."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    base = F.filter("secrets", lambda s: s["rank"] < BASE)
    return found.select("doc_id", *(count(k) for k in range(BASE)), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS own, {r.least} AS least FROM d WHERE regexp_matches(t, '{p}')"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (" + "\nUNION ALL ".join(parts) + "),\n"
        "i AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m),\n"
        "s AS (SELECT doc_id, rank, kind, length(own[i]) AS n, least, length(hits[i]) AS size, "
        "CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM i),\n"
        "g AS (SELECT doc_id, rank, start, kind || ':' || start || ':' || (start + size) AS w FROM s WHERE n >= least)\n"
        "SELECT d.doc_id, "
        + ", ".join(f"count(w) FILTER (rank = {k}) AS n_{RULES[k].kind}" for k in range(BASE))
        + f", sha256(coalesce(string_agg(w, ',' ORDER BY start, rank) FILTER (rank < {BASE}), '')) AS base_sha256, coalesce(string_agg(w, ',' ORDER BY start, rank), '') AS spans "
        "FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"
    )


QUERIES = {"op8_secrets": op8_secrets}
ORACLES = {"op8_secrets": _oracle()}
