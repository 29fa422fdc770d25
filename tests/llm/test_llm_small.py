"""Every operator on small hand-made tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, fingerprints, jaccard_join, mixing, packing, pii, quality_rules, secret_scan, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000
ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, "same text of more than five words here", "en", "a", 1),
    (3, "same text of more than five words here", "en", "a", 1),
    (4, "same text of more than five words here", "en", "b", 1),
    (None, "no id at all but a text", "en", "b", 1),
    (5, LONG, "en", "b", len(LONG)),
    (6, "   ünïcode \U0001f600\x1c mail me@x.org <|endoftext|> it's", "de", "c", 1),
    (7, " \n\t ", "en", "c", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    return df.withColumns({n: F.lit("mine") for n in names})


def test_mixing(spark, odd, none):
    out = mixing.mix(clashing(odd, "_words", "_taken", "_key", "_row"))
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r["_words"] == "mine" for r in rows)
    assert all(r["_taken_"] <= 2 * r["_words_"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(clashing(odd, "_words", "_taken", "_key", "_row")).collect()))
    assert mixing.mix(none).count() == 0
    named = clashing(odd, "_copy_no", "_shard", "_order", "_text_")
    emitted = mixing.emit(mixing.mix(named), named)
    assert emitted.columns == named.columns and emitted.count() == sum(len(r["_shards"]) for r in mixing.mix(named).collect())
    assert mixing.emit(mixing.mix(none), none).count() == 0


def test_mixing_targets_follow_the_iterated_resharing(spark):
    random.seed(4)
    sizes = {k: random.choice([0, 5, 50, 500, 3000]) for k in "abcdefgh"}
    df = spark.createDataFrame([("+" + k, k, v, 1) for k, v in sizes.items()], "_key string, _source string, _words long, _docs long")
    got = {r["_source"]: r["_target"] for r in mixing.source_targets(df).collect()}
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(sorted(sizes))}
    want, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total, over = sum(weight[k] for k in open_), 0.0
        for k in list(open_):
            want[k] += left * weight[k] / total
            if want[k] >= 2 * sizes[k]:
                over += want[k] - 2 * sizes[k]
                want[k] = 2.0 * sizes[k]
                open_.discard(k)
        left = over
    assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


def test_splitting_tree_deals_exact_quotas(spark):
    q = spark.createDataFrame([("+a", 40), ("+b", 7), ("-", 1)], "_key string, _units long")
    dealt = mixing.split_quotas(q, 6).collect()
    assert {k: sum(r["_q"] for r in dealt if r["_key"] == k) for k in ("+a", "+b", "-")} == {"+a": 40, "+b": 7, "-": 1}
    per = [sum(r["_q"] for r in dealt if r["_shard"] == s) for s in range(6)]
    assert sum(per) == 48 and max(per) - min(per) <= 2


def test_toxicity(spark, odd, none):
    rows, labels = [], []
    random.seed(5)
    ws = ["calm", "tree", "river", "stone", "cloud", "green", "bread", "house", "north", "light"]
    for k in range(400):
        bad = k % 5 == 0
        text = " ".join(random.choices(ws, k=30)) + (" idiot zorblefoo" if bad else "")
        rows.append((k, text))
        labels.append((k, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    out = toxicity.score(clashing(docs, "score", "_text_"), model).collect()
    right = sum((r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in out if r["held_out"])
    assert right / sum(r["held_out"] for r in out) > 0.95 and out[0]["score"] == "mine"
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(none, lab)).count() == len(ODD)
    assert toxicity.score(odd, toxicity.fit(docs, lab.filter("false"))).count() == len(ODD)


def test_shouting_is_judged_on_the_whole_text():
    votes = toxicity.Votes(["zorblefoo"])
    loud = lambda text: votes(text) >> toxicity.LEXICON_VOTERS + 4 & 1
    assert loud("calm tree " * 10_000 + "LOUD TREES " * 30_000) and not loud("LOUD TREES " * 10_000 + "calm tree " * 40_000)
    assert loud("abcdefGHIJKLM") and not loud("Abcdefghijklmn")
    assert not loud("\u0130 calm river") and loud("\u0130 CALM RIVER") and not loud("")


class LabelModelAlone(toxicity.LabelModel):
    """Without pairs."""

    def __init__(self):
        super().__init__(5, linked=2.0)


def test_label_model_finds_a_copied_voter():
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    votes = np.stack([rng.random(20_000) < np.where(y, 0.7, 0.05) for _ in range(4)], 1)
    votes = np.column_stack([votes, votes[:, 0]])
    patterns, counts = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    start = np.array([bin(p).count("1") / 5 for p in patterns])
    model = toxicity.LabelModel(5).fit(patterns, counts, start)
    assert (0, 4) in model.groups
    post = dict(zip(patterns, model.posterior(patterns), strict=True))
    p = np.array([post[v] for v in votes @ (1 << np.arange(5))])
    rank = np.searchsorted(np.sort(p), p, "left") / 2 + np.searchsorted(np.sort(p), p, "right") / 2
    assert (rank[y].mean() - y.sum() / 2) / (~y).sum() > 0.9  # area under the curve; abstaining is no evidence, so 0.5 is no cut here
    alone = LabelModelAlone().fit(patterns, counts, start)
    assert model.posterior([0b10001])[0] < alone.posterior([0b10001])[0]  # a copy adds nothing


def test_fingerprints_against_brute_force(spark, odd, none):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    rows = sorted(((i is None, i or 0, t or "") for i, t, *_ in ODD))
    want = sorted(t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (*_, t), (*_, n) in zip(rows, rows[1:] + rows[:1], strict=True))
    assert sorted(r["edited"] for r in got) == want
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert fingerprints.fingerprints(none).count() == 0
    alone = fingerprints.fingerprints(odd.filter("doc_id = 4")).first()
    assert alone["near_next"] == 1.0


def brute(texts):
    def shingles(t):
        w = [x for x in (t or "").lower().translate(str.maketrans(dict.fromkeys(" \t\n\x0b\x0c\r", " "))).split(" ") if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    near = lambda a, b: a == b or (len(a & b) >= 0.8 * len(a | b))
    links = [sum(near(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    return links, part


@pytest.mark.parametrize("limits", [{}, {"small": 3, "depth": 4, "block": 4}])
def test_jaccard_join_against_brute_force(spark, limits):
    random.seed(7)
    base = [[f"w{random.randint(0, 400)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for k in range(70):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            w[random.randrange(60)] = f"x{random.randint(0, 99)}"
        texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, part = brute(texts)
    got = {r["doc_id"]: r for r in jaccard_join.join(docs, **limits).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == part
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs, **limits).collect()) == sorted(set(part))


def test_jaccard_join_finds_contained_texts_in_large_buckets(spark):
    """Pairs at the bound, one text held by the other, made of passages that a third of all texts share: their buckets are split on and on."""
    random.seed(11)
    texts, chosen = [], []
    while len(chosen) < 400:
        new = random.choices(range(3), k=12)
        if all(sum(a != b for a, b in zip(new, old, strict=True)) > 2 for old in chosen):
            text = " ".join(f"p{at}v{v}w{i}" for at, v in enumerate(new) for i in range(20))
            texts += [text, text + "".join(f" own{len(chosen)}w{i}" for i in range(59))]
            chosen.append(new)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard_join.join(docs, recall=0.999, small=2).collect()}
    assert [i for i in range(len(texts)) if (got[i]["class_id"], got[i]["n_links"]) != (i - i % 2, 1)] == []


def test_jaccard_join_odd_rows(spark, odd, none):
    assert jaccard_join.join(odd).count() == len(ODD) and jaccard_join.join(none).count() == 0
    kept = jaccard_join.one_of_each(clashing(odd, "_k", "_id", "_row", "_mine", "_r", "_text_"))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]


def greedy(word, first, later):
    n = i = 0
    while i < len(word):
        k = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in (later if i else first)), 0)
        if not k:
            return 1
        i, n = i + k, n + 1
    return n


def test_longest_match_against_brute_force():
    random.seed(8)
    for _ in range(150):
        first, later = ({bytes(random.choices(b"abc", k=random.randint(1, 4))) for _ in range(6)} for _ in range(2))
        ws = [bytes(random.choices(b"abc", k=random.randint(0, 9))) for _ in range(60)]
        assert token_counts.LongestMatch(first, later).lengths(ws).tolist() == [greedy(w, first, later) for w in ws]


def test_token_counts(spark, odd, none):
    rows = token_counts.token_counts(clashing(odd, "n_words", "_text_")).collect()
    assert len(rows) == len(ODD) and rows[0]["n_words"] == "mine"
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[5]["n_words_"] == 60_000
    assert token_counts.token_counts(none).count() == 0


def test_packing(spark, odd, none):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    got = packing.pack_documents(clashing(odd, "_b", "piece"), size=64).collect()
    tk = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for i, t, *_ in ODD:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    key = lambda r: (r[0] is None, *(x or 0 for x in r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64 and packing.pack_documents(none).count() == 0


def test_bins_are_as_full_as_exhaustive_search_finds():
    from itertools import combinations

    random.seed(9)
    for _ in range(60):
        lengths = [random.randint(1, 20) for _ in range(9)]
        counts = {k: lengths.count(k) for k in set(lengths)}
        got = packing.fullest(counts, 24)
        rest = list(lengths)
        rest.remove(max(lengths))
        best = max(sum(c) for n in range(len(rest) + 1) for c in combinations(rest, n) if sum(c) <= 24 - max(lengths))
        assert sum(k * n for k, n in got.items()) == max(lengths) + best
        assert all(n <= counts[k] for k, n in got.items())
        assert sum(n * t for g, t in packing.pack_lengths(counts, 24) for n in g.values()) == len(lengths)


def test_chat_formatting_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "", None, "a\\b\\\\h###</part></turn>\n", "####", "</turn</turn>", "</par</part>t>", "\\n"]
    random.seed(10)
    rows = [(c, t, random.choice(["user", "assistant", "a\nb###", None]), random.choice(tricky)) for c in (1, 2, None) for t in (0, 0, 1, 2, None, 3, 4, 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in out.withColumn("read", chat_format.read_chats(F.col("formatted"))).collect()}
    for c in (1, 2, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(x["role"], x["text"]) for x in got[c]["read"]] == [(r, x) for *_, r, x in own]
        taught = [got[c]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[c]["loss_mask"]]
        assert len(taught) == sum(r == "assistant" for *_, r, _ in own)
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_secrets(spark, odd, none):
    rows = [
        (1, "secret: token: abcdefg tOKen='abcdefgh' AKIA" + "A" * 16 + " ghp_" + "a" * 36),
        (2, "é" * 5 + "api_key=zzzzzzz deadbeef" + "0" * 20),
        (3, "AKIAAKIA" + "B" * 11 + " passwd : short " + "-----BEGIN RSA PRIVATE KEY-----"),
    ]
    import re

    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = [(m.start(), k, r.kind, m.end()) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least]
        assert got[i] == [(kind, a, b) for a, _, kind, b in sorted(want)]
    out = secret_scan.scan(clashing(odd, "secrets", "_key", "_rules", "trigram")).collect()
    assert len(out) == len(ODD) and out[0]["secrets"] == "mine" and secret_scan.scan(none).count() == 0


def test_trigram_queries_hold_for_every_match():
    import re

    samples = ["my PASSWORD = hunter22", "api-key apikey:abcdefgh", "AKIA" + "Z" * 20, "gho_" + "a" * 40, "xoxb-1234567890ab", "sk_live_" + "a" * 20, "ftp://u:pass@h"]
    for rule in secret_scan.RULES:
        q = secret_scan.trigram_query(rule.pattern)
        for s in samples:
            if re.search(rule.pattern, s):
                assert all(any(g <= {s.lower()[i : i + 3] for i in range(len(s))} for g in clause) for clause in q)
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == []


def test_quality(spark, odd, none):
    clean = "This is a calm line, with a proper end and enough words to be kept.\nAnother line follows, as one would hope, and it ends well too."
    noisy = clean + "\n" + "Home | News | About | Login | More\n" * 12
    rows = [(1, clean), (2, noisy), (3, "A!! B!! C!! D!! " * 8), (4, "one two three four five six seven eight. " * 20)]
    got = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["kept"] and not got[2]["kept"] and not got[3]["kept"] and got[4]["base_failed"]
    assert got[2]["cleaned"].strip() == clean and got[2]["n_dup_lines"] == 11 and got[4]["n_repeat_words"] == 160
    out = quality_rules.quality(clashing(odd, "kept", "_w", "_l")).collect()
    assert len(out) == len(ODD) and out[0]["kept"] == "mine" and quality_rules.quality(none).count() == 0


def test_base_pii_against_plain_patterns():
    import re

    digits = lambda s: re.sub("[^0-9]", "", s)

    def plain(t):
        return [
            [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
            [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
            [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
            [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
        ]

    random.seed(11)
    for letters in ("a.@-_+ 01234", "+0123456789 .-()", "a@.b\n"):
        for _ in range(6_000):
            t = "".join(random.choices(letters, k=random.randint(0, 50)))
            assert pii.base_spans(t) == plain(t), t


def test_pii(spark, odd, none):
    docs = spark.createDataFrame([(k, f"write a{k}@x.org or call +1 (212) 555-01{k:02d}, host 10.0.0.{k}") for k in range(40)], "doc_id long, text string")
    field = pii.learn(docs)
    out = pii.scan(clashing(docs, "spans", "_text_"), field).collect()
    assert all(r["n_email"] == r["n_phone"] == r["n_ip"] == 1 and r["spans"] == "mine" for r in out)
    assert out[3]["masked"] == "write [EMAIL] or call [PHONE], host [IP]"
    rows = pii.scan(odd, field).collect()
    assert len(rows) == len(ODD) and rows[0]["masked"] is None and pii.scan(none, pii.learn(none)).count() == 0


def test_labels_travel_along_skip_edges():
    texts = [f"mail bob{k}@x.org then BOB{k}@x.org, card 4111111111111111" for k in range(30)]
    field = pii.fit([(f, forms, y.tolist()) for _, _, f, forms, y in map(pii.prepared, texts)])
    assert field.skip > 0.5
    _, _, feats, forms, y = pii.prepared("4929000000006 x 4929000000006")
    alone, tied = field.marginals(feats[:1], forms[:1]), field.marginals(feats, forms, {0: 3})
    assert tied[1, 3] > alone[0, 3]


def test_marginals_against_enumeration():
    """Where messages go round no loop they are exact; with loops they stay close."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    field = pii.SkipChain(rng.normal(size=(pii.N_FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)) * 0.5, 1.2, rounds=60)

    def exact(feats, keys):
        p = np.zeros((len(feats), pii.LABELS))
        hubs = sorted({k for own in keys for k in own if sum(k in o for o in keys) > 1})
        for y in product(range(pii.LABELS), repeat=len(feats)):
            s = sum(field.weights[f].sum(0)[a] for f, a in zip(feats, y, strict=True)) + sum(field.chain[a, b] for a, b in zip(y, y[1:], strict=False))
            s = np.exp(s)
            for h in hubs:  # a hub takes any label; each token that has the key is tied to it
                s *= sum(np.exp(field.skip * sum(a == c for a, own in zip(y, keys, strict=True) if h in own)) for c in range(pii.LABELS))
            for i, a in enumerate(y):
                p[i, a] += s
        return p / p.sum(1, keepdims=True)

    feats = [[0, 3], [1], [5, 7], [2]]
    assert np.allclose(field.marginals(feats, [["a"], ["b"], ["c"], ["d"]]), exact(feats, [["a"], ["b"], ["c"], ["d"]]), atol=1e-3)
    flat = pii.SkipChain(field.weights, np.zeros((pii.LABELS, pii.LABELS)), 1.2, rounds=60)
    field, tied = flat, [["a"], ["a", "b"], ["b"], ["c"]]
    assert np.allclose(flat.marginals(feats, tied), exact(feats, tied), atol=1e-3)
    looped = [["a", "b"], ["a"], ["b"], ["a"]]
    assert np.abs(flat.marginals(feats, looped) - exact(feats, looped)).max() < 0.1


def test_the_field_adds_similar_tokens():
    docs = [f"call +1 (212) 555-01{k:02d} or mail bob{k}@x.org, host 10.0.0.{k}, order 77{k:03d}" for k in range(60)]
    field = pii.fit([(f, keys, y.tolist()) for _, _, f, keys, y in map(pii.prepared, docs)])
    assert pii.keys_of("+1(212)555-0101")[1] == pii.keys_of("555-0101")[1] and set(pii.keys_of("bob1@x.org")) & set(pii.keys_of("Bob1"))
    base, more = pii.find("call +1 (826) 555-4081 190.137.2.9 soon", field)
    assert base[3] == [] and all(a < b for _, a, b in more)
    assert pii.find("nothing here, 12 or 13", field)[1] == []


def test_pii_learns_from_one_of_many_copies(spark):
    same = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("write a1@x.org or call +1 (212) 555-0101 now").alias("text"))
    field = pii.learn(same, sample=4_000)
    assert pii.find("write b2@y.org now", field)[0][0] == [(6, 14)] and field.weights.any()
    long = spark.createDataFrame([(1, "7 " * 300_000 + "a@b.org " * 10)], "doc_id long, text string")
    assert pii.scan(long, pii.learn(long)).first()["n_email"] == 10


def test_held_out_rows_follow_crc32(spark):
    import zlib

    ids = [0, 1, 2, 17, 123456789, -5, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(toxicity.held_out(F.col("doc_id"))).collect()]
    assert got == [zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in ids]


def test_stems_that_two_words_share():
    fs = toxicity.features("Reuxpa reuxvi tree")
    assert {"4:reux", "4+reux", "tree"} <= fs and "4+tree" not in fs
    look = toxicity.Entries({"4:reux": 1.0, "4+reux": 5.0, "tree": 2.0})
    assert sorted(look({"reuxpa", "reuxvi", "tree"})) == [1.0, 2.0, 5.0] and look({"reuxpa"}) == [1.0] and look({"reux"}) == []


def shingle_hashes(text):
    import xxhash

    ws = [x for x in text.lower().translate(str.maketrans(dict.fromkeys(" \t\n\x0b\x0c\r", " "))).split(" ") if x]
    out = set()
    for i in range(max(1, len(ws) - 4) if ws else 0):
        h = 42
        for w in ws[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h >> 16)
    return out


@pytest.mark.parametrize("scale", [1, 4, 64])
def test_sketches_against_plain_sets(spark, scale):
    random.seed(3)
    texts = ["", "one", "one two three four five six"] + [" ".join(random.choices("abcdefgh", k=random.randint(3, 60))) for _ in range(40)]

    def kept(hs):
        return sorted(h for h in hs if h < (1 << 48) // scale) or sorted(hs)[:1]

    df = spark.createDataFrame([(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)], "a string, b string")
    sk = lambda c: fingerprints.sketch(F.col(c), scale)
    rows = df.select("a", "b", sk("a").alias("x"), sk("b").alias("y"), fingerprints.merge(sk("a"), sk("b"), scale).alias("m"), fingerprints.likeness(sk("a"), sk("b"), scale).alias("l"), fingerprints.containment(sk("a"), sk("b")).alias("c")).collect()
    for r in rows:
        a, b = shingle_hashes(r["a"]), shingle_hashes(r["b"])
        assert r["x"] == kept(a) and r["m"] == kept(a | b)
        if scale == 1:
            assert abs(r["l"] - (len(a & b) / len(a | b) if a | b else 1)) < 1e-9
            assert r["c"] is None if not a else abs(r["c"] - len(a & b) / len(a)) < 1e-9


def test_fingerprints_of_text_ids_and_many_buckets(spark):
    rows = [(f"id,{k:04d}", f"words of {k} " * 5) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    got = {r["doc_id"]: r["edited"] for r in fingerprints.fingerprints(df).collect()}
    want = {i: t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True)}
    assert got == want
    placed, order = fingerprints.with_next(df, bucket_bytes=500)
    assert placed.select("_bucket").distinct().count() > 10 and placed.filter("_guest = 1").count() == placed.select("_bucket").distinct().count()


def test_hypergeometric_draws_have_their_distribution(spark):
    import math

    for total, own, places in ((10, 4, 5), (40, 33, 20), (100, 3, 50), (1, 1, 0), (7, 7, 3), (5, 0, 2)):
        n = 2_000
        got = spark.range(n).select(mixing.hypergeometric((F.col("id") + 0.5) / n, F.lit(total), F.lit(own), F.lit(places)).alias("x")).groupBy("x").count().collect()
        want = {k: math.comb(own, k) * math.comb(total - own, places - k) / math.comb(total, places) for k in range(max(0, places - total + own), min(places, own) + 1)}
        assert {r["x"] for r in got} <= set(want) and all(abs(r["count"] / n - want[r["x"]]) < 0.002 for r in got)
    big = spark.range(3).select(mixing.hypergeometric((F.col("id") + 0.5) / 3, F.lit(66_000_000), F.lit(22_000_000), F.lit(33_000_000)).alias("x")).collect()
    assert all(abs(r["x"] - 11_000_000) < 10_000 for r in big)


def test_taken_words_come_near_their_targets(spark):
    random.seed(6)
    rows = [(k, "w " * random.randint(1, 60), "s%d" % (0 if k % 3 else k % 7)) for k in range(3_000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=500, block_docs=20, shard_words=2_000).collect()
    taken, target, shards = {}, {}, {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["_taken"]
        target[r["source"]] = r["_target"]
        assert len(r["_shards"]) * r["_words"] == r["_taken"] <= 2 * r["_words"]
        for x in r["_shards"]:
            shards[x] = shards.get(x, 0) + r["_words"]
    assert all(0 <= target[s] - taken[s] <= 60 for s in target)
    assert len(shards) == round(sum(taken.values()) / 2_000) or abs(len(shards) - sum(taken.values()) / 2_000) < 4
    assert max(shards.values()) < 3 * min(shards.values())


def test_greedy_lengths_of_the_real_vocabulary():
    pieces = token_counts.pieces_of(packing.vocabulary_path())
    match = token_counts.LongestMatch(pieces)
    ws = [w.encode() for w in ("unbelievable", "antidisestablishmentarianism", "größe", "a", "zzzzqqqq", "x" * 200)]
    assert match.lengths(ws).tolist() == [greedy(w, pieces, pieces) for w in ws]
    long = "".join(random.Random(1).choices("abcdefghij", k=100_000)).encode()
    assert match.lengths([long, b"word"]).tolist()[1] == greedy(b"word", pieces, pieces)
    assert match.lengths([long])[0] == match.lengths([long] * 70)[0]


def test_other_vocabularies_read_whole_texts(spark):
    from tokenizers import Tokenizer

    where = packing.vocabulary_path("byte_bpe_50k.json")
    text = "Hello World, this Is  A Test of TEXT\n and more"
    ids = [*Tokenizer.from_file(where).encode(text, add_special_tokens=False).ids, 0]
    got = packing.tokenized(spark.createDataFrame([("a", text)], "doc_id string, text string"), where).first()
    import zlib

    import numpy as np

    assert (got["doc_id"], got["length"], got["ids_crc32"]) == ("a", len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_running_sums_of_long_arrays(spark):
    from sparkloom.llm.common import running_sums

    for n in (0, 1, 31, 32, 33, 5_000):
        values = [(k * 37) % 11 for k in range(n)]
        got = spark.createDataFrame([(values,)], "v array<int>").select(running_sums(F.col("v"))).first()[0]
        assert got == [sum(values[:k]) for k in range(n)] if n < 100 else got[-1] == sum(values[:-1]) and len(got) == n


def test_long_chats_and_many_hits(spark):
    turns = spark.range(12_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é text "), "id").alias("text"))
    chat = chat_format.format_chats(turns).withColumn("said", chat_format.masked(F.col("formatted"), F.col("loss_mask"))).first()
    assert chat["said"] == [f"é text {k}" for k in range(12_000) if k % 3]
    hits = spark.createDataFrame([("é token=abcdefgh and " * 20_000,)], "text string")
    spans = secret_scan.scan(hits).first()["secrets"]
    assert len(spans) == 20_000 and [(s["start"], s["end"]) for s in (spans[0], spans[-1])] == [(2, 16), (19_999 * 21 + 2, 19_999 * 21 + 16)]
    assert len(secret_scan.scan(hits, broadcast=-1).first()["secrets"]) == 20_000


def test_links_by_cores_and_deltas():
    """The rule that the core gives for a pair is Jaccard >= 0.8, whatever the core."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y, core = (set(rng.choice(40, rng.integers(1, 40), False).tolist()) for _ in range(3))
        if rng.random() < 0.7:
            y = set(x) ^ set(rng.choice(40, 3, False).tolist())
        w = lambda s: 5 * len(core - s) + 4 * len(s - core)
        assert (w(x) + w(y) <= len(core) + 9 * len((x ^ core) & (y ^ core))) == (5 * len(x & y) >= 4 * len(x | y))
    a, b = [np.array([1, 2, 3]), np.array([5])], [np.array([2, 3, 9]), np.array([], int), np.array([5])]
    assert jaccard_join.overlaps(a, b, 4).tolist() == [[2, 0, 0], [0, 0, 1]]
