"""Operators of a training-data pipeline against brute force, with the awkward inputs all must bear."""

import binascii
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import _words, chat, dedup, lm, mixing, ngram_join, packing, pii, token_counts, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string"


def docs_of(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f", "en", "s1", 11, "x", "y"), (1, "a b c d e f", "en", "s1", 11, "x", "y"), (2, "", "en", "s1", 0, None, None), (3, None, None, None, None, None, None),
        (None, "a b c d e f", None, None, None, "x", None), (None, None, None, None, None, None, None), (4, long_text, "en", "s2", len(long_text), "x", "y"), (5, " \n\t ", "en", "s2", 4, "", ""),
        (6, "mail me a@b.co or +1 555 123 4567 <|im_end|> \U0001f600 é", "en", None, 1, "x", "y"), (7, "one two", "en", "s1", 7, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# mixing ---------------------------------------------------------------------------------------


def test_targets_are_reshared_below_the_cap():
    t = mixing.targets({"a": 100, "b": 1000, None: 50})
    assert sum(t.values()) == pytest.approx(1.5 * 1150)
    assert all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 100, "b": 1000, None: 50}.items())
    assert t["a"] == 200 and t[None] == 100


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(r.choice([1, 5, 40, 900]))), f"s{0 if i % 3 else i % 7}") for i in range(1500)]
    df = docs_of(spark, rows)
    plan = mixing.mix(df).collect()
    assert len(plan) == len(rows)
    by = defaultdict(list)
    for p in plan:
        assert p["size"] == len(words_of(rows[p["doc_id"]][1]))
        assert 0 <= p["taken"] <= 2 * p["size"]
        by[p["source"]].append(p)
    for own in by.values():
        assert sum(p["taken"] for p in own) == pytest.approx(own[0]["target"], abs=1)
        assert sum(p["taken"] % p["size"] != 0 for p in own) <= 1
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str) == sorted(map(tuple, plan), key=str)


def test_rounding_keeps_expectations():
    import pandas as pd

    n = 40
    base = pd.DataFrame({"source_no": 0, "bucket": 0, "key": range(n), "doc_id": range(n), "t": 0, "size": [1 + 7 * i % 50 for i in range(n)], "times": 1, "base": 0, "p": 0.3, "copies": -1})
    got = np.mean([mixing.pair_up(base, seed, 0).sort_values("doc_id")["p"].to_numpy() for seed in range(1500)], axis=0)
    assert np.abs(got - 0.3).max() < 0.06


def brute_pair(rows, draws):
    """The rounding of one group in exact fractions: rows (size, p) in order; p of each afterwards."""
    p, held = [Fraction(x).limit_denominator(10**9) for _, x in rows], None
    for i, (size, _) in enumerate(rows):
        if held is None:
            held = i if 0 < p[i] < 1 else None
            continue
        if not 0 < p[i] < 1:
            continue
        other = rows[held][0]
        to_i, to_held = min(size * (1 - p[i]), other * p[held]), min(size * p[i], other * (1 - p[held]))
        gains, loses, mass = (i, held, to_i) if draws[i] * float(to_i + to_held) < float(to_held) else (held, i, to_held)
        p[gains] += mass / rows[gains][0]
        p[loses] -= mass / rows[loses][0]
        held = next((x for x in (i, held) if 0 < p[x] < 1), None)
    return p


def test_rounding_equals_exact_fractions():
    import pandas as pd

    r = random.Random(4)
    for seed in range(60):
        n = r.randint(1, 60)
        rows = [(r.randint(1, 300), r.choice([0.0, 0.25, 0.5, 0.125, 1.0])) for _ in range(n)]
        frame = pd.DataFrame({"source_no": 3, "bucket": 2, "key": range(n), "doc_id": 0, "t": 0, "size": [s for s, _ in rows], "times": 1, "base": 0, "p": [p for _, p in rows], "copies": -1})
        got = mixing.pair_up(frame, seed, 1)
        draws = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(f"{seed}:1:3:2".encode(), digest_size=16).digest(), "little"))).random(n)
        want = brute_pair(rows, draws)
        assert got["p"].tolist() == pytest.approx([float(x) for x in want], abs=1e-9)
        assert sum(s * p for (s, p) in zip(frame["size"], got["p"], strict=True)) == pytest.approx(sum(s * p for s, p in rows), rel=1e-9)
        assert ((got["p"] > 0) & (got["p"] < 1)).sum() <= 1 and (got["bucket"] == 0).all()


def test_mixed_rows_repeat_whole_documents(spark):
    df = awkward(spark)
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    plan = mixing.mix(df, residual="whole")
    taken = Counter()
    for x in plan.collect():
        taken[x["doc_id"], x["source"], x["size"]] += x["copies"]
    got = Counter((x["doc_id"], x["source"], len(words_of(x["text"]))) for x in out.collect())
    assert got == +taken
    assert {tuple(x) for x in out.collect()} <= {tuple(x) for x in df.collect()}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    assert plan.count() == df.count()


def test_mixed_rows_bear_other_and_clashing_names(spark):
    rows = [(i % 7, f"w {i % 3} " * (1 + i % 4), f"s{i % 2}", 99, "keep", i) for i in range(60)]
    df = spark.createDataFrame(rows, "name long, body string, origin string, size int, item string, copies int")
    out = mixing.mixed_rows(df, id_col="name", text_col="body", source_col="origin")
    assert out.columns == df.columns
    assert {x["size"] for x in out.collect()} == {99} and {x["item"] for x in out.collect()} == {"keep"}
    assert {tuple(x) for x in out.collect()} <= set(rows)


def test_mix_deals_repeated_and_null_ids_in_groups(spark):
    rows = [(None, "same words here", "s")] * 600 + [(1, f"text {i}", "s") for i in range(900)] + [(i, "x y z " * 9, "t") for i in range(50)]
    plan = mixing.mix(docs_of(spark, rows))
    own = [x for x in plan.collect() if x["source"] == "s"]
    assert len(own) == 1500 and sum(x["taken"] for x in own) == pytest.approx(own[0]["target"], abs=1) and all(x["taken"] <= 2 * x["size"] for x in own)
    items = mixing.item_plan(docs_of(spark, rows), "doc_id", "source", "text", 1.5, 2.0, mixing.WEIGHTS, 0, "words")
    assert items.where("doc_id IS NULL").count() == 1


def test_many_sources_need_no_driver(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(0, 40), None if i % 91 == 0 else f"site{r.randrange(120)}") for i in range(2500)]
    df = docs_of(spark, rows)
    want = {x["source"]: (x["target"], x["source_size"]) for x in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for x in got:
        assert (x["target"], x["source_size"]) == pytest.approx(want[x["source"]], rel=1e-9)
        taken[x["source"]] += x["taken"]
    assert all(taken[s] == pytest.approx(t, abs=1) for s, (t, _) in want.items())


# n-gram join ----------------------------------------------------------------------------------


def near_rows(n=300):
    r = random.Random(5)
    vocabulary = [f"t{i}" for i in range(3000)]
    rows, base = [], [[r.choice(vocabulary) for _ in range(r.randint(30, 200))] for _ in range(40)]
    for i in range(n):
        b = list(r.choice(base)) if i % 3 else [r.choice(vocabulary) for _ in range(60)]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            b[r.randrange(len(b))] = r.choice(vocabulary)
        rows.append((i, " ".join(b), "s"))
    return rows


def brute_links(rows):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words_of(t)) else frozenset() for i, t, _ in rows}
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [256, 7])
def test_join_finds_what_brute_force_finds(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_rows()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_join_bears_awkward_rows(spark):
    df = awkward(spark)
    out = ngram_join.near_duplicates(df).collect()
    assert len(out) == df.count()
    empty = {r["class_id"] for r in out if r["doc_id"] in (2, 3, 5)}
    assert empty == {2}
    assert {r["n_links"] for r in out if r["doc_id"] == 1} == {2}
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    r = random.Random(15)
    text = lambda: " ".join(f"u{r.randrange(5000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, "x"), (5, a + " tail", "x"), (5, b, "x"), (5, c, "x"), (5, c + " end", "x"), (None, d, "x"), (None, d + " more", "x"), (9, b, "x"), (7, None, "x"), (8, " ", "x"), (1, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `group` string").withColumn("t", F.lit(3))
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    got = [(x["doc_id"], x["text"]) for x in out.collect()]
    assert len(got) == 5 and {(1, a), (5, b), (7, None)} <= set(got)
    assert len({(5, c), (5, c + " end")} & set(got)) == 1 and len({(None, d), (None, d + " more")} & set(got)) == 1
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_pruning_thresholds_grow_with_the_values_compared():
    steps = ngram_join.least_matches()
    assert [n for n, _ in steps][-1] == ngram_join.HASHES
    assert all(0 < m < n for n, m in steps) and all(a[1] < b[1] for a, b in zip(steps, steps[1:], strict=False))


def test_components_of_a_long_chain(spark):
    names = [f"{i:04d}".encode() for i in range(200)]
    order = names[:]
    random.Random(1).shuffle(order)
    edges = [tuple(sorted((a, b), reverse=True)) for a, b in zip(order, order[1:], strict=False)]
    got = ngram_join.groups_of(spark.createDataFrame(edges, "node binary, root binary")).collect()
    assert {bytes(r["group"]) for r in got} == {names[0]} and len(got) == 200


# packing --------------------------------------------------------------------------------------


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["It's d'or 12a½ İ, x́y naïve_foo ſtraße '' a'b é,\xa0z q", "a\x1cb c", "ÀÉ!?ŉ... ŸŁ <|endoftext|> x", None, "", "word " * 3000, *(f"doc {i} " * (i % 60) for i in range(200))]
    rows = [(i, x, "s") for i, x in enumerate(texts)]
    out = packing.pack(docs_of(spark, rows), tokenizer_path(), length=256, open_bins=8, group_sequences=16).collect()
    used = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and (len(part) == 256 or r["start"] + len(part) == len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    total = sum(r["length"] for r in out)
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(used) <= 1.12 * math.ceil(total / 256) + 1


def test_packing_encodes_as_other_tokenizers_do(spark):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["Big Words  and\n spaces", "naïve Größe 漢字", None, ""]
    whole = Tokenizer.from_file(path)
    for x in packing.pack(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), path).collect():
        ids = [*whole.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert (x["length"], x["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_open_bins_close_the_fullest_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 5)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 (7 of 10) closes
    assert bins.put(3) == (0, 6) and bins.put(5) == (2, 5)


def test_packing_bears_awkward_rows(spark):
    df = awkward(spark)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0
    out = packing.pack(df, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 3, 4, 5, 6, 7, None}


# top-k ----------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = {i: (r.integers(-3, 4, 8) / 8).tolist() for i in range(300)}
    rows = [(i, v) for i, v in vectors.items()]
    rows += [(300, None), (301, [float("nan")] * 8), (302, [float("inf")] + [0.0] * 7), (None, [0.0] * 8), (303, [None] * 8), (304, []), (0, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("q", F.lit(1))
    got = defaultdict(list)
    for x in topk.top_k(df.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]), df, 20, query_bytes=512, block_bytes=2048, at_once=3).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in vectors.items()}
    for q in range(0, 300, 20):
        others = [(int(-whole[q] @ whole[i]), i) for i in [*vectors, 0] if i != q]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(others)[:20])]
    assert topk.top_k(df.limit(0), df, 5).count() == 0


# chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    tricky = ["", "<|im_end|>", "<|im_start|>user\nx", "a<\\|im_sep|>", "<\\\\|", "<", "|x|>", "tail<", None, "%0A %25", "\U0001f600"]
    r = random.Random(4)
    rows = []
    for c in range(40):
        for turn in range(r.randint(1, 150 if c == 0 else 9)):
            rows.append((c, turn, r.choice(["user", "assistant", "sys<|tem\n%", None]), r.choice(tricky) if c % 2 else "".join(x or "" for x in r.sample(tricky, 4))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit("clash"))
    made = chat.format_chats(df).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("blocks"))
    for x in made.withColumn("loss", chat.masked_text(F.col("blocks"))).collect():
        want = [(r or "", t or "") for c, _, r, t in rows if c == x["conv_id"]]
        assert [(b["role"], t) for b in x["blocks"] for t in b["texts"]] == want
        assert x["loss"] == "".join(t for r, t in want if r == "assistant")
        assert all(a["role"] != b["role"] for a, b in zip(x["blocks"], x["blocks"][1:], strict=False))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_orders_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, None, "user", "z"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "user", "n")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert got[1] == "<|im_start|>user\nz<|im_sep|>a<|im_sep|>a<|im_sep|>b<|im_end|>\n" and set(got) == {1, None}


# toxicity -------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        words = ["v" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.15
        if toxic:
            words[0] = r.choice(["idiota", "idiotisch", "scum"])
        rows.append((i, " ".join(words), "s"))
        if i % 2:
            labels.append((i, int(toxic)))
    df = docs_of(spark, rows)
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x["score"] for x in toxicity.scores(df, model).collect()}
    held = [(i, t) for i, t in labels if binascii.crc32(str(i).encode()) % 5 == 0]
    hits = sum((got[i] >= 0.5) == bool(t) for i, t in held)
    assert hits >= 0.97 * len(held)
    kept = toxicity.keep_clean(df, model)
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, s in got.items() if s < 0.5}


def test_risk_and_its_minimum(monkeypatch):
    """The corrected risk is computed anew here; what the fit finds is a minimum of it."""
    r = np.random.default_rng(3)
    xp, xu = (r.random((n, 6)) < q for n, q in ((300, [0.6, 0.5, 0.1, 0.1, 0.2, 0.3]), (900, [0.1, 0.1, 0.1, 0.2, 0.2, 0.3])))
    xp, xu, prior = xp.astype(np.float32), xu.astype(np.float32), 0.15

    def risk(w, b):
        zp, zu = xp @ w + b, xu @ w + b
        positive, negative = np.log1p(np.exp(-zp)).mean(), np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        return prior * positive + max(0.0, negative) + 0.5 * (0.2 / len(xp)) * (w**2).sum(), negative

    w, b = toxicity.fit_nnpu(xp, xu, prior, steps=3000, rate=0.02)
    least, negative = risk(w, b)
    assert negative > 0
    for i in range(7):
        for step in (-0.05, 0.05):
            v = w + step * (np.arange(6) == i)
            assert risk(v, b + step * (i == 6))[0] >= least - 1e-5
    assert risk(np.zeros(6), np.log(prior / (1 - prior)))[0] > least


def test_toxicity_samples_by_row(spark):
    df = docs_of(spark, [(None, f"text {i}", "s") for i in range(4000)])
    n = toxicity.sample(df, 1000, 4000, 2, "doc_id", "text").count()
    assert 850 < n < 1150


def test_toxicity_bears_awkward_rows(spark):
    df = awkward(spark)
    none = toxicity.train(df, spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.scores(df, none).collect()} == {0.0}
    some = toxicity.train(df, spark.createDataFrame([(1, 1), (7, 1), (6, 0)], "doc_id long, toxic int"))
    assert toxicity.scores(df, some).count() == df.count()
    assert toxicity.keep_clean(df, some).columns == df.columns
    assert toxicity.scores(df.limit(0), some).count() == 0


# personal data --------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for kind, pattern, good in checks:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    return out


def test_pii_base_spans_equal_brute_force(spark):
    r = random.Random(9)
    parts = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "é\U0001f600", " ", "..", "-", "5500005555555559", "+49.30 1234567 ", "@", "%", "12345678901234567890", "\n"]
    texts = [None, "", "1" * 30_000, "a." * 20_000 + "b@", "1 " * 8_000] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)]
    found = pii.find_pii(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len(found) == len(texts)
    for x in found:
        got = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in x["spans"]]
        assert got == brute_spans(texts[x["doc_id"]]), texts[x["doc_id"]]


def revealing_rows():
    rows = [(i, f"{x}{x} meet Zaphod {x}{x} at z@hq.org please common word", "s") for i, x in enumerate("abcdefgh")]
    rows += [(100 + i, f"common words please meet at noon {i} word", "s") for i in range(400)]
    return rows + [(900, "Zaphod was here, Zaphod!", "s"), (None, None, None)]


def test_pii_terms_that_reveal_an_entity(spark):
    df = docs_of(spark, revealing_rows()).withColumn("spans", F.lit("clash"))
    got = {x["doc_id"]: x for x in pii.find_pii(df).collect()}
    assert [(s["start"], s["end"]) for s in got[900]["term_spans"]] == [(0, 6), (17, 23)]
    assert all(len(got[i]["term_spans"]) == 1 for i in range(8)) and not got[100]["term_spans"]
    clean = {x["doc_id"]: x["sanitised"] for x in pii.sanitise(df).collect()}
    assert clean[0] == "aa meet [TERM] aa at [EMAIL] please common word"
    assert clean[900] == "[TERM] was here, [TERM]!"
    assert pii.find_pii(df.limit(0)).count() == 0 and pii.find_pii(awkward(spark)).count() == 10


def test_pii_ways_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    df = docs_of(spark, revealing_rows())
    want = sorted(map(str, pii.find_pii(df).select("doc_id", "term_spans").collect()))
    monkeypatch.setattr(pii, "BROADCAST_CHARS", 0)
    assert sorted(map(str, pii.find_pii(df).select("doc_id", "term_spans").collect())) == want


def test_pii_copied_passages_disclose(spark):
    rows = [(i, "call on Zaphod at 9, z@hq.org, as always", "s") for i in range(5)] + [(9, "Zaphod was here", "s")]
    rows += [(100 + i, f"call on us at 9 as always {i}", "s") for i in range(400)]
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["term_spans"]] for x in pii.find_pii(docs_of(spark, rows)).collect()}
    assert got[9] == [(0, 6)] and got[0] == [(8, 14)] and not got[100]


def test_pii_whole_words_at_the_edges_count(spark):
    mail, pad = "z@x.org", " " + "- " * 39
    texts = ["Zorblax: " + mail, f"write to {mail} Zorblax", f"- Zorblax{pad[:-7]} {mail} {pad[:-7]}Zorblax -", f"xZorblax{pad[:-6]}{mail}{pad[:-6]}Zorblaxx"]
    found = pii.found_in(pii.with_key(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), "doc_id", "text"), 80).collect()
    words = {x["doc_id"]: re.findall(r"[A-Za-z]+", x["contexts"][0]["around"]) for x in found}
    assert words == {0: ["Zorblax"], 1: ["write", "to", "Zorblax"], 2: ["Zorblax", "Zorblax"], 3: []}
    rows = [(i, f"Quux: q@x.org number {i}", "s") for i in range(5)] + [(50 + i, f"number {i} to r@x.org Blarg", "s") for i in range(5)]
    rows += [(100 + i, f"to number {i} again", "s") for i in range(400)]
    spans = {x["doc_id"]: [(s["start"], s["end"]) for s in x["term_spans"]] for x in pii.find_pii(docs_of(spark, rows)).collect()}
    assert spans[0] == [(0, 4)] and spans[50] == [(20, 25)]


def test_pii_statistics_equal_brute_force(spark):
    r = random.Random(21)
    words = [f"w{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(100)]
    mails = [f"m{i}@x.org" for i in range(12)]
    texts = []
    for i in range(150):
        t = [r.choice(words) for _ in range(r.randint(2, 40))]
        if i % 3 == 0:
            k = r.randrange(12)
            t[r.randrange(len(t))] = f"{words[k]} {mails[k]} {r.choice(words[:20])} near"
        texts.append(" ".join(t))
    texts += texts[:20] + [None]
    docs = pii.with_key(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), "doc_id", "text")
    found = pii.found_in(docs, 30)
    terms_in = lambda t: re.findall(r"[^\W\d_]+", t or "")
    n, both, near, kind, entities = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        n.update(terms_in(t))
    for x in found.collect():
        for c in x["contexts"] or ():
            near[c["entity"]] += len(terms_in(c["around"]))
            for w in set(terms_in(c["around"])):
                both[c["entity"], w] += 1
                kind[w] += 1
                entities[w].add(c["entity"])
    total, want = sum(n.values()), {}
    for level in ("one", "kind"):
        for key, k in (both if level == "one" else kind).items():
            w, e = (key[1], key[0]) if level == "one" else (key, None)
            if level == "kind" and len(entities[w]) < 3:
                continue
            prior = min(max(near[e] if e else sum(near.values()), 1) / total, 1.0)
            p = (min(k, n[w]) + 1.0 * prior) / (n[w] + 1.0)
            if p >= 0.5 and math.log2(p / prior) >= 1.0:
                old = want.get(w, (False, 0.0))
                want[w] = (old[0] or level == "one", max(old[1], p))
    got = {x["term"]: (x["alone"], x["p"]) for x in pii.disclosing_terms(docs, found, 3, 0.5, 1.0, 1.0).collect()}
    assert want and set(got) == set(want)
    for w, (alone, p) in want.items():
        assert got[w][0] == alone and got[w][1] == pytest.approx(p, rel=1e-9)


def test_pii_terms_of_a_kind(spark):
    rows = [(i, f"{'abcdefgh'[i] * 2} Kontaktadresse m{i}@x.org", "s") for i in range(8)] + [(100 + i, f"word number {i}", "s") for i in range(300)]
    found = {x["doc_id"]: x for x in pii.find_pii(docs_of(spark, rows)).collect()}
    assert [(s["start"], s["end"], s["alone"]) for s in found[0]["term_spans"]] == [(3, 17, False)]
    assert {x["doc_id"]: x["sanitised"] for x in pii.sanitise(docs_of(spark, rows)).collect()}[0] == "aa [TERM] [EMAIL]"


def test_pii_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.org" for i in range(3000)) + " Zorblax " * 700
    row = pii.find_pii(docs_of(spark, [(1, text, "s"), (2, "", "s")])).where("doc_id = 1").first()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [m.span() for m in re.finditer(r"\S+@\S+", text)]
    clean = pii.sanitise(docs_of(spark, [(1, text, "s"), (2, "", "s")])).where("doc_id = 1").first()["sanitised"]
    assert clean.startswith(" ".join(["[EMAIL]"] * 3000)) and "@" not in clean


def test_pii_and_chat_are_expressions_only(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for query in (pii.op7_pii, chat.op5_chat_formatting, dedup.op10_exact_dedup):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


# language model -------------------------------------------------------------------------------


def test_lm_base_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 1e-2)  # most words are light here, as in a large corpus
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["The", "the", "of", f"w{r.randrange(300)}"]) for _ in range(r.randint(0, 50))), "s") for i in range(400)]
    rows += [(400, None, "s"), (401, "never seen before", "s"), (None, "the of", "s"), (402, rows[0][1], "s")]
    tokens = lambda t: [w.lower() for w in words_of(t)] + [None]
    held = lambda i: binascii.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = lm.score_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for x in got:
        w = tokens(texts[x["doc_id"]])
        assert (x["held_out"], x["n_tokens"], x["train_tokens"]) == (held(x["doc_id"]), len(w), n)
        assert x["n_known"] == sum(c[a] > 0 for a in w)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[a] + 0.1) / (n + 0.1 * (v + 1))) for a in w), rel=1e-9)
        assert math.isfinite(x["score"]) and x["score"] < 0
    assert lm.score_documents(docs_of(spark, []).limit(0)).count() == 0
    assert lm.score_documents(awkward(spark)).count() == 10


def test_lm_uses_context(spark):
    r = random.Random(11)
    follow = {i: r.randrange(50) for i in range(50)}
    rows = []
    for i in range(600):
        w, out = r.randrange(50), []
        for _ in range(30):
            out.append(f"k{w}")
            w = follow[w] if r.random() < 0.9 else r.randrange(50)
        rows.append((i, " ".join(out), "s"))
    got = lm.score_documents(docs_of(spark, rows)).where("held_out").collect()
    assert got and np.mean([x["score"] - x["base_score"] for x in got]) > 10


def test_log_bloom_counts_are_near(spark):
    r = np.random.default_rng(1)
    h = lm.mixed(np.arange(2000, dtype=np.uint64))
    n = np.sort(r.integers(1, 500, 2000))
    token = np.repeat(h, n)
    blobs = spark.createDataFrame([x for x in lm.key_blobs([lm.keys_of(token, np.zeros(len(token), np.int64), 1, 6)[:2]], 1, 6)], lm.BLOB_SQL)
    rows = lm.segments_of(blobs, 1).collect()
    assert sum(x["tokens"] for x in rows) == n.sum() and sum(x["n"] for x in rows) == 2000
    bloom = lm.LogBloom({x["segment"]: np.frombuffer(bytes(x["bits"]), np.uint8) for x in rows}, 6)
    segment, key, _ = lm.keys_of(h, np.zeros(len(h), np.int64), 1, 6)
    got = bloom.count(1, segment, key)
    assert (got > 0).all() and np.median(np.abs(np.log(got / n))) < 0.35 and (got[n == 1] == 1).mean() > 0.8
    stranger = lm.keys_of(lm.mixed(np.arange(10_000, 20_000, dtype=np.uint64)), np.zeros(10_000, np.int64), 1, 6)
    assert (bloom.count(1, stranger[0], stranger[1]) > 0).mean() < 0.02


def brute_scores(train, texts):
    """The documented formula over plain counters, counts as the filter quantises them."""
    middle = lambda n: math.sqrt(2 ** (n.bit_length() - 1) * (2 ** n.bit_length() - 1)) if n else 0.0
    one, two, sums, kinds = Counter(), Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip(t, t[1:], strict=False))
    for (a, _), n in two.items():
        sums[a] += n
        kinds[a] += 1
    n, v = sum(one.values()), len(one)
    heavy = {w for w, c in one.items() if c >= n * lm.HEAVY}
    count = lambda w: float(one[w]) if w in heavy else middle(one[w])
    for t in texts:
        total = 0.0
        for i, w in enumerate(t):
            p = (count(w) + 0.1) / (n + 0.1 * (v + 1))
            if i:
                before = max(count(t[i - 1]), 1.0)
                followers = middle(kinds[t[i - 1]])
                followed = min(middle(sums[t[i - 1]]), before) if followers else 0.0
                p = (min(middle(two[t[i - 1], w]), followed) + (before - followed + followers) * p) / (before + followers)
            total += math.log10(p)
        yield total


def test_lm_score_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_KEY", 1000)  # so that nothing is found by chance
    monkeypatch.setattr(lm, "HEAVY", 1e-3)
    r = random.Random(13)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.8)), 900)}" for _ in range(r.randint(0, 60))), "s") for i in range(300)]
    tokens = lambda t: [*t.split(), None]
    train = [tokens(t) for i, t, _ in rows if binascii.crc32(str(i).encode()) % 10]
    want = dict(zip(range(300), brute_scores(train, [tokens(t) for _, t, _ in rows]), strict=True))
    got = {x["doc_id"]: x["score"] for x in lm.score_documents(docs_of(spark, rows)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_lm_keeps_single_ngrams_in_a_large_corpus(spark):
    filler = " ".join(["of the"] * 100_000)
    rows = [(i, filler, "s") for i in range(1, 30)] + [(50, "lone pair", "s")]
    held = {i for i, _, _ in rows if binascii.crc32(str(i).encode()) % 10 == 0}
    assert 50 not in held
    model, _ = lm.train(docs_of(spark, rows))
    assert model.tokens > 1 << 22
    h, place, _ = lm.tokens(pa.array(["lone pair"]))
    for n in (1, 2):
        segment, key, _ = lm.keys_of(h, place, n, model.bits)
        assert (model.bloom.count(n, segment, key) > 0).all()


def test_lm_scores_alike_where_the_filter_is_not_broadcast(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 5000)}" for _ in range(r.randint(0, 60))), "s") for i in range(500)] + [(None, None, "s")]
    read = lambda: {x["doc_id"]: tuple(x) for x in lm.score_documents(docs_of(spark, rows)).collect()}
    want = read()
    monkeypatch.setattr(lm, "FILTER_BYTES", 0)
    model, _ = lm.train(docs_of(spark, rows))
    assert model.bloom is None
    assert read() == want
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 64)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    assert lm.segment_bits(sum(len(t or "") for _, t, _ in rows)) > lm.SEGMENT_BITS
    got = lm.score_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(x["score"] == pytest.approx(want[x["doc_id"]][-1], rel=0.1) for x in got if x["n_tokens"] > 20)


def test_lm_segments_answer_many_blocks_at_once(monkeypatch):
    r = np.random.default_rng(2)
    key = np.unique(lm.mixed(r.integers(0, 3000, 20_000).astype(np.uint64)))
    n = r.integers(1, 200, len(key))
    bits = lm.bits_of([(kind, k, lm.level_of(n)) for kind, k in ((1, key), (2, key), (lm.FOLLOWED + 2, key >> np.uint64(24)), (lm.FOLLOWERS + 2, key >> np.uint64(24)))])
    bloom = lm.LogBloom({0: bits}, 1)
    rows = [(np.sort(r.choice(key, k % 9, False)), [np.sort(r.choice(key, k % 7, False))]) for k in range(1000)]
    one_by_one = [lm.answers_to([row], key, n, bloom)[0] for row in rows]
    calls, has = [], lm.LogBloom.has
    monkeypatch.setattr(lm.LogBloom, "has", lambda *a: calls.append(1) or has(*a))
    assert lm.answers_to(rows, key, n, bloom) == one_by_one
    assert len(calls) < 100  # and not some for each row
    words, counts = rows[8][0], lm.unpacked(one_by_one[8][0], "<i8")
    assert counts.tolist() == n[np.searchsorted(key, words)].tolist()


def test_lm_traffic_does_not_grow_with_segments_times_texts(spark, monkeypatch):
    r = random.Random(15)
    rows = [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), 5000)}" for _ in range(r.randint(0, 60))), "s") for i in range(500)] + [(None, None, "s")]
    docs = docs_of(spark, rows).repartition(2, "doc_id")
    monkeypatch.setattr(lm, "HEAVY", 1e-2)  # most words are light here, as in a large corpus
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 64)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
    read = lambda: {x["doc_id"]: tuple(x) for x in lm.score_documents(docs).collect()}
    want = read()
    monkeypatch.setattr(lm, "FILTER_BYTES", 0)
    model, segments = lm.train(docs)
    assert model.bloom is None and 1 << model.bits >= 1024
    blocks = lm.durable(lm.scored_blocks(docs, model))
    assert blocks.where("segment = -1").count() > 2
    answers = lm.answered(blocks, segments, model)
    sizes = [F.coalesce(F.length(f.name), F.lit(0)) for f in answers.schema if f.dataType.typeName() == "binary"]
    n_bytes = answers.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0]
    assert n_bytes < 40 * sum(x[2] for x in want.values())
    assert read() == want


def test_word_hashes_tell_words_apart(monkeypatch):
    r = random.Random(14)
    texts = [None, "", " ", "a", "x" * 500] + ["".join(r.choice("abAé \n\t\x1c\U0001f600") for _ in range(r.randint(0, 40))) for _ in range(300)]
    want = None
    for chunk in (1 << 16, 64, 7):
        monkeypatch.setattr(_words, "CHUNK_BYTES", chunk)
        _words._tables.cache_clear()
        h, n = _words.word_hashes(pa.array(texts))
        assert n.tolist() == [len((t or "").encode().split()) for t in texts]
        words = [w for t in texts for w in (t or "").encode().split()]
        assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
        assert want is None or want == h.tolist()
        want = h.tolist()
        low = _words.word_hashes(pa.array(texts).slice(3, 200), lower=True)[0].tolist()
        words = [w.lower() for t in texts[3:203] for w in (t or "").encode().split()]
        assert len(set(zip(words, low, strict=True))) == len(set(words)) == len(set(low))
    _words._tables.cache_clear()


# token counts ---------------------------------------------------------------------------------


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models

    model = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    pieces = token_counts.pieces_of(model)
    ranked = token_counts.zipf(pieces)
    assert sum(math.exp(p) for _, p in ranked) == pytest.approx(1) and ranked[0][1] - ranked[9][1] == pytest.approx(math.log(10))
    like = Tokenizer(models.Unigram([("<unk>", 0.0), *ranked], unk_id=0, byte_fallback=False)).model
    by_rank = token_counts.Viterbi(ranked, byte_fallback=False)
    for w in ("hello", "international", "Größe", "1234567", "aaaaaaaaaaaa", "漢字かな"):
        assert by_rank[w][0] == len(like.tokenize(token_counts.MARK + w)), w
    unigram = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False)).model
    r = random.Random(12)
    words = ["hello", "Größe", "naïve", "漢字かな", "\U0001f600x", "aaaaaaaaaaaa", "1234567", "don't"] + ["".join(r.choice("abcdeéß漢 ͸"[:9]) for _ in range(r.randint(1, 12))) for _ in range(300)]
    plain = token_counts.Viterbi(pieces, byte_fallback=False)
    for w in words:
        w = w.replace(" ", "")
        assert plain[w][0] == len(unigram.tokenize(token_counts.MARK + w)), w
    texts = [" ".join(r.choice(words) for _ in range(20)) for _ in range(30)] + [None, "", "  "]
    got = token_counts.count_tokens(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), pieces).collect()
    fallback = token_counts.Viterbi(pieces)
    for x in got:
        assert x["n_tokens"] == sum(fallback[w][0] for w in words_of(texts[x["doc_id"]]))
    assert token_counts.count_tokens(awkward(spark), pieces).count() == 10


def test_ties_go_to_the_earliest_start():
    v = token_counts.Viterbi([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0)])
    assert v["ab"][0] == 2 and v["ab"][2] == -3.0


# exact deduplication --------------------------------------------------------------------------


def kept_ids(out):
    return sorted(x["doc_id"] for x in out.collect() if x["kept"])


def test_dedup_over_batches(spark):
    df = awkward(spark)
    index = dedup.DigestIndex(spark, "t_index_a", buckets=3)
    first = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in dedup.dedup_batch(df, index).collect()}
    assert (1, 1, 3) in first and (None, 1, 3) in first and (2, 3, 3) in first and (3, 3, 3) in first and (5, 5, 1) in first
    again = docs_of(spark, [(90, "a b c d e f", "s"), (91, "new", "s"), (92, "new", "s")])
    second = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in dedup.dedup_batch(again, index).collect()}
    assert second == {90: (1, False), 91: (92, False), 92: (92, True)}
    assert index.read().count() == index.read().select("digest").distinct().count()
    dedup.dedup_batch(df.limit(0), index).count()
    index.drop()


def test_a_batch_that_comes_again(spark):
    index = dedup.DigestIndex(spark, "t_index_r", buckets=3)
    one = docs_of(spark, [(i, f"text {i % 30}", "s") for i in range(40)])
    first = sorted(map(str, dedup.dedup_batch(one, index, batch="one").collect()))
    assert kept_ids(dedup.dedup_batch(one, index, batch="two")) == []  # same rows, another batch: all known
    assert sorted(map(str, dedup.dedup_batch(one, index, batch="one").collect())) == first  # the same batch again
    # A run that was lost after half of its digests had been appended.
    two = docs_of(spark, [(100 + i, f"more {i % 6}", "s") for i in range(9)])
    digest = dedup.digest_of(F.col("text")).alias("digest")
    index.append(two.where("doc_id < 103").groupBy(digest).agg(F.max("doc_id").alias("keep_id")), "three")
    index.append(two.where("doc_id >= 106").groupBy(digest).agg(F.max("doc_id").alias("keep_id")).join(index.read(), "digest", "left_anti"), "three")
    out = dedup.dedup_batch(two, index, batch="three")
    assert index.read().where("batch = 'three'").count() == 6 == len(kept_ids(out))
    assert dedup.deduplicate(one, index, batch="four").count() == 0
    index.drop()


def test_deduplicate_keeps_one_row_and_all_columns(spark):
    df = awkward(spark).withColumn("__digest", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("stays", F.lit(3)).withColumn("number", F.lit(4))
    out = dedup.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "5", "6", "7"]
    assert {(r["__digest"], r["__key"], r["stays"], r["number"]) for r in out.collect()} == {(1, 2, 3, 4)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_index_outlives_catalogue_and_settings(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(i, f"x {i}", "s") for i in range(400)]
    one = dedup.DigestIndex(spark, "t_index_b", 8, path)
    assert len(kept_ids(dedup.dedup_batch(docs_of(spark, rows), one))) == 400
    spark.sql("DROP TABLE t_index_b")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = dedup.DigestIndex(spark, "t_index_c", path=path)
        assert two.buckets == 8
        again = dedup.dedup_batch(docs_of(spark, [*rows, (900, "new", "s")]), two)
        assert kept_ids(again) == [900]
        assert two.read().count() == 401
        with pytest.raises(ValueError, match="8 buckets"):
            dedup.DigestIndex(spark, "t_index_d", 3, path)
        three = dedup.DigestIndex(spark, "t_index_c")  # by name, under other settings
        assert three.buckets == 8 and kept_ids(dedup.dedup_batch(docs_of(spark, rows), three)) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("y")
    with pytest.raises(ValueError, match="no digest index"):
        dedup.DigestIndex(spark, "t_index_e", 3, str(tmp_path / "other"))
    spark.sql("DROP TABLE t_index_c")
