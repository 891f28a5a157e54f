"""The pipeline's stages against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline as c
    from quire.llm import mixing, toxicity

    r = random.Random(6)
    base = [" ".join("".join(r.choice("abcdefghij") for _ in range(3)) for _ in range(80)) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(200 + i, base[i], "en", "s0", 1) for i in range(30)]  # copies; the larger id stays
    rows += [(300 + i, base[40 + i] + " tail", "en", "s1", 1) for i in range(20)]  # near copies
    rows += [(400 + i, f"scum {base[60 + i][:200]}", "en", "s2", 1) for i in range(40)]
    rows += [(None, None, None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(x[0], int(x[0] >= 400)) for x in rows if x[0] is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labelled = spark.read.parquet(str(tmp_path / "labels.parquet"))
    ids = lambda df: sorted(str(x["doc_id"]) for x in df.collect())

    clean = c.drop_toxic(spark, docs, str(tmp_path))
    model = toxicity.train(docs, labelled)
    assert ids(clean) == sorted(str(x[0]) for x in rows if model.score(x[1]) < 0.5)
    assert clean.columns == docs.columns and clean.count() >= 165 and sum(x["doc_id"] is not None and x["doc_id"] >= 400 for x in clean.collect()) < 8

    plain = spark.createDataFrame([x for x in rows if x[0] is None or x[0] < 400], schema)
    unique = c.drop_exact_copies(spark, plain, str(tmp_path))
    assert unique.columns == docs.columns
    assert ids(unique) == sorted([*(str(i) for i in range(30, 120)), *(str(200 + i) for i in range(30)), *(str(300 + i) for i in range(20)), "None"])
    apart = c.drop_near_copies(spark, unique, str(tmp_path))
    assert ids(apart) == sorted([*(str(i) for i in range(30, 120)), *(str(200 + i) for i in range(30)), "None"])
    assert apart.columns == docs.columns
    mixed = c.mix_sources(spark, apart, str(tmp_path))
    assert mixed.columns == docs.columns
    before, after = [tuple(x) for x in apart.collect()], [tuple(x) for x in mixed.collect()]
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    size = lambda x: len((x[1] or "").split())
    sizes, taken = Counter(), Counter()
    for x in before:
        sizes[x[3]] += size(x)
    for x in after:
        taken[x[3]] += size(x)
    want = mixing.targets(dict(sizes))
    largest = max(map(size, before))
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)

    packed = c.pack_sequences(spark, mixed, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter((x[0], len(tokenizer.encode(x[1] or "", add_special_tokens=False).ids) + 1) for x in after)
    whole = Counter()
    for x in packed:
        if x["piece"] == 0:
            whole[x["doc_id"], x["length"]] += 1
    assert whole == lengths  # no text is longer than a sequence here
    places = defaultdict(list)
    for x in packed:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] <= 2048
    total = sum(n for own in places.values() for _, n in own)
    assert len(places) <= -(-total // 2048) + 2

    # All stages in a row, each on what the one before kept.
    kept = docs
    for name, stage in c.STAGES[:3]:
        kept = c.written(stage(spark, kept, str(tmp_path)), name)
    names = {x["doc_id"] for x in kept.collect()}
    assert {x["doc_id"] for x in c.run(spark, str(tmp_path)).collect()} <= names
