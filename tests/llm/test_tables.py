"""Operators over whole tables against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lagfield.llm import jaccard, licenses, mixing, sharding, simhash, topk
from lagfield.llm.components import components


# --- sharding


def best_cuts(sizes, n):
    """The least capacity by trying all that can be, under the rule that a larger group stands alone."""
    sums = sorted({sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes) + 1)})
    for cap in sums:
        at = used = 0
        while at < len(sizes):
            total, start = 0, at
            while at < len(sizes) and (at == start or total + sizes[at] <= cap):
                total += sizes[at]
                at += 1
                if total > cap:
                    break
            used += 1
        if used <= n:
            return cap


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 14))] + [400] * (seed % 2)
    rng.shuffle(sizes)
    groups = spark.createDataFrame([(3 * i, s) for i, s in enumerate(sizes)], "bucket int, size long")
    for n in (1, 3, 5):
        shards = [r.shard for r in sharding.minimax_cuts(groups, n).orderBy("bucket").collect()]
        assert shards == sorted(shards) and len(shards) == len(sizes) and max(shards) < n
        cap = best_cuts(sizes, n)
        totals = {k: [s for s, x in zip(sizes, shards) if x == k] for k in set(shards)}
        assert all(sum(v) <= cap or len(v) == 1 for v in totals.values())


def test_shards_keep_equal_texts_and_number_slots(spark):
    texts = [None, "", "a", "é" * 10] * 5 + [f"text {i}" * (i % 7) for i in range(200)] + ["hot copy"] * 150
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.shard_by_bytes(docs, 5).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r["size"] == 8 + 8 and r.text_crc32 == __import__("zlib").crc32(b"hot copy")}) == 1
    assert sharding.shard_by_bytes(docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_the_capacity_is_that_of_single_groups(spark, seed):
    """With few bits a bucket holds many groups; the shards still keep to the least capacity of the groups in their order."""
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 90) + str(i % 60) for i in range(60)] * 2 + ["giant " * 900] * seed
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(docs, 7, bits=2, more_bits=1).join(docs.select("doc_id", "text"), "doc_id").select("shard", "size", "text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("place")).collect()
    places = sorted({r.place for r in rows})
    sizes = [sum(r["size"] for r in rows if r.place == p) for p in places]
    shards = [next(r.shard for r in rows if r.place == p) for p in places]
    assert shards == sorted(shards) and all(len({r.shard for r in rows if r.place == p}) == 1 for p in places)
    cap = best_cuts(sizes, 7)
    assert all(sum(s for s, k in zip(sizes, shards) if k == x) <= cap or shards.count(x) == 1 for x in set(shards))


# --- top-k


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "HOME", 1)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 6))
    x = [list(map(float, centres[i % 5] + 0.2 * rng.normal(size=6))) for i in range(300)] + [[0.5] * 6] * 150 + [None, [float("nan")] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("inf")] * 6]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(None, [1.0] * 6)], "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(topk.quantise(table), n_pivots=8, is_query="vec_id % 10 = 0").collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    q = np.floor(256 * np.array(x[:450])).astype(int)
    for i in range(0, 450, 10):
        s = q @ q[i]
        want = sorted((-int(s[j]), j) for j in range(450) if j != i)[:5]
        assert [(a, b) for _, a, b in sorted(got[i])] == want
    assert len(got) == 45
    few = table.where("vec_id < 3")
    assert topk.top_k(topk.quantise(few)).count() == 2
    assert topk.top_k(topk.quantise(table.limit(0))).count() == 0
    nought = spark.createDataFrame([(i, [0.0] * 6) for i in range(4)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(topk.quantise(nought), k=2).collect()] == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_bounds_rule_out_most_of_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + 0.01 * rng.normal(size=(50, 16)) for c in centres])
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, share = topk.search(topk.quantise(table))
    q = np.floor(256 * x).astype(int)
    best = {}
    for r in found.collect():
        best.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in range(0, 2000, 50):
        s = q @ q[i]
        want = sorted((-int(s[j]), j) for j in range(2000) if j != i)[:5]
        assert [(-v, j) for _, j, v in sorted(best[i])] == want
    assert share > 0.8


# --- near-duplicates


def plain_print(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", "  ", "One", "one two three", "a b c d", "a b c d e A B", "É\x1cb c d e\x0bf " * 50):
        assert simhash.fingerprint(t) % (1 << 64) == plain_print(t)


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    rng = random.Random(0)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not d & m for m in masks)
    small = [m % (1 << 64) for m in simhash.covering_masks(2, 8)]
    assert all(any(not (1 << a | 1 << b) & m for m in small) for a, b in itertools.combinations(range(8), 2))


def by_hand(prints, radius=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("chunk", [4, 2048])
def test_near_edges_connect_what_pairs_connect(spark, chunk):
    rng = random.Random(chunk)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.near_edges(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, chunk)
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in edges.collect())
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    want = by_hand(prints)
    same = lambda labels: {frozenset(p for p in prints if labels.get(p, p) == r) for r in {labels.get(p, p) for p in prints}}
    assert same(found) == same(want)


def test_components_of_a_chain(spark):
    rows = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61)], "a long, b long")).collect()}
    assert rows == {i: 1 for i in range(1, 41)} | {60: 60, 61: 60}


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i % 37}" for i in range(400))
    texts = [base, base + " w1", base, None, "", "other words stand here now", base.upper()]
    docs = spark.createDataFrame([(9 - i, t, "s", 1) for i, t in enumerate(texts)] + [(3, base.upper(), "s", 1)], "doc_id long, text string, fp string, nth int")
    rows = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert rows == {9: 3, 8: 3, 7: 3, 3: 3, 6: 5, 5: 5, 4: 4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("fp = 's' AND nth = 1").count() == 3 and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def kept_by_hand(texts):
    """The least index of each group that links of 0.8 of the five-word shingles connect."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def kept(spark, texts, **options):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), **options).collect())


def test_a_new_word_in_a_repetitive_text_is_a_near_copy(spark):
    base = " ".join(f"w{i % 37}" for i in range(400))
    assert kept(spark, [base, base + " tail"]) == [0]


def test_texts_of_the_same_words_in_another_order_stay(spark):
    words = [f"w{i}" for i in range(60)]
    mixed = random.Random(1).sample(words, 60)
    assert kept(spark, [" ".join(words), " ".join(mixed), " ".join(w for w in words for _ in range(2))]) == [0, 1, 2]


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    texts = [None, "", " "]
    for size in (3, 8, 30, 120, 120, 500):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        texts.append(" ".join(base))
        step = list(base)
        for n in range(30):
            own = list(base)
            for at in rng.sample(range(size), rng.randint(0, max(1, size // 30))):
                own[at] = f"x{rng.randrange(10**9)}"
            texts += [" ".join(own), " ".join(own).upper()]
            step[rng.randrange(size)] = f"y{n}"  # a chain, whose ends are unlike
            texts.append(" ".join(step))
    rng.shuffle(texts)
    want = kept_by_hand(texts)
    assert 20 < len(want) < len(texts) // 2 and kept(spark, texts) == want
    assert kept(spark, texts, rounds=1, block=(7, 2000)) == want  # groups that no task holds whole


def linked_by_prints(spark, monkeypatch, texts, **options):
    """What keep_one keeps, and the pairs that fingerprints gave and that the rounds compared after them."""
    seen = {}
    plain = jaccard.materialise

    def counted(df, name):
        out = plain(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    return kept(spark, texts, **options), seen.get("candidates", 0), seen.get("pairs", 0)


def test_fingerprints_link_near_duplicates_first(spark, monkeypatch):
    """Long texts with one word changed have prints within four bits: SimHash links them, and the join after it has no pair left to compare."""
    rng = random.Random(6)
    texts = []
    for _ in range(4):
        base = [f"v{rng.randrange(9000)}" for _ in range(3000)]
        texts.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            own[rng.randrange(3000)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(own))
    assert all(i // 4 == j // 4 for i, j in itertools.combinations(range(16), 2) if (plain_print(texts[i]) ^ plain_print(texts[j])).bit_count() <= 4)
    rows, candidates, pairs = linked_by_prints(spark, monkeypatch, texts)
    assert rows == kept_by_hand(texts) == [0, 4, 8, 12] and candidates >= 12 and pairs == 0


def test_links_of_fingerprints_are_checked(spark, monkeypatch):
    """Texts of one much repeated phrase have one print; with unlike words after it they are candidates, and both stay."""
    phrase = " ".join([f"u{i}" for i in range(7)] * 200)
    texts = [phrase + " " + " ".join(f"{c}{i}" for i in range(60)) for c in "yz"]
    assert (plain_print(texts[0]) ^ plain_print(texts[1])).bit_count() <= 4
    rows, candidates, _ = linked_by_prints(spark, monkeypatch, texts)
    assert rows == kept_by_hand(texts) == [0, 1] and candidates == 1


def test_a_task_reads_texts_with_one_worker(spark, monkeypatch):
    """Sets and fingerprints come from one pass over the texts, not from two Python workers beside each other in every task."""
    plans, plain = {}, simhash.materialise

    def planned(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(simhash, "materialise", planned)
    texts = ["One two three four five six", None, "", " \t", "one TWO three four five six", "\xa0 x\u20ac"]
    assert kept(spark, texts) == kept_by_hand(texts) and plans["sets"].count("ArrowEvalPython") == 1
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    one, two = simhash.sets_and_prints(F.col("text"), 5).alias("s"), jaccard.set_of(F.col("text"), 5).alias("s")
    assert docs.select(one).select("s.*").collect() == docs.select(two, simhash.fingerprints(F.col("text")).alias("fp")).select("s.*", "fp").collect()


# --- licences


def test_license_places(spark):
    texts = ["CC-BY cc by: All rights\nreserved. all rights reserved", None, "", "Released under the MIT License.", "gnu general public license v3", "cc é by", "general public", "Rights reserved all"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    places, rows = licenses.scan(docs)
    found = {(r.doc_id, r.label, r.base, r.start) for r in places.join(rows, "uid").collect()}
    assert found == {(0, "cc-by", True, 0), (0, "cc-by", True, 2), (0, "reserved", True, 4), (0, "reserved", True, 7), (3, "mit", False, 3), (4, "gpl", True, 1), (4, "gpl", False, 0)}
    assert {r.doc_id: r.n_words for r in rows.collect()} == {0: 10, 1: 0, 2: 0, 3: 5, 4: 5, 5: 3, 6: 2, 7: 3}


def test_whole_licence_headers(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
    texts = ["cc by the public license mit. " + grant + " with no more", grant.replace("granted", "given"), grant.replace("free of charge", "free for charge"), None]
    places, rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {(r.doc_id, r.label, r.base, r.start): r.share for r in places.join(rows, "uid").collect()}
    assert set(found) == {(0, "cc-by", True, 0), (0, "mit", False, 6)} and found[0, "cc-by", True, 0] == 1 and 0.2 < found[0, "mit", False, 6] < 1
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


# --- mixing


def test_key_phrases_are_verified_word_by_word(spark):
    """Texts that hold a key phrase's rarer words in place, and others between them, are none of its; each whole phrase is found, alone and at a text's ends."""
    unlike = ["the redistribution of our open source or binary forms", "permission was hereby granted free from charge said he", "this file accept not file except to compliance by our license"]
    unlike += ["redistribute them and or modify it under the terms of the gnu general public", "without fee was hereby granted", "subject to all terms of the mozilla public license", "free or unencumbered software", "dedicated all copyright or related and neighboring rights"]
    said = [" ".join(w.strip("[]") for w in t.split()[[i for i, w in enumerate(t.split()) if w[0] == "["][0] : [i for i, w in enumerate(t.split()) if w[-1] == "]"][0] + 1]) for _, t, _ in licenses.TEMPLATES]
    assert said == licenses.PHRASES and not any("*" in x for x in said)
    texts = [*unlike, *said, *(f"so {x} so" for x in said)]
    places, rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {(r.doc_id, r.template): r.start for r in places.join(rows, "uid").collect()}
    assert not [k for k in found if k[0] < len(unlike)]
    for k in range(len(said)):
        assert found[len(unlike) + k, k] == 0 and found[len(unlike) + len(said) + k, k] == 1


def level_by_hand(sizes, weights, share=1.5, most=2.0):
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < share * sum(sizes) else (lo, mid)
    return [min(most * s, hi * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 500, 10000]) for _ in range(7)] + [50]
    names = [*sorted(f"s{i}" for i in range(7)), None]
    rows = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).orderBy("nth").collect()
    assert [r.source for r in rows] == names and [r.weight for r in rows] == [3, 1, 2, 3, 1, 2, 3, 1]
    assert np.allclose([r.target for r in rows], level_by_hand(sizes, [3, 1, 2, 3, 1, 2, 3, 1]))


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 11)
        assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, 11, inverse=True) == np.arange(n)).all()
    assert not (mixing.permuted(np.arange(1000), 1000, 11) == mixing.permuted(np.arange(1000), 1000, 12)).all()


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 63, 64, 65, 700])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (7, None, "b"), (None, "x y", "b"), (None, "x y", "b")], "doc_id long, text string, source string").repartition(3)
    taken, sized = mixing.mix(docs)
    words = taken.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    out = sized.join(words, "uid", "left").fillna(0, ["taken"]).collect()
    assert len(out) == 303 and all(r.taken <= 2 * r["size"] for r in out)
    for s in ("a", "b", "c", None):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r["size"] for r in own)
    spans = taken.collect()
    assert all(0 < r.n_words <= mixing.BLOCK for r in spans) and max(r.shard for r in spans) < mixing.SHARDS
    assert mixing.mix(docs.limit(0))[1].count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.groupBy("doc_id", "text").count().where("doc_id IS NOT NULL AND count > 2").count() == 0


def test_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), "abc"[i % 3]) for i in range(200)]
    seen = []
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        taken, sized = mixing.mix(docs)
        sums = sized.join(taken.groupBy("uid").agg(F.sum("n_words").alias("taken")), "uid", "left").fillna(0, ["taken"])
        seen.append({r.doc_id: r.taken for r in sums.collect()})
    assert seen[0] == seen[1]


def test_mixes_of_rows_without_ids_agree_however_they_are_split(spark):
    rng = random.Random(12)
    rows = [(i if rng.random() < 0.5 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 200))), rng.choice(["a", "b", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for n in (2, 5):
        split = docs.repartition(n, "text")
        taken, sized = mixing.mix(split)
        sums = taken.groupBy("uid").agg(F.sum("n_words").alias("taken"))
        got.append(sorted((repr(r.doc_id), r["size"], repr(r.source), r.taken or 0) for r in sized.join(sums, "uid", "left").collect()))
    assert got[0] == got[1]
