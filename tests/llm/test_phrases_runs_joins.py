"""Collocations, periodic runs and the similarity join against brute force, over odd tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from test_registered import DOCS, SCHEMA

from lagfield.llm import collocations, jaccard, periods
from lagfield.llm.components import components

ROW = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def phrases_by_hand(rows, max_n=3, least=10, top=2000):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    found = {g: f for g, f in counts.items() if len(g[1]) > 1 and f >= least}
    out = []
    for (lang, w), a in found.items():
        cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        inside = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))  # noqa: E731, B023
        if any(g == lang and len(x) > len(w) and 100 * f >= 50 * a and inside(x) for (g, x), f in found.items()):
            continue
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(w), counts[lang, w[:k]], counts[lang, w[k:]]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    nth, ranked = Counter(), []
    for lang, score, a, phrase, left, right in out:
        nth[lang] += 1
        if nth[lang] <= top:
            ranked.append((lang, nth[lang], phrase, a, left, right, total[lang], score))
    return ranked


def as_rows(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def test_collocations(spark, docs, monkeypatch):
    assert as_rows(collocations.collocations(docs)) == phrases_by_hand([(r[1], r[2]) for r in DOCS])
    monkeypatch.setattr(collocations, "HELD", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "A", "b", "ç", "d\t", "e.", "f\x0b", "\xa0", "=", "a b"], k=rng.randrange(60))) for _ in range(80)]
    rows = [(i, t, rng.choice(["x", "", None, "und"])) for i, t in enumerate(texts)] + [(1, None, "x")] * 2
    small = spark.createDataFrame(rows, ROW)
    for n, least, top in ((2, 3, 5), (3, 2, 2000), (5, 4, 7)):
        assert as_rows(collocations.collocations(small, n, least, top)) == phrases_by_hand([r[1:] for r in rows], n, least, top)
    assert collocations.collocations(spark.createDataFrame([], ROW)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    monkeypatch.setattr(collocations, "gram_counts", lambda *_: spark.createDataFrame([("x", "", 10**13), ("x", "a", 3 * 10**12), ("x", "b", 2 * 10**12 + 1), ("x", "a b", 10**12 + 7)], "lang string, phrase string, f long"))
    r = collocations.collocations(spark.createDataFrame([], ROW)).first()
    assert r.score == 10**6 * (10**12 + 7) ** 2 // (3 * 10**12 * (2 * 10**12 + 1))


def runs_by_hand(w):
    out = []
    for s in range(len(w)):
        for e in range(s + 6, len(w) + 1):
            q = next((q for q in range(1, (e - s) // 4 + 1) if all(w[i] == w[i + q] for i in range(s, e - q))), None)
            if q and not (s and w[s - 1] == w[s - 1 + q]) and not (e < len(w) and w[e] == w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def row_by_hand(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_by_hand(w) if len(w) < 120 else periods.runs_of([r for q in range(1, len(w)) for r in [(s, m + q, q) for s, m in periods._stretches(periods.word_ids(w), q, max(1, 6 - q, 3 * q))]])
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)] if len(w) < 3000 else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), kept if kept is None else sha(" ".join(kept)))


def test_repetitions_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(150):
        w: list = []
        while len(w) < rng.randint(1, 70):
            w += [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7) + [rng.choice("abcd")] * rng.randint(0, 1)
        w, k = w[:80], rng.randint(1, 9)
        x = periods.word_ids(w)
        parts = [r for lo in range(1, len(w) + 1, k) for r in periods.repetitions(x, lo, lo + k)]
        assert periods.runs_of(periods.repetitions(x, 1, len(w))) == runs_by_hand(w) == periods.runs_of(parts)


@pytest.mark.parametrize(("plant", "long"), [(True, 1 << 16), (False, 40), (True, 40)])
def test_periodic_runs(spark, docs, monkeypatch, plant, long):
    monkeypatch.setattr(periods, "CELLS", 1 << 14)
    found = periods.periodic_runs(docs, plant, long).collect()
    want = sorted((row_by_hand(r[0], r[1], plant) for r in DOCS), key=repr)
    got = sorted((tuple(r) for r in found), key=repr)
    assert len(got) == len(want) and all(a[:7] == b[:7] and b[7] in (None, a[7]) for a, b in zip(got, want, strict=True))
    assert any(r[1] for r in want)
    assert periods.periodic_runs(spark.createDataFrame([], ROW), plant, long).count() == 0


def join_by_hand(rows, words=5, percent=80):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in product(range(len(rows)), repeat=2):
        if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
            root = [root[i] if r == root[j] else r for r in root]
    least: dict = {}
    for r, (d, _) in zip(root, rows, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[r]) for (d, _), r, s in zip(rows, root, sets, strict=True)), key=repr)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    """Chains at, above and below the threshold, a template with many distinct copies, a passage that unlike texts share."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for _ in range(12):
        base = text(rng.randint(5, 120))
        rows += [" ".join(base), edited(rng, base, 1), edited(rng, base, 2), " ".join(base[:-1]), " ".join(base).upper(), " ".join(base + text(len(base) // 4))]
    template, passage = text(90), text(40)
    rows += [edited(rng, template, rng.randint(1, 5)) for _ in range(60)]
    rows += [" ".join(passage + text(rng.randint(3, 30))) for _ in range(30)]
    rows += [None, "", " \t", "one", "one", "One two three four", "one two three four five", "\xa0", "\xa0"]
    ids = [*range(500, 500 + len(rows))]
    rng.shuffle(ids)
    return [(i, t) for i, t in zip(ids, rows, strict=True)] + [(None, "one"), (None, None), (None, " ".join(template)), (ids[0], rows[0]), (None, "a b c d e f g h"), (None, "a b c d e f g h")]


@pytest.mark.parametrize(("rounds", "block"), [(1, (7, 500_000)), (3, (1024, 900))])
def test_similarity_join(spark, rounds, block):
    rows = near_rows()
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, node int, key string").repartition(3)
    found = jaccard.similarity_components(frame, rounds=rounds, block=block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == join_by_hand(rows)


def test_similarity_join_of_other_thresholds_and_tables(spark, docs):
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 60),):
        assert sorted((tuple(r) for r in jaccard.similarity_components(frame, words, percent).collect()), key=repr) == join_by_hand(rows, words, percent)
    assert sorted((tuple(r) for r in jaccard.similarity_components(docs).collect()), key=repr) == join_by_hand([r[:2] for r in DOCS])
    assert jaccard.similarity_components(spark.createDataFrame([], ROW)).count() == 0


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """A template with hundreds of distinct copies: each round compares a set with its leaders, and blocks get what is left."""
    rng = random.Random(9)
    template = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, template, 1 + i % 2)) for i in range(400)]
    seen = {}
    plain = jaccard.materialise

    def counted(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    found = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), block=(50, 5000))
    assert {r.component_id for r in found.collect()} == {0}
    assert max(seen["pairs"]) <= 10 * len(rows)


def test_components_leave_no_tables(spark):
    import os

    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 7], "a long, b long")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    found = {r.node: r.root for r in components(edges).collect()}
    assert all(found[n] == (n - 1) // 7 * 7 + 1 for n in found)
    assert len(set(os.listdir(base)) - before) <= 1


def test_components_of_stars_take_one_look(spark, monkeypatch):
    """Stars are seen as such by each node's neighbours, without a round that changes nothing; a chain takes rounds."""
    from lagfield.llm import components as module

    written, plain = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(name) or plain(df, name))
    stars = [(10 * s, 10 * s + i) for s in range(5) for i in range(1, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {n: n // 10 * 10 for s in range(5) for n in range(10 * s, 10 * s + 9)} and written == ["edges", "low"]
    chain = {r.node: r.root for r in components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()}
    assert chain == dict.fromkeys(range(10), 0) and len(written) > 4


def test_runs_of_words_are_counted_within_pieces():
    """Against a plain count; buckets are many, so that sums of a partition stay in memory."""
    pieces = list(collocations.words_of(b"A b,a B\tc; c\n. caf\xc3\xa9 a b c A B c:d"))
    assert pieces == [[b"a", b"b"], [b"a", b"b", b"c"], [b"c"], [b"caf\xc3\xa9", b"a", b"b", b"c", b"a", b"b", b"c"], [b"d"]] and not list(collocations.words_of(None))
    for n in (1, 2, 3, 9):
        want = Counter(b" ".join(p[i : i + k]) for p in pieces for k in range(1, n + 1) for i in range(len(p) - k + 1))
        phrases, counts = collocations.count_grams([w for p in pieces for w in p], [len(p) for p in pieces], n)
        assert dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)) == want
    assert collocations.BUCKETS >= 256 and collocations.BUCKET <= 1 << 26


def test_fragments_are_counted_in_a_few_times_their_bytes():
    """Sets of a fragment in several batches, copies among them: the shingles that two sets hold, as by hand, in less than 8 times the bytes of its shingles."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = {int(n): np.unique(rng.integers(0, 400_000, rng.integers(1, 12)).astype(np.uint64)) for n in rng.integers(-(1 << 62), 1 << 62, 60_000)}
    names = list(sets)
    batches = [names[i : i + 6000] for i in range(0, len(names), 6000)] + [names[:500]]
    columns = {"nodes": [np.array(b, np.int64) for b in batches], "counts": [np.array([len(sets[n]) for n in b], np.int32) for b in batches]}
    columns |= {"sizes": [3 * c for c in columns["counts"]], "tokens": [np.concatenate([sets[n] for n in b]) for b in batches]}
    chunks = [pa.table({"f": pa.array([5, 5], pa.int32())} | {k: pa.array([x.tobytes() for x in v[lo : lo + 2]], pa.binary()) for k, v in columns.items()}) for lo in range(0, 10, 2)]
    last = pa.table({"f": pa.array([4, 5], pa.int32())} | {k: pa.array([b"12345678", v[10].tobytes()], pa.binary()) for k, v in columns.items()}).slice(1)
    rows = pa.concat_tables([*chunks, last])
    tracemalloc.start()
    out = jaccard._shared((pa.scalar(5, pa.int32()),), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(x.nbytes for x in columns["tokens"])
    spread = Counter(t for s in sets.values() for t in s.tolist())
    want = {n: (3 * len(s), [(t, spread[t]) for t in s.tolist() if spread[t] > 1]) for n, s in sets.items()}
    read = lambda r: list(zip(np.frombuffer(r["tokens"], np.uint64).tolist(), np.frombuffer(r["sets"], np.int32).tolist(), strict=True))
    assert {r["node"]: (r["size"], read(r)) for r in out.to_pylist()} == {n: w for n, w in want.items() if w[1]}
    again = out.append_column("n", pa.array([len(x) // 8 for x in out["tokens"].to_pylist()], pa.int64()))
    assert jaccard._recount((pa.scalar(5, pa.int32()),), again).equals(out)
    assert jaccard._recount((pa.scalar(5, pa.int32()),), again.slice(0, 1)).num_rows == 0
