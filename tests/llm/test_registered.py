"""The registered queries and the stages of the pipeline over small odd tables, against brute force: nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from test_tables import by_hand, kept_by_hand, level_by_hand, plain_print
from tokenizers import Tokenizer

import corpus_pipeline
from lagfield.llm import html_text, langid, licenses, queries, quality

SAY = {"en": "the cat and the dog went over the hill with some of their old friends", "de": "der hund und die katze gehen mit dem wagen durch den alten wald", "fr": "le chat et la souris dans les rues de la ville avec une grande maison"}


def a_text(rng, lang, n):
    return " ".join(rng.choices(SAY[lang].split(), k=n)) + f" number {rng.randrange(10**6)}."


def documents():
    rng = random.Random(11)
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append([i, a_text(rng, lang, rng.randint(3, 80)), lang, rng.choice(["a", "a", "b", None])])
    base = a_text(rng, "en", 200)
    odd = [None, "", " \n\t ", "12 !! 34", base, base, base + " tail", base.upper(), "é" * 300, "cc by all rights reserved. General Public License", "word " * 6000]
    rows += [[200 + i, t, "en" if i % 2 else None, "c"] for i, t in enumerate(odd)]
    rows += [[None, "two rows without an id", "en", "a"]] * 2 + [[7, "a text under a repeated id", "de", "b"], rows[3]]
    return [(*r, len(r[1] or ""), "clash", i % 3, 1.0) for i, r in enumerate(rows)]


DOCS = documents()
TEXTS = [r[1] for r in DOCS]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp string, uid int, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(3)
    labels = [(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(DOCS)] + [(None, 1, 0), (5, None, None), (9999, 1, 0)]
    x = [list(map(float, v)) for v in rng.normal(size=(160, 5))] + [[0.25] * 5] * 40 + [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5]
    pages = [f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>buy {i}</div><article><h1>Title {i} &amp; more</h1><p>Some  words\n of text {i}</p></article><footer>all</footer></body></html>" for i in range(30)]
    pages += [None, "", "plain words", pages[2], "<div>a b c</div>" * 50, "<script>x</script>"]
    spark.createDataFrame(DOCS, SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").write.parquet(f"{base}/embeddings.parquet")
    spark.createDataFrame([(i, f"u{i}", h, 0) for i, h in enumerate(pages)], "page_id long, url string, html string, text int").write.parquet(f"{base}/pages.parquet")
    return base


def rows(spark, folder, name):
    found = queries.QUERIES[name](spark, folder).collect()
    if "doc_id" in found[0]:
        assert sorted(repr(r.doc_id) for r in found if r.asDict().get("piece", 0) == 0) == sorted(repr(r[0]) for r in DOCS)
    return found


def test_op1(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    w, out = html_text.learn(pages), rows(spark, folder, "op1_main_text")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in out:
        assert r.n_chars == len(r.text) and r.url == f"u{r.page_id}"
        if r.page_id < 30:
            assert r.text == f"Title {r.page_id} & more\nSome words of text {r.page_id}"
        if source[r.page_id]:
            s = html_text.scored(html_text.parse(source[r.page_id]), w)[1]
            lo, hi = html_text.best_region(s)
            assert abs(sum(s[lo:hi]) - max([0.0] + [sum(s[a:b]) for a in range(len(s)) for b in range(a, len(s) + 1)])) < 1e-9
    assert [r.text for r in sorted(out) if r.page_id in (30, 31, 32, 35)] == ["", "", "plain words", ""]


def test_op2(spark, folder):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = rows(spark, folder, "op2_block_mixing")
    want = {s: sum(size(r[1]) for r in DOCS if r[3] == s) for s in ("a", "b", "c", None)}
    goal = dict(zip(want, level_by_hand(list(want.values()), [3, 1, 2, 3]), strict=True))
    of = {}
    for d in DOCS:
        of.setdefault(d[0], set()).add((size(d[1]), want[d[3]]))
    assert all((r["size"], r.source_size) in of[r.doc_id] and 0 <= r.taken <= 2 * r["size"] for r in out)
    taken = {}
    for r in out:
        s = next(k for k in want if want[k] == r.source_size)
        assert abs(r.target - goal[s]) < 1e-6
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in want)
    again = lambda x: sorted((r.doc_id, r["size"], r.taken) for r in x if r.doc_id is not None and r.doc_id != 3)
    assert again(out) == again(rows(spark, folder, "op2_block_mixing"))


def test_op3(spark, folder):
    x = {r.vec_id: np.floor(256 * np.array(r.embedding)).astype(int) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 200").collect()}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in rows(spark, folder, "op3_pivot_top_k")}
    want = {}
    for q in range(0, 200, 50):
        for n, (s, v) in enumerate(sorted((-int(x[q] @ x[v]), v) for v in x if v != q)[:5]):
            want[q, n + 1] = (v, -s)
    assert got == want


def test_op4(spark, folder):
    seen = {}
    want = sorted((str(r[0]), r[1]) for r in DOCS if r[0] is not None and r[0] not in (3, 7))
    out = {r.doc_id: r for r in rows(spark, folder, "op4_gif_media")}
    for i, t in ((int(i), t) for i, t in want):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op5(spark, folder):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    of = {}
    for r in rows(spark, folder, "op5_license_scan"):
        of.setdefault(r.doc_id, set()).add((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
    for d in DOCS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[1] or ""))
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))) in of[d[0]]
    assert licenses.postings()


def test_op6(spark, folder):
    shards, of = {}, {}
    for r in rows(spark, folder, "op6_minimax_sharding"):
        shards.setdefault(r.shard, []).append(r.slot)
        of.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and all(len(v) == 1 for v in of.values())
    assert set(of) == {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in TEXTS}


def plain_features(text):
    """A text's features by name, counted in plain loops."""
    words = (text or "").split()
    core = lambda w: "".join(c for c in w if c.isalpha())
    tf, shapes = Counter(core(w).lower() for w in words), Counter()
    for w in words:
        rest = re.sub("[0-9]+", "0", "".join(c for c in w if not c.isalpha()))[:8]
        shapes["sU" + rest if len(core(w)) > 1 and core(w).isupper() else "sl" + rest if core(w) else "s-" + rest] += 1
    size = sum((1 + math.log(c)) ** 2 for c in tf.values()) ** 0.25
    found = [("w" + w, quality.WORDS * (1 + math.log(c)) / size) for w, c in tf.items()] + [(s, quality.SHAPES * (c / len(words)) ** 0.5) for s, c in shapes.items()]
    if words:
        found += [("repeat", quality.SHAPES * sum(a == b for a, b in zip(words, words[1:])) / len(words)), ("few", 1 / len(words))]
    return found


def plain_tails(text, weights, thresholds):
    z = sum(weights[zlib.crc32(n.encode()) % len(weights)] * v for n, v in plain_features(text))
    return [1 / (1 + math.exp(t - z)) for t in thresholds]


def test_op7(spark, folder):
    """Grades by a plain loop over the text and the weights found; by a likelihood of its own the fit is far better than thresholds alone, and no shift of them betters it."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, quality.grades_of(labels), 3)
    want = {}
    for d in DOCS:
        tails = plain_tails(d[1], model.weights, model.thresholds)
        want.setdefault(d[0], []).append((sum(tails), tails[-1]))
    for r in rows(spark, folder, "op7_ordinal_quality"):
        assert any(abs(r.expected_grade - e) < 1e-5 and abs(r.tail_probability - t) < 1e-5 for e, t in want[r.doc_id]) and r.selected == (r.tail_probability >= quality.SELECT)
    assert model.thresholds[0] < model.thresholds[1]

    graded, texts = {}, {}
    for r in labels.collect():
        g = 0 if r.toxic == 1 else {0: 1, 1: 2}.get(r.quality)
        if r.doc_id is not None and g is not None:
            graded[r.doc_id] = max(g, graded.get(r.doc_id, 0))
    for d in DOCS:
        if d[0] in graded and d[1] is not None:
            texts[d[0]] = min(d[1], texts.get(d[0], d[1]), key=lambda x: x.encode())
    share = Counter(graded[i] for i in texts)

    def loss(weights, thresholds):
        total = 0.0
        for i, text in texts.items():
            above = [1.0, *plain_tails(text, weights, thresholds), 0.0]
            total -= math.log(above[graded[i]] - above[graded[i] + 1]) / share[graded[i]] ** 0.5
        return total / sum(n**0.5 for n in share.values()) + quality.RIDGE / 2 * float(weights @ weights)

    here = loss(model.weights, model.thresholds)
    alone = min(loss(np.zeros(8), (a, a + gap)) for a in np.linspace(-3, 1, 9) for gap in (0.5, 1.0, 1.5, 2.0, 3.0))
    assert here < 0.9 * alone
    assert all(loss(model.weights, model.thresholds + s) > here - 0.005 for s in (-0.2, 0.2, np.array([0, 0.2]), np.array([-0.2, 0])))
    few = quality.learn(docs, quality.grades_of(labels), 3, sample=2)  # repeated ids teach once
    assert np.isfinite(few.thresholds).all()


def test_op8(spark, folder):
    of = {}
    for d in DOCS:
        of.setdefault(plain_print(d[1]), []).append(d[0])
    roots = by_hand(set(of))
    least = {}
    for p, r in roots.items():
        ids = [i for i in of[p] if i is not None]
        least[r] = min([*ids, *([least[r]] if r in least else [])], default=None)
    want = sorted((repr(d[0]), f"{plain_print(d[1]):016x}", least[roots[plain_print(d[1])]]) for d in DOCS)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in rows(spark, folder, "op8_simhash")) == want


def plain_dictionaries(learned):
    """Texts of each language by a hash of id and text, whole, end to end, in the rules' plain words; languages by how many rows they have."""
    flat = lambda t: " ".join("".join(c if c > "\x7f" or "a" <= c <= "z" else " " for c in t.lower()).split(" ")).split()
    found = {}
    for d in learned:
        seed = 42 if d[0] is None else xxhash.xxh64_intdigest(struct.pack("<q", d[0]), 42)
        h = xxhash.xxh64_intdigest(d[1].encode(), seed)
        found.setdefault(d[2], []).append((h - (1 << 64) * (h >> 63), d[1]))
    order = sorted(found, key=lambda k: (-len(found[k]), k))
    return flat, [(k, b" ".join(" ".join(flat(t)).encode() for _, t in sorted(found[k]))) for k in order]


def test_op9(spark, folder):
    """Every document by a plain loop of zstandard over dictionaries made here."""
    is_held = lambda d: zlib.crc32(str("" if d[0] is None else d[0]).encode()) % 5 == 0
    flat, model = plain_dictionaries([d for d in DOCS if d[1] and d[2] and not is_held(d)])
    assert {k for k, _ in model} == set(SAY)
    want = {}
    for d in DOCS:
        lang, margin = "und", 0.0
        if d[1] and any(c.isalpha() for c in d[1]):
            data, sizes = " ".join(flat(d[1])).encode(), []
            for k, content in model:
                held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=6)
                coder = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)
                sizes.append((sum(len(coder.compress(b"q" * 64 + data[i : i + 4096])) for i in range(0, max(len(data), 1), 4096)), len(sizes), k))
            (best, _, lang), (second, *_) = sorted(sizes)[:2]
            margin = (second - best) / second
        want.setdefault(d[0], set()).add((is_held(d), lang, round(margin, 9), margin >= langid.NARROW and lang != "und"))
    out = rows(spark, folder, "op9_compression_language")
    assert all((r.held_out, r.lang_pred, round(r.score, 9), r.accepted) in want[r.doc_id] for r in out)
    right = [r.lang_pred == DOCS[r.doc_id][2] for r in out if r.doc_id is not None and r.doc_id < 120 and r.doc_id not in (3, 7)]
    assert np.mean(right) > 0.97


def test_language_samples_are_whole_texts(spark):
    """Texts teach whole or not at all: none after the bound is reached, and one beyond it by itself only where there are no others."""
    name = lambda i: chr(97 + i // 10) + chr(107 + i % 10)
    rows = [(i, f"{name(i)} " * 10, "a") for i in range(50)] + [(100, "huge " * 1000, "a"), (101, "vast " * 1000, "b")]  # thirty characters each, and five thousand
    for chars, taken in ((100, 4), (300, 10), (4000, 30)):
        model = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 30, chars))
        assert model["b"].split() == [b"vast"] * 1000
        taught = Counter(model["a"].split())
        assert len(taught) == taken and set(taught.values()) == {10} and b"huge" not in taught
    few = dict(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 51, 4000))
    assert Counter(few["a"].split())[b"huge"] == 1000


def check_packed(out, texts_of):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for r in out:
        ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts_of[r.doc_id]]
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.length == min(2048, len(x) - r.start) for x in ids if r.start < len(x))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    return by


def test_op10(spark, folder):
    of = {}
    for d in DOCS:
        of.setdefault(d[0], []).append(d[1])
    check_packed(rows(spark, folder, "op10_vector_best_fit"), of)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    language, graded, deduplicated, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    model = tuple(langid.learn(docs))
    one = language(spark, docs, folder)
    assert one.columns == docs.columns
    assert sorted(map(repr, one.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", "text").where("text IS NOT NULL").rdd.filter(lambda r: langid.classify(r.text, model)[2]).toDF("doc_id long, text string").collect()))
    ratings = quality.learn(docs, quality.grades_of(spark.read.parquet(f"{folder}/labels.parquet")), 3)
    two = graded(spark, docs, folder)
    assert two.columns == docs.columns and two.count() == sum(bool(ratings.tails(t)[-1] >= quality.SELECT) for t in TEXTS)
    three = deduplicated(spark, docs.where("doc_id IS NOT NULL AND NOT (doc_id IN (3, 7))"), folder)
    plain = sorted((r[0], r[1]) for r in DOCS if r[0] is not None and r[0] not in (3, 7))
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == [plain[i][0] for i in kept_by_hand([t for _, t in plain])]
    assert deduplicated(spark, docs.where("doc_id = 3"), folder).count() == 1  # of two equal rows
    four = mixed(spark, docs, folder)
    assert four.columns == docs.columns and four.groupBy("doc_id", "text").count().where("doc_id IS NOT NULL AND doc_id <> 3 AND count > 2").count() == 0
    of = {}
    for d in DOCS:
        of.setdefault(d[0], []).append(d[1])
    sequences = check_packed(packed(spark, docs, folder).collect(), of)
    assert max(map(len, sequences.values())) <= corpus_pipeline.DOCUMENTS
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<double>"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
