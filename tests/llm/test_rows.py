"""Row-wise operators: extraction, media, language, quality, tokens."""

import hashlib
import random
import struct
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagfield.llm import common, gif, html_text, langid, packing, quality

ODD = [None, "", " \n\t ", "a", "x " * 3000, "É" * 500, "same text here", "same text here"]


def docs(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{k} string" for k in more)]))


# --- main text


def page(body):
    return f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{body}<footer>&copy; all</footer></body></html>"


def test_main_text(spark):
    labelled = [page(f"<div class='ad'>buy {i}</div><article><h1>Title {i}</h1><p>Some words of text {i}</p></article><div>loose words around</div>") for i in range(20)]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate([*labelled, None, ""])], "page_id int, html string")
    w = html_text.learn(pages)
    out = {r.page_id: r.t for r in pages.select("page_id", html_text.extract(F.col("html"), w).alias("t")).collect()}
    assert out[3] == "Title 3\nSome words of text 3" and out[20] == "" and out[21] == ""
    whole = page("<main><h1>A &amp; B</h1><p>one\n  two <b>three</b><br>four<p>five &eacute;</p><aside>side</aside><section id=comments><p>great post</p></section><form><p>join</p></form><p>six</main>")
    assert html_text.main_text(whole, w) == "A & B\none two three four\nfive é\nsix"
    assert html_text.main_text("bare <i>text</i> &lt;kept&gt;", w) == "bare text <kept>"
    assert html_text.main_text("<p>cut <!-- off", w) == "cut"
    assert html_text.learn(pages.limit(0)) == html_text.NO_WEIGHTS
    assert html_text.learn(pages).features["n ad"] < 0
    long = page("<div class='box9'>" + "buy " * 30 + "</div><article><p>" + "word " * 40000 + "</p></article>")
    one = spark.createDataFrame([(long,), (long,)], "html string")
    assert html_text.learn(one).features["n box9"] < 0  # a long page teaches like any other


@pytest.mark.parametrize("named", ["class='content has-sidebar'", "id='main' class='no-comments'", "class=with-right-sidebar", "class='social-science'", "class='related-work'"])
@pytest.mark.parametrize("inner", ["<h1>T</h1><p>one two three</p>", "<article><h1>T</h1><p>one two three</p></article>"])
def test_a_wrapper_is_not_what_it_has_or_lacks(named, inner):
    source = page(f"<div {named}>{inner}</div><div class='sidebar no-print'><p>side words here</p></div>")
    assert html_text.main_text(source) == "T\none two three"


def test_content_keeps_its_parts_and_loses_what_stands_for_something_else():
    inner = "<h1>T</h1><section class='related-work'><p>one two</p></section><div class='tags-intro'>three</div><ul><li>four</li><li><a href=x>five</a></li></ul>"
    other = "<aside><p>side</p></aside><div class='ad-slot'>buy now</div><form><p>join us</p></form><div class='readerComments'><p>great post</p></div><div hidden>no</div>"
    want = "T\none two\nthree\nfour\nfive\nlast words"
    assert html_text.main_text(page(f"<main>{inner}{other}<p>last words</p></main><section class='related'><article><h3>teaser text</h3></article></section>")) == want
    story = "<p>" + "plain words of a story " * 20 + "</p>"
    assert html_text.main_text(page(f"<div class='cookie-notice'>we use</div><div>{story}</div><div class='reader-feedback'><p>great post</p></div>")) == " ".join(story[3:-4].split())
    menu = "<div>" + "<a href=x>menu words</a> " * 9 + "</div>"  # without a name that tells: the scan leaves links outside
    assert html_text.main_text(f"{menu}<div>{story}</div>{menu}") == " ".join(story[3:-4].split())
    assert html_text.main_text("<div class='sidebar'><p>all there is</p></div>") == "all there is"


@pytest.mark.parametrize("source", ["<b>" * 12000 + "</i>" * 12000, "<div>" * 60000 + "x" + "</span>" * 60000, "<div class=a>" * 60000 + "x" + "</div>" * 60000, "<p>" * 200000, "<a>x" * 100000, "<li>" * 100000, "<!--" * 9999, "<a b='" * 9999])
def test_nested_and_broken_pages_take_linear_time(source):
    began = time.process_time()
    html_text.main_text(source)
    assert time.process_time() - began < 6


def test_best_region_against_all_pairs():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        lo, hi = html_text.best_region(x)
        assert sum(x[lo:hi]) == max([0] + [sum(x[a:b]) for a in range(len(x)) for b in range(a, len(x) + 1)])


# --- media


def test_lzw_round_trips():
    rng = random.Random(1)
    for k in (0, 1, 2, 300, 5000, 70000):
        for letters in (1, 2, 5, 256):
            s = bytes(rng.choices(range(letters), k=k))
            assert gif.lzw_decode(gif.lzw_encode(s), 8, k) == s


def test_illegal_lzw_codes_end_a_frame():
    """Only the very next code may be one that the table does not hold; what follows any other, or a first code that is no sample, is not guessed."""
    pack = lambda *codes: gif._pack_codes(np.array([256, *codes, 257], np.int64), np.full(len(codes) + 2, 9, np.int64))
    assert gif.lzw_decode(pack(10, 258, 11), 8, 9) == bytes([10, 10, 10, 11])
    assert gif.lzw_decode(pack(10, 300, 11), 8, 9) == bytes([10])
    assert gif.lzw_decode(pack(10, 259, 11), 8, 9) == bytes([10])
    assert gif.lzw_decode(pack(258, 11), 8, 9) == b""
    assert gif.lzw_decode(pack(10, 11, 256, 258, 12), 8, 9) == bytes([10, 11])
    whole = gif.encode_gif(bytes(192 * gif.FRAME_ROWS * 2))
    assert len(gif.read_frames(whole)[2]) == 2
    second = whole.index(b"\x21\xf9", whole.index(b"\x21\xf9") + 2)
    bad = pack(0, 400, *[0] * 40)
    at = second + 8 + 10
    assert whole[at] == 8
    broken = whole[: at + 1] + bytes([len(bad)]) + bad + b"\0\x3b"
    assert len(gif.read_frames(broken)[2]) == 1


def test_stored_texts_read_back(spark):
    texts = [*ODD, "".join(chr(random.Random(2).randrange(32, 2000)) for _ in range(20000))]
    media = docs(spark, texts).select("doc_id", "text", gif.store_gif(F.col("text")).alias("s")).select("*", gif.read_gif(F.col("s.media")).alias("f")).collect()
    for r in media:
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.f.samples) == payload and r.s.n_bytes == len(raw) and r.f.width == 192
        assert sum(r.f.histogram) == len(payload) and np.array(r.f.frame_histograms).sum(0).tolist() == r.f.histogram
        assert r.f.starts_cs == [gif.DELAY * i for i in range(r.f.n_frames)] and r.f.n_frames == -(-len(payload) // (192 * gif.FRAME_ROWS))
    assert media[6].s.media == media[7].s.media


def frame(index, left, top, flags=0, disposal=0, transparent=None, local=b"", delay=1):
    h, w = index.shape
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    data = gif.lzw_encode(index.astype(np.uint8).tobytes(), 2)
    return control + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + local + b"\x02" + bytes([len(data)]) + data + b"\0"


def test_palettes_transparency_disposal_and_interlace():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + shared
    full, one = np.ones((4, 4)), np.array([[2, 3]])
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    parts = [frame(full, 0, 0), frame(one, 1, 1, transparent=3, disposal=2), frame(one, 0, 0, flags=0x81, local=own, disposal=3), frame(np.arange(16).reshape(4, 4) % 4, 0, 0, flags=0x40)]
    w, h, frames = gif.read_frames(head + b"".join(parts) + b"\x3b")
    shown = [c for _, c in gif.render(w, h, frames)]
    red, green = [255, 0, 0, 255], [0, 255, 0, 255]
    assert shown[1][1, 1].tolist() == green and shown[1][1, 2].tolist() == red  # a transparent sample leaves what is below
    assert shown[2][1, 1].tolist() == [0, 0, 0, 0] and shown[2][0, 0].tolist() == [7, 7, 7, 255]  # cleared; the frame's own palette
    assert frames[3].index[0].tolist() == [0, 1, 2, 3] and (list(gif.render(w, h, frames[:3] + [frame_of(frames[1], 3)]))[3][1][0, 0] == red).all()  # restored
    with pytest.raises(ValueError):
        gif.read_frames(b"PNG")


def test_damaged_media_give_a_defined_row(spark):
    whole = gif.encode_gif(bytes(range(192)) * 130)
    first = 13 + 768 + 8
    root = whole.index(b"\x08", first + 10)
    bad = [b"", b"GIF89a", b"PNG" * 9, None, whole[:40], whole[: first + 5], whole[: len(whole) * 9 // 10], *(whole[:root] + bytes([r]) + whole[root + 1 :] for r in (0, 12, 40, 255)), whole[:6] + b"\xff\xff\xff\xff" + whole[10:], whole[:13]]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate([*bad, whole])], "i int, m binary").select("i", gif.read_gif(F.col("m")).alias("f")).orderBy("i").collect()
    assert [r.f.n_frames for r in rows] == [0] * 6 + [rows[6].f.n_frames] + [0] * 6 + [3] and rows[6].f.n_frames in (1, 2)
    assert all(len(r.f.samples) == sum(r.f.histogram) for r in rows)


def frame_of(f, top):
    return gif.Frame(f.index, 1, top, f.palette, 3, 0, 1)


# --- language


def test_language(spark):
    say = {"a": "the cat and the dog went over the hill with ", "b": "der hund und die katze gehen mit dem wagen ", "c": "el gato y la casa de los perros con una "}
    rng = random.Random(3)
    texts, langs = [], []
    for i in range(120):
        k = "abc"[i % 3]
        texts.append(" ".join(rng.choices(say[k].split(), k=40)))
        langs.append(k)
    table = docs(spark, [*texts, None, "12 34 !!", ""], lang=[*langs, "a", "a", "a"])
    model = langid.learn(table.where("doc_id < 60"))
    rows = table.select("*", langid.predict(F.col("text"), model).alias("p")).orderBy("doc_id").collect()
    assert sum(r.p.lang_pred == r.lang for r in rows[60:120]) >= 59 and all(0 <= r.p.score <= 1 for r in rows)
    assert all(r.p.lang_pred == "und" and not r.p.accepted for r in rows[120:])
    assert {r.h for r in table.select("doc_id", langid.held_out().alias("h")).where("doc_id < 2").collect()} == {zlib.crc32(b"0") % 5 == 0, zlib.crc32(b"1") % 5 == 0}
    assert langid.learn(table.limit(0)) == []
    long = (texts[1] + " ") * 200
    assert langid.classify(long, tuple(model))[0] == "b"


# --- quality


def test_ordinal_thresholds_and_held_out_grades(spark):
    rng = random.Random(4)
    words = [[f"bad{i}" for i in range(5)], [f"dull{i}" for i in range(5)], [f"fine{i}" for i in range(5)]]
    grades = [i % 3 for i in range(600)]
    texts = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=30) + rng.choices(words[g], k=4)) for g in grades]
    table = docs(spark, texts)
    graded = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 450] + [(1, None), (None, 2)], "doc_id long, grade int")
    model = quality.learn(table, graded, 3)
    assert model.thresholds[0] < model.thresholds[1]
    rows = table.where("doc_id >= 450").select("doc_id", quality.grade(F.col("text"), model).alias("q")).collect()
    assert np.mean([round(r.q.expected_grade) == grades[r.doc_id] for r in rows]) > 0.9
    odd = docs(spark, ODD).select(quality.grade(F.col("text"), model).alias("q")).collect()
    assert odd[0] == odd[1] == odd[2] and odd[6] == odd[7]
    assert not quality.learn(table, graded.limit(0), 3).weights.any()


def test_fit_gradient():
    """The first step's direction of a threshold model, by finite differences of the loss."""
    rng = np.random.default_rng(0)
    n, index = 60, np.tile(np.arange(4), 60)
    row, value, grade = np.repeat(np.arange(n), 4), rng.normal(size=240), rng.integers(0, 3, n)
    model = quality.fit(index, value, row, grade, 3, passes=400)

    def loss(w, t):
        z = np.bincount(row, w[index] * value, n)
        p = np.column_stack([np.ones(n), quality._sigmoid(z[:, None] - t), np.zeros(n)])
        each = 1 / np.sqrt(np.bincount(grade))[grade]
        return -(np.log(p[np.arange(n), grade] - p[np.arange(n), grade + 1]) * each).sum() / each.sum() + quality.RIDGE / 2 * (w @ w)

    w, t = model.weights[:4].astype(float), model.thresholds
    here = loss(w, t)
    for i in range(4):
        for s in (-0.02, 0.02):
            assert loss(w + s * np.eye(4)[i], t) > here - 1e-4
    for s in (-0.02, 0.02):
        assert loss(w, t + np.array([s, 0])) > here - 1e-4 and loss(w, t + np.array([0, s])) > here - 1e-4


# --- tokens


def test_tokens_equal_the_library_and_packing_holds(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    library, words = Tokenizer.from_file(path), packing.Words(path)
    strange = ["<|endoftext|> a", "a\x1cb", "İ ΣΑΣ ς", "é é Å", "it's I'LL 12,34 ½", "漢字 🙂!?", "ß ǅ ŉ", "\x85a", "a\x00b", "'S Tis.", "ª µ Ω ﬁ", "can't,", "a.b. c,,"]
    for t in [*strange, *(x or "" for x in ODD)]:
        assert words.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    rng = random.Random(6)
    texts = [*ODD, *(" ".join(rng.choices(["alpha", "beta", "gamma,", "Δ"], k=rng.randint(0, 900))) for _ in range(150)), "word " * 5000]
    table = docs(spark, texts).unionByName(spark.createDataFrame([(None, "x y")] * 3, "doc_id long, text string"))
    rows = packing.pack(packing.pieces(table), group=40).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for r in rows:
        if r.doc_id is not None:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.length == min(2048, len(ids[r.doc_id]) - r.start) and r.start == 2048 * r.piece and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows if r.doc_id is not None) == sum(map(len, ids.values())) and len([r for r in rows if r.doc_id is None]) == 3
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.1 * sum(r.length for r in rows) / 2048 + 5
    assert packing.pack(packing.pieces(table.limit(0))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 60, 300))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 4, 3600), rule=rule)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 3600
        assert offsets[bins == b].tolist() == np.concatenate([[0], np.cumsum(own)[:-1]]).tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 4, 3600))


def test_sha_of_media_is_of_the_stored_form(spark):
    one = docs(spark, ["abc"]).select(gif.store_gif(F.col("text")).alias("s")).select("s.media", F.sha2("s.media", 256).alias("h")).first()
    assert hashlib.sha256(bytes(one.media)).hexdigest() == one.h


def test_words_by_task_are_bounded():
    """What a task remembers by itself stays within its bound, and ids do not depend on it."""
    path = public_tokenizers.path(packing.TOKENIZER)
    few, many = packing.Words(path, 50), packing.Words(path)
    rng = random.Random(8)
    for _ in range(40):
        text = " ".join(f"{rng.choice('abcxyz')}{rng.randrange(300)}, Word{rng.randrange(9)}" for _ in range(30))
        assert few.ids(text) == many.ids(text)
    assert len(few.words) + len(few.parts) <= 52 < len(many.words) + len(many.parts)


# --- workers


def test_lean_tasks_leave_caches_empty():
    """Whatever other stages' tasks remember in a worker is gone before a lean task and after it, one that fails too."""
    seen = []

    def task(batches):
        for x in batches:
            seen.append(len(quality._known) + langid._encoders.cache_info().currsize)
            quality.features(x)
            yield x

    quality.features("some words")
    langid.classify("some words", (("en", b"some words here"), ("de", b"einige worte hier")))
    assert list(common.lean(task)(iter(["a b", "c d"]))) == ["a b", "c d"]
    assert seen[0] == 0 < seen[1] and not quality._known and not langid._encoders.cache_info().currsize
    quality.features("some words")
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // 0 for _ in batches))(iter([1])))
    assert not quality._known


HELD = """
import random, re
import pyarrow as pa
from lagfield.llm import common, jaccard, quality
def mb():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def batches():
    rng = random.Random(5)
    for _ in range(6):
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{rng.randrange(10**6)}" for _ in range(300)).encode() for _ in range(400)])], ["text"])
def run(lean):
    task = lambda b: jaccard._packed(b, 64, 5)
    for x in batches():
        quality.features(" ".join(t.decode() for t in x.column(0).to_pylist()[:300]))
    return sum(len(x) for x in (common.lean(task) if lean else task)(batches()))
run(True)
before = mb()
rows = run(True)
lean = mb()
assert run(False) == rows > 0
print(lean - before, mb() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
def test_lean_tasks_give_memory_back():
    """A worker that ran other stages is no larger after a lean task; without it, caches and freed memory stay in the worker."""
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, timeout=120, check=True).stdout
    lean, plain = map(float, out.split())
    assert lean < 12 and plain > lean + 20
