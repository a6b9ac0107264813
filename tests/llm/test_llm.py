"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import collections
import hashlib
import html.parser
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import same_rows
from schleier.llm import bpe, content, decontaminate, media, neardup, ngram, queries, secrets, toxicity, urlfilter, warc
from schleier.llm.common import SliceHash, mix, release, same_slices, shared_dir, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGES = ["", None, "x", "Ärger 😀 don't  stop\n", "password = 'hunter2secret' " * 3000, "a b c d e f g", "a b c d e f g"]


def thue_morse(n):
    """Two different words of n bytes that any polynomial modulo a power of two hashes alike."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])


@pytest.fixture(scope="module")
def edges(spark):
    """Odd rows, with columns named as the operators' own."""
    rows = [(None if i == 2 else 5 if i > 4 else i, t, "en", "s", len(t or "")) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("token_ids", "media", "n_words", "contaminated", "score", "text_key", "secret_spans", "class_id", "body", "id", "row_"):
        df = df.withColumn(c, F.lit("theirs"))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_registered():
    assert [n.split("_")[0] for n in queries.queries()] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


def test_native_queries_equal_sql(spark, sf, duck):
    for name, sql in queries.oracle_sql().items():
        same_rows(queries.queries()[name](spark, sf), duck, sql)


def test_bpe_equals_tiktoken(spark, docs, edges):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("a b 's'll're  \n\t é1٣!?\"'漢😀xyZ") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    odd += ["!" * 500, "a" * 3000, " " * 77 + "x", "it's we'LL 'll", "''s 's x's"]
    df = docs.select("text").union(edges.select("text")).union(spark.createDataFrame([(t,) for t in odd], "text string"))
    for r in bpe.decode(bpe.encode(df, path), path, ends="token_ends").collect():
        want = enc.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == want, r["text"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert np.frombuffer(r["token_ends"], "<u4").tolist() == np.cumsum([len(enc.decode_single_token_bytes(i)) for i in want], dtype=int).tolist()
    assert bpe.encode(edges, path).columns.count("token_ids") == 1 and bpe.encode(edges.limit(0), path).count() == 0


def test_bpe_trusts_no_hash(monkeypatch):
    """With hashes that nearly always clash, and with words that a polynomial can't tell apart, ids are those of tiktoken."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join((*thue_morse(n), *thue_morse(n))) for n in (128, 1024, 4096)] + ["the quick brown foxes jumped over 1234 lazy dogs, don't they? " * 5]
    enc = bpe.Encoder(path)

    def ids(text):
        data = np.frombuffer(text.encode(), np.uint8)
        x, _, ends = enc.encode(data, np.array([0, len(data)]))
        made, stops = enc.decode(x)
        assert made.tobytes() == text.encode() and (stops == ends).all()
        return x.tolist()

    assert [ids(t) for t in texts] == [want.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(enc.hash, "slices", lambda a, b: SliceHash.slices(enc.hash, a, b) & np.uint64(3))
    enc._clear()
    assert [ids(t) for t in texts * 2] == [want.encode_ordinary(t) for t in texts * 2]


def test_bpe_of_broken_text(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    raw = [b"ab\xff c", b"\xe6\xbc", b"\xa2 d", b"fine \xc3\xa9"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary").selectExpr("i", "cast(b as string) as text")
    got = {r["i"]: bytes(r["decoded"]) for r in bpe.encode(df, path, decoded="decoded").select("i", "decoded").collect()}
    assert got == {i: b.decode("utf-8", "replace").encode() for i, b in enumerate(raw)}


def test_automaton_equals_pattern():
    import public_tokenizers
    import regex

    rnd = random.Random(7)
    for text in ("".join(rnd.choice("rsvel' \n1a!") for _ in range(rnd.randint(1, 200))) for _ in range(300)):
        kind = {"'": bpe.QUOTE}
        enc = bpe.Encoder.__new__(bpe.Encoder)
        enc.classes = bpe.code_point_classes()
        code = np.array([ord(c) for c in text], np.uint32)
        starts = bpe.Automaton().piece_starts(enc.symbols(code, np.array([0])), np.array([0])).tolist()
        assert starts == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)] and kind


def test_media_round_trip(spark, docs, edges):
    for r in media.probe(media.write(docs.select("text").union(edges.select("text"))), payload="payload").collect():
        body = (r["text"] or "").encode()
        (t,) = r["media_tracks"]
        assert bytes(r["payload"]) == body + bytes(-len(body) % 64 or 64 * (not body)) and t["bytes"] == t["duration"] == len(r["payload"]) and t["codec"] == "raw "
        assert [bytes(r["media"][k["start"] : k["end"]]) for k in t["keyframes"]] == [bytes(r["payload"][i : i + 64]) for i in range(0, len(r["payload"]), 65536)]
    assert media.probe(media.write(edges.limit(0))).count() == 0


def test_media_of_others(spark):
    """A nested container with varying sizes, wide boxes and several chunks; broken ones are told."""
    import struct

    full = media.full_box
    sizes, chunks = [3, 5, 2, 7], [(0, 2), (2, 4)]
    data = b"aaabbbbbccddddddd"
    head = media.box(b"ftyp", b"isom", bytes(4))

    def movie(at):
        places = [at, at + 8 + 100]
        table = media.box(b"stbl", full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), full(b"stts", struct.pack(">IIIII", 2, 1, 5, 3, 10)), full(b"ctts", struct.pack(">IIi", 1, 4, -2), version=1), full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), full(b"co64", struct.pack(">I2Q", 2, *places)), full(b"stss", struct.pack(">II", 1, 3)))
        mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 90, 360, 0, 0), version=1), full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", table))
        return media.box(b"moov", media.box(b"udta", media.box(b"free")), media.box(b"trak", full(b"tkhd", struct.pack(">IIII", 0, 0, 9, 0)), mdia))

    at = len(head) + len(movie(0)) + 16
    body = data[:8] + bytes(100) + data[8:]
    file = head + movie(at) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    df = spark.createDataFrame([(bytearray(file),), (bytearray(file[:-30]),), (bytearray(b"\0\0\0\x04junk"),), (None,), (bytearray(),)], "media binary")
    good, cut, junk, none, empty = media.probe(df, payload="p").collect()
    (t,) = good["media_tracks"]
    assert (t["track_id"], t["handler"], t["codec"], t["timescale"], t["duration"], t["samples"]) == (9, "vide", "avc1", 90, 360, 4)
    assert bytes(good["p"]) == data and bytes(file[t["keyframes"][0]["start"] : t["keyframes"][0]["end"]]) == b"cc"
    assert t["keyframes"][0]["time"] == 5 + 10 - 2
    assert cut["media_error"] and junk["media_error"] and none["media_error"] == "null" and empty["media_tracks"] == [] and empty["media_error"] is None


def test_media_fragments(spark):
    """Samples of fragments belong to their track: sizes, durations, marks and places from the run, the fragment or the movie's defaults."""
    import struct

    full, u = media.full_box, lambda *x: struct.pack(f">{len(x)}I", *x)
    empty = media.box(b"stbl", full(b"stsd", u(1), media.box(b"avc1", bytes(78))), full(b"stts", u(0)), full(b"stsc", u(0)), full(b"stsz", u(0, 0)), full(b"stco", u(0)))
    mdia = media.box(b"mdia", full(b"mdhd", u(0, 0, 90, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", empty))
    moov = media.box(b"moov", media.box(b"trak", full(b"tkhd", u(0, 0, 3, 0)), mdia), media.box(b"mvex", full(b"trex", u(3, 1, 7, 2, media.NOT_SYNC))))

    def fragment(*runs, start=None, flags=0x20000, **more):
        head = full(b"tfhd", u(more.get("track", 3)), flags=flags)
        time = full(b"tfdt", struct.pack(">Q", start), version=1) if start is not None else b""
        make = lambda at: media.box(b"moof", full(b"mfhd", u(1)), media.box(b"traf", head, time, *(r(at) for r in runs)))
        return make(len(make(0)) + 8)

    # two samples of 4 and 3 bytes that last 5 each, the first one in sync; then two of the defaults
    own = lambda at: full(b"trun", u(2), struct.pack(">i", at), u(0, 5, 4, 0, 5, 3, 1), flags=0x1 | 0x4 | 0x100 | 0x200 | 0x800)
    plain = lambda at: full(b"trun", u(2))
    file = media.box(b"ftyp", b"iso5", bytes(4)) + moov + fragment(own, plain) + media.box(b"mdat", b"aaaabbbccdd")
    second = fragment(lambda at: full(b"trun", u(1), struct.pack(">i", at), u(0), flags=0x1 | 0x4), start=100) + media.box(b"mdat", b"ee")
    bad = [file + fragment(plain, track=9), file[:-1], moov + fragment(lambda at: full(b"trun", u(1 << 31))), moov + fragment(lambda at: full(b"trun", u(5), flags=0x200))]
    got = media.probe(spark.createDataFrame([(bytearray(x),) for x in (file + second, *bad)], "media binary"), payload="p").collect()
    (t,) = got[0]["media_tracks"]
    assert bytes(got[0]["p"]) == b"aaaabbbccddee" and (t["samples"], t["bytes"], t["duration"], t["codec"]) == (5, 13, 107, "avc1")
    whole = file + second
    assert [(bytes(whole[k["start"] : k["end"]]), k["time"]) for k in t["keyframes"]] == [(b"aaaa", 0), (b"ee", 100)]
    assert all(r["media_tracks"] == [] and r["media_error"] for r in got[1:])


def brute_model(texts, order):
    """(log10 of a list of tokens' probability, probability of a word after others, tokens, words): counted with tuples."""
    grams = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        padded = ["<s>"] * order + t
        for k in range(1, order + 1):
            grams[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order, len(padded)))
    counts = {order: grams[order]}
    for k in range(1, order):
        before = collections.Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: n if g[0] == "<s>" else before[g] for g, n in grams[k].items()}
    cut = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == j for v in c.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        cut[k] = [0.0, *(min(max(x, 0.0), j) for j, x in enumerate(d, 1))]
    total, left = collections.Counter(), collections.Counter()
    for k, c in counts.items():
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += cut[k][min(v, 3)]
    words = len(counts[1])

    def p(context, w):
        out = left[()] / total[()] / (words + 1) if total[()] else 1 / (words + 1)
        for k in range(1, order + 1):
            c = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
            v = counts[k].get((*c, w), 0)
            if k == 1:
                out += (v - cut[1][min(v, 3)]) / max(total[()], 1)
            elif total[c]:
                out = (v - cut[k][min(v, 3)] + left[c] * out) / total[c]
        return out

    def log(t):
        padded = ["<s>"] * order + t
        return sum(math.log10(p(padded[:i], padded[i])) for i in range(order, len(padded)))

    return log, p, sum(grams[1].values()), words


@pytest.mark.parametrize("order", [2, 3, 4])
def test_ngram_equals_counting(spark, docs, edges, order):
    morse = thue_morse(1024)
    more = [(7000, "x y x y x y " * 400), (7001, f"{morse[0]} {morse[1]} {morse[0]}")]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(60).union(edges.select("doc_id", "text")).collect()] + more
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "</s>"]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    log, p, n, v = brute_model([split(t) for d, t in rows if not out(d)], order)
    c = collections.Counter(w for d, t in rows if not out(d) for w in split(t))
    for context in (["x"] * order, ["<s>"] * order, ["the", "of", "and", "in"][-order:]):
        assert abs(sum(p(context, w) for w in c) + p(context, "unseen") - 1) < 1e-9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram.train(df.where(~ngram.held_out()), order=order)
    assert (model.tokens, model.words) == (n, v)
    for r in ngram.score(df, model).collect():
        t = split(r["text"])
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(c[w] > 0 for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] == pytest.approx(log(t))
    nothing = ngram.train(df.limit(0), order=order)
    assert [r["score"] for r in ngram.score(df, nothing).collect()] == [0.0] * len(rows) and ngram.score(df.limit(0), model).count() == 0


def test_ngram_lookups():
    """Blobs and files give back what was put in, in any number of ranges and with any size of count."""
    rnd = np.random.default_rng(5)
    for n in (1, 7, 5000):
        keys = np.unique(rnd.integers(0, 1 << 40, n, dtype=np.uint64))
        columns = [rnd.integers(0, 400, len(keys)).astype(float) for _ in range(6)]
        for some in (columns[:1], columns):
            back = ngram.unpack(ngram.pack(keys, some), len(some))
            assert all(np.array_equal(a, b) for a, b in zip(back, [keys, *some]))


def test_slices():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 1 << 16).astype(np.uint8)
    starts, sizes = rnd.integers(0, len(data) - 400, 20_000), rnd.integers(0, 12, 20_000)
    sizes[:40] = rnd.integers(100, 300, 40)
    hashes, seen = SliceHash()(data, starts, starts + sizes), {}
    for a, n, h in zip(starts, sizes, hashes):
        assert seen.setdefault(int(h), data[a : a + n].tobytes()) == data[a : a + n].tobytes()
    a, b = SliceHash().load(data), SliceHash().load(data[::-1].copy())
    other = rnd.integers(0, len(data) - 400, 20_000)
    want = [data[x : x + n].tobytes() == data[::-1][y : y + n].tobytes() for x, y, n in zip(starts, other, sizes)]
    assert same_slices(a, starts, b, other, sizes).tolist() == want and any(want) and not all(want)
    for n in (128, 1024, 4096):
        both = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        x, y = SliceHash()(both, np.array([0, n]), np.array([n, 2 * n]))
        assert x != y


def test_shared_folders_are_never_local_on_a_cluster():
    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster(), "x")


def test_release(spark):
    df = stored(spark.range(3).toDF("x"), "test")
    assert df.count() == 3 and release(spark) >= 1 and release(spark) == 0
    with pytest.raises(Exception, match="exist"):
        df.collect()


def test_fm_index():
    rnd = random.Random(3)
    for _ in range(150):
        top = rnd.randint(1, 5)
        text = np.array([x for _ in range(rnd.randint(1, 8)) for x in [*(rnd.randint(1, top) for _ in range(rnd.randint(1, 30))), 0]])
        index = decontaminate.FMIndex(text, top + 1)
        for size in (1, 2, 3, 7):
            sought = [[rnd.randint(1, top) for _ in range(size)] for _ in range(6)]
            low, high = index.search(np.array(sum(sought, [])), np.arange(6) * size, np.full(6, size))
            for s, a, b in zip(sought, low, high):
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == [i for i in range(len(text) - size + 1) if text[i : i + size].tolist() == s]


def brute_contamination(rows, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(len(w) - 12) if len(w) >= 13 else [0] if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for t in rows:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= ids
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), sorted(found - {None}), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300, 40])
def test_decontamination_equals_search(spark, sf, docs, edges, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame([(900, "b C, d"), (901, None), (902, "..."), (900, "b C, d"), (None, "f g")], "item_id long, text string"))
    df = docs.select("doc_id", "text").union(edges.select("doc_id", "text"))
    got = decontaminate.judged(decontaminate.mark(df, bench)).collect()
    want = brute_contamination([r["text"] for r in got], [tuple(r) for r in bench.collect()])
    assert [(r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) for r in got] == want and sum(w[3] for w in want) > 2
    for r in got:
        assert sum(len(WORD.findall(r["text"][s["start"] : s["end"]])) for s in r["removal_spans"]) == r["n_hit"]
    a, b = thue_morse(1024)
    alike = decontaminate.judged(decontaminate.mark(spark.createDataFrame([(f"x {a} y {b}",)], "text string"), spark.createDataFrame([(1, b), (2, f"{b} y"), (3, f"{a} y")], "item_id long, text string"))).first()
    assert (alike["n_hit"], alike["hit_items"]) == (3, [1, 3])
    kept = decontaminate.clean(edges, bench)
    assert kept.columns == edges.columns and kept.count() == edges.count() - sum(w[3] for w in want[-len(EDGES) :])
    assert decontaminate.mark(df, bench.limit(0)).where("size(hit_items) > 0").count() == 0 and decontaminate.mark(df.limit(0), bench).count() == 0


def test_url_filter_by_days(spark):
    events = [("bad.org", 5, "spam", True), ("bad.org", 9, "spam", False), ("bad.org", 9, "spam", True), ("bad.org", 20, "spam", False), ("x.bad.org", 1, "adult", True), ("bad.org", 1, "spam", False), (None, 1, "spam", True), ("bad.org", 7, "spam", True)]
    pages = [("http://X.bad.org:80/a", d) for d in (0, 1, 5, 9, 19, 20, None)] + [("https://u@notbad.org/", 6), ("junk", 6), (None, 6), ("http://bad.org", 6), ("http://bad.org", 6)]
    got = urlfilter.judge(spark.createDataFrame(pages, "url string, fetch_day int").withColumn("host", F.lit("theirs")), spark.createDataFrame(events, "key string, day int, category string, added boolean"))
    key = lambda r: (str(r[0]), r[1] if r[1] is not None else -1)
    assert [(r["n_entries"], r["categories"]) for r in sorted(got.select("url", "fetch_day", "n_entries", "categories").collect(), key=key)] == [(0, "")] * 3 + [(1, "adult")] + [(2, "adult,spam")] * 3 + [(1, "adult")] + [(1, "spam")] * 2 + [(0, "")] * 2
    none = lambda df: urlfilter.judge(df, spark.createDataFrame(events, "key string, day int, category string, added boolean").limit(0))
    some = spark.createDataFrame(pages, "url string, fetch_day int")
    assert none(some).where("blocked").count() == 0 and none(some).count() == len(pages) and none(some.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


PAGE = """<html><head><title>T</title></head><body class="page"><div id=menu><a href=1>Home</a></div><header><h2>Site</h2></header><div class="cookie-notice"><p>We use cookies, yes.</p></div>
<div><div><h1>Head&amp;line</h1><p>First <b>bold</b> words, and more of them; long enough.<p>Second&nbsp;one is here,<br>after a break. It goes on.</div><ul class="related-links"><li>Other</ul></div>
<form><p>Name</p></form><section id="comments"><p>Great, really great article, I must say!</p></section><script>if (a<b) "<p>x</p>"</script><footer>c</footer>"""


def main_text(page):
    return " ".join(b.text for b in content.content(page)[0])


def test_content(spark, edges):
    assert main_text(PAGE) == "Head&line First bold words, and more of them; long enough. Second one is here, after a break. It goes on."
    assert main_text("") == main_text("<p>") == "" and main_text("just text, no tags") == "just text, no tags"
    out = content.extract(edges.withColumn("html", F.col("text")))
    assert out.columns.count("text") == 1 and out.where("text is null").count() == 0 and content.extract(edges.limit(0), page="text", text="t").count() == 0


LEDE = "The first paragraph is long enough, and it has marks; it goes on for a while. " * 4
SECOND = "A second one follows, with more words, and ends here. " * 5
BODY = f"<p>{LEDE}</p><p>Short.</p><ul><li>one</li><li>two items</li></ul><p>{SECOND}</p><table><tr><td>a</td><td>b</td></tr></table><h2>More</h2><p>{SECOND}</p>"
WHOLE = f"A title of it {LEDE}Short. one two items {SECOND}a b More {SECOND}".strip()
TITLE, TOP = "<h1>A title of it</h1>", '<nav><ul><li><a href=1>Home</a></li></ul></nav><div class="ad">Buy this now, it is cheap. Really, buy it!</div>'
SIDE = '<div class="sidebar"><h3>Other</h3><p>Some words of the side, which go on, and on.</p></div>'
COMMENTS = '<div id="comments"><h3>Comments</h3><div class="comment"><p>' + "Great read, I must say, thank you so much! " * 3 + "</p></div></div>"


@pytest.mark.parametrize(
    "page",
    [
        f'{TOP}<div class="content has-sidebar"><article>{TITLE}{BODY}</article>{SIDE}</div>{COMMENTS}<footer>(c)</footer>',
        f'{TOP}<div class="page-wrapper no-sidebar"><div>{TITLE}{BODY}</div></div>',
        f'{TOP}<div class="layout sidebar-right"><div class="main">{TITLE}{BODY}</div>{SIDE}</div>{COMMENTS}',
        f'{TOP}<article><div class="entry-header">{TITLE}</div>{BODY}</article>{COMMENTS}',
        f"<header><h2>Site</h2></header><article><header>{TITLE}</header>{BODY}</article>",
        f"{TOP}{TITLE}{BODY}<footer>(c)</footer>",
        f"{TOP}<main>{TITLE}<article>{BODY}</article></main>{SIDE}",
        f"<table><tr><td><a href=x>Home</a><br><a href=y>Two</a></td><td>{TITLE}{BODY}</td></tr></table>",
        f'<body class="single comments-open has-sidebar">{TOP}<div class="post comments-open">{TITLE}<div class="entry-content">{BODY}</div></div><section class="comments">{COMMENTS}</section>',
    ],
)
def test_whole_articles(page):
    assert main_text(page) == WHOLE


def test_several_articles():
    assert main_text(f"{TOP}<article>{TITLE}{BODY}</article><article><h2>Tiny</h2><p>One sentence only here.</p></article>{SIDE}") == f"{WHOLE} Tiny One sentence only here."


def test_pages_take_no_square_of_their_length():
    began = time.time()
    for odd in ("<div>x" * 30_000, "</div>" * 50_000, "<p>x" * 30_000, "<center>x" * 30_000, "<ul><li>" * 20_000 + "x", "<tr>" * 20_000, "<td><p>x" * 20_000, '<a "' * 20_000):
        content.content(odd)
    assert time.time() - began < 60


class Tree(html.parser.HTMLParser):
    """Well-formed pages as (tag, classes, children)."""

    def __init__(self, page):
        super().__init__()
        self.path = [("", "", [])]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.path[-1][2].append((tag, dict(attrs).get("class", ""), []))
        self.path.append(self.path[-1][2][-1])

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.path[-1][2].append(data)


def brute_content(page):
    """Ratios by their definitions: everything anew for each block."""
    blocks = []  # (chain of elements from the root, text, linked characters)

    def walk(element, chain):
        for child in element[2]:
            if isinstance(child, str):
                blocks.append((chain, child, 0))
            elif child[0] == "a":
                blocks.append((chain, child[2][0], len(child[2][0])))
            elif child[0] != "nav":
                walk(child, [*chain, child])

    top = Tree(page).path[0]
    walk(top, [top])
    joined = []
    for chain, text, linked in blocks:  # text and links of one element that nothing breaks off are one block
        if joined and joined[-1][0][-1] is chain[-1] and joined[-1][3] == id(chain[-1]):
            joined[-1] = (chain, joined[-1][1] + text, joined[-1][2] + linked, id(chain[-1]))
        else:
            joined.append((chain, text, linked, id(chain[-1])))
    every = [(chain, text, linked) for chain, text, linked, _ in joined]
    parts, beside = content.PARTS, content.BESIDE
    unit = lambda chain: next(i for i in range(len(chain) - 1, -1, -1) if chain[i][0] not in parts)
    path = lambda chain: tuple((e[0], e[1]) for e in chain[: unit(chain) + 1])
    marks = lambda text: len(re.findall("[.,;:!?]", text))
    runs = []
    for b in every:
        owner = b[0][unit(b[0])]
        if not runs or runs[-1][0][0][unit(runs[-1][0][0])] is not owner:
            runs.append([])
        runs[-1].append(b)
    length = lambda bs: sum(len(t) for _, t, _ in bs)
    punctuation = lambda bs: sum(marks(t) for _, t, _ in bs)
    apart = lambda bs: min(1.0, 2 * (1 - sum(n for *_, n in bs) / length(bs)))
    ratio = lambda x, y: math.log(1 + x * (1 + y))

    def of_path(p):
        mine = [r for r in runs if path(r[0][0]) == p]
        return ratio(sum(map(length, mine)) / len(mine), sum(map(punctuation, mine)) / len(mine)), apart(sum(mine, []))

    def near(a, b):
        up = lambda chain: [id(e) for e in chain[max(0, unit(chain) - 2) : unit(chain) + 1]]
        return set(up(a)) & set(up(b))

    size = length(every)
    inside = lambda e: [b for b in every if any(x is e for x in b[0])]
    named = lambda e, chain: e[1] == "ad" and 5 * length(inside(e)) < 4 * size and not any(x[0] == "article" for b in inside(e) for x in b[0][next(i for i, y in enumerate(b[0]) if y is e) + 1 :])
    low = lambda chain: any(named(e, chain) for e in chain)
    plain = [b for b in every if not low(b[0])]
    covered = [b for b in plain if any(e[0] == "article" for e in b[0])]
    marked = covered and 4 * length(covered) >= length(plain)
    scores = []
    for i, run in enumerate(runs):
        chain = run[0][0]
        own, out = of_path(path(chain))
        best = []
        for side in ((-1, -2), (1, 2)):
            if found := [content.FURTHER ** (abs(d) - 1) * of_path(path(runs[i + d][0][0]))[0] for d in side if 0 <= i + d < len(runs) and near(runs[i + d][0][0], chain)]:
                best.append(max(found))
        total, fade = max(own, (own + beside * sum(best)) / (1 + beside * len(best))), content.FADE
        for e in reversed(chain[: unit(chain)]):
            if length(inside(e)) < size and e[0] not in parts:
                total += fade * ratio(length(inside(e)), punctuation(inside(e))) * apart(inside(e))
                fade *= content.FADE
        for b in run:
            place = 1.0 if not marked or any(e[0] == "article" for e in b[0]) else content.OUTSIDE_PRIOR
            scores.append((b, total * out * place * (content.NAMED_PRIOR if low(b[0]) else 1.0)))
    cut = content.SHARE * sum(s * len(b[1]) for b, s in scores) / size if size else 0
    key = lambda b: (path(b[0]), low(b[0]))
    mean = lambda k: sum(s for b, s in scores if key(b) == k) / sum(key(b) == k for b, _ in scores)
    return " ".join(b[1] for b, _ in scores if 0 < mean(key(b)) >= cut)


def test_content_equals_definitions():
    rnd = random.Random(12)
    text = lambda: " ".join(rnd.choice(["wort", "noch,", "eins.", "langes-wort"]) for _ in range(rnd.choice([1, 3, 12, 40])))

    def element(depth):
        tag = rnd.choice(["p", "p", "h2", "ul", "table"] if depth > 3 else ["p", "p", "h2", "ul", "table", "div", "div", "section", "article", "nav"])
        if tag in ("p", "h2"):
            return f"<{tag}>{text()}{f'<a>{text()}</a>' if rnd.random() < 0.3 else ''}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{f'<a>{text()}</a>' if rnd.random() < 0.3 else text()}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>"
        if tag == "table":
            return "<table>" + "".join(f"<tr><td>{text()}</td><td>{text()}</td></tr>" for _ in range(rnd.randint(1, 3))) + "</table>"
        inner = "".join(element(depth + 1) for _ in range(rnd.randint(1, 4)))
        name = f' class="{rnd.choice(["ad", "x", "has-sidebar"])}"' if tag in ("div", "section") and rnd.random() < 0.4 else ""
        return f"<{tag}{name}>{inner}</{tag}>"

    kept = 0
    for _ in range(400):
        page = "".join(element(0) for _ in range(rnd.randint(1, 5)))
        got = main_text(page)
        # states aren't part of a path
        assert got == brute_content(page.replace(' class="has-sidebar"', "")), page
        kept += bool(got)
    assert kept > 300


def test_warc_archive(spark):
    long = "ä" * 600
    rows = [(1, "http://a\r\nX: y", long), (3, None, long), (2, "u", long), (3, "v", long), (None, "w", long), (4, "s", "short"), (5, "s", "short"), (6, "n", None)]
    at = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.records(spark, at).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted([("1", "revisit", 3), ("3", "response", None), ("2", "revisit", 3), ("3", "response", None), ("None", "revisit", 3), ("4", "response", None), ("5", "response", None), ("6", "response", None)])
    assert spark.read.parquet(at.payloads).count() == 3
    for r in got:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(rest) - 4 and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(r["payload"]).hexdigest() == "sha1:" + r["digest"]
        assert (rest.partition(b"\r\n\r\n")[2] == bytes(r["payload"]) + b"\r\n\r\n") == (r["record_type"] == "response") or not r["payload"]
    assert warc.records(spark, warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_hot_payloads(spark, monkeypatch):
    """A payload of many records is read in parts, and columns named as the operator's own don't matter."""
    monkeypatch.setattr(warc, "EACH", 8)
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("x"), 2000)).otherwise(F.concat(F.lit("y"), F.col("id"))).alias("html"))
    for c in ("address", "payload", "copies", "kept", "part", "digest"):
        df = df.withColumn(c, F.lit("theirs"))
    at = warc.archive(df)
    got = warc.records(spark, at)
    assert got.where("record_type = 'revisit' and refers_to = 299").count() == 199 and got.where("record_type = 'response'").count() == 101
    assert got.where(F.sha2("payload", 256) != F.lit(hashlib.sha256(b"x" * 2000).hexdigest())).count() == 100 and spark.read.parquet(at.headers).select("part").distinct().count() > 8


def test_secrets(spark, docs, edges):
    regexes = {"assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    odd = [("é PassWord: abcdef token=secret=abcdefgh " + "0" * 24 + "g AKIA" + "Z" * 16 + " AKIAX",), ("api_key='abc' API-KEY=zzzzzz",), ("ſecret=abcdefg",)]
    df = docs.select("text").union(edges.select("text")).union(spark.createDataFrame(odd, "text string"))
    for r in secrets.scan(df).collect():
        want = []
        for kind, x in regexes.items():
            want += [(kind, *m.span()) for m in x.finditer(r["text"] or "") if (len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24))]
        assert sorted(tuple(s)[:3] for s in r["secret_spans"] if s["kind"] != "lex") == sorted(want)
    code = 'host = "example.org"\nKEY = "s3cr3t-V4lue-93x"\nclientSecret = KEY\nprivate_key: \'Zx9/kk+Pq0011aa\'\nname = "not a secret"\ndb_pwd = "p4rt-one-" + KEY\npwd = "changeme"\n'
    found = {code[a:b] for k, a, b, _ in secrets.spans(code) if k == "lex"}
    assert found == {"s3cr3t-V4lue-93x", "Zx9/kk+Pq0011aa", "p4rt-one-"}
    masked = secrets.redact(edges)
    assert masked.columns == edges.columns and masked.where("text rlike 'hunter2'").count() == 0 and masked.where("text = 'x'").count() == 1
    assert secrets.scan(edges.limit(0)).count() == 0 and secrets.spans("") == []


def test_secrets_of_any_length():
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefghijkLMNOPQRSTUV0123456789+/") for _ in range(6000))
    lex = lambda text: [text[a:b] for k, a, b, _ in secrets.spans(text) if k == "lex"]
    assert lex(f"private_key = {long}\n") == [long] == lex(f'private_key = "{long}"\n') == lex(f"pwd{' ' * 50}={' ' * 50}'{long}'")
    assert lex(f"{'x' * 200}_pwd = '{long[:30]}'") == [long[:30]]
    parts = [f"{i}-{long[i * 9 : i * 9 + 9]}" for i in range(90)]
    assert lex("pwd = " + " + ".join(f'"{p}"' for p in parts[:20])) == parts[:20]
    assert lex("pwd = " + f"{' ' * 20}+{' ' * 20}".join(f'"{p}"' for p in parts[:3])) == parts[:3]
    assert lex("k = " + " + ".join(f'"{p}"' for p in parts) + "\npwd = k\n") == parts
    doubled = f'k0 = "{long[:30]}"\n' + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 200)) + "pwd = k199\n"
    assert lex(doubled) == [long[:30]]
    for odd in ('pwd="' * 50_000, "pwd = " + "a + " * 50_000, "pwd" + " " * 200_000, '"' + "a" * 200_000, "pwd='\\" * 50_000):
        secrets.spans(odd)


def test_lexer_equals_what_was_written():
    """Configurations written from known names and literals: exactly the sensitive ones are found, wherever they stand."""
    rnd = random.Random(6)
    alphabet = "abcdefghJKLMNPQRS23456789-_/+"
    literal = lambda: rnd.choice("abcd") + rnd.choice("JKLM") + rnd.choice("2345") + "".join(rnd.choice(alphabet) for _ in range(rnd.choice([10, 30, 200])))
    forms = [
        ('{n} = "{v}"', 1), ("{n} = '{v}';", 1), ("{n}: {v}", 1), ('"{n}": "{v}",', 1), ("{n} := `{v}`", 1), ('{n} => "{v}"', 1), ("export {n}={v}", 1), ('  cfg.{n} = "{v}"  # note', 1), ('os["{n}"] = "{v}"', 1),
        ("{n} =\n    '{v}'", 1), ("{n} = \\\n  '{v}'", 1), ("{n}: # why\n\n  '{v}'", 1), ("{n}:\n  {v}", 1), ("{n}: >-\n  {v}", 1), ("{n}: |\n  {v}\n  {w}", 2), ('{n} = """{v}"""', 1), ("# {n} = '{v}'", 1), ("/* {n}: '{v}' */", 1),
        ('{n}: str = "{v}"', 1), ('{n} = decode("{v}")', 1), ('{n} = ["{v}", "{w}"]', 3), ('f(host="h", {n}="{v}")', 1), ('{n} = "{v}" + "{w}"', 3), ('{n} = "{v}"\\\n  "{w}"', 3), ("tool --{n}={v} -x", 1), ('{n} {{ value = "{v}" }}', 0), ('{n}: {{"value": "{v}"}}', 1), ("{n}:\n  value: {v}", 1),
        ('if {n} == "{v}" {{', 1), ("{n} = make_{v}()", 0), ("{n} = other.name.of", 0), ("the {n} is {v}", 0),
    ]
    for _ in range(300):
        text, want = [], []
        for form, found in rnd.choices(forms, k=rnd.randint(1, 8)):
            sensitive = rnd.random() < 0.6
            name = rnd.choice(["pwd", "db_pwd", "signingKey", "PRIVATE_KEY", "auth_passphrase"] if sensitive else ["host", "name_of", "colour", "pwd_hint", "tokens_path"])
            v, w = literal(), literal()
            text.append(form.format(n=name, v=v, w=w))
            if sensitive and found:
                at = sum(len(t) + 1 for t in text[:-1])
                begin = text[-1].index(v) + at
                end = text[-1].index(w) + at + len(w) if found == 2 else begin + len(v)
                want += [(begin, end)] + ([(text[-1].index(w) + at, text[-1].index(w) + at + len(w))] if found == 3 else [])
            text.append("")
        whole = "\n".join(text)
        assert [(a, b) for k, a, b, _ in secrets.spans(whole) if k == "lex"] == sorted(want), whole


def test_masking_is_whole(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefghJKLMNPQRS23456789+/") for _ in range(10_000))
    body = f"private_key = '{long}' and passwd=hunter2x AKIA{'A' * 16}{'a' * 24} end"
    r = secrets.redact(spark.createDataFrame([(body,), (None,), ("é " * 500 + body,)], "text string")).collect()
    assert [x["text"] for x in r] == ["private_key = '[SECRET]' and [SECRET] [SECRET] end", None, "é " * 500 + "private_key = '[SECRET]' and [SECRET] [SECRET] end"]


def test_signatures_are_unbiased():
    rnd = random.Random(5)
    keys = np.array([rnd.getrandbits(52) for _ in range(300)], np.uint64)
    a = np.array([rnd.choice([1, 1, 2, 3, 9]) for _ in range(300)])
    b = np.where(np.arange(300) % 4 == 0, np.array([rnd.choice([1, 2, 4, 7]) for _ in range(300)]), a)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = []
    for t in range(60):
        k = mix(keys + np.uint64(t * 12345)) >> np.uint64(12)
        s = neardup.signatures(np.repeat([0, 1], 300), np.concatenate([k, k]), np.concatenate([a, b]), 2)
        seen.append((s[0] == s[1]).mean())
        alone = neardup.signatures(np.zeros(300, int), k, a, 1)
        assert (alone[0] == s[0]).all()  # what else is in a batch doesn't matter
    assert abs(np.mean(seen) - true) < 4 * math.sqrt(true * (1 - true) / 160 / 60)


def test_large_buckets_miss_less_than_bands():
    at = lambda m: math.comb(160, m) * 0.8**m * 0.2 ** (160 - m)
    bands = (1 - 0.8**neardup.ROWS) ** neardup.BANDS
    assert neardup.REGISTERS == 160 and sum(map(at, range(neardup.LEAST))) < 3e-9 < bands < 3.1e-6
    # 64 choices of 10 of the same registers, as finer buckets once had, aren't independent
    finer = sum(at(m) * (1 - math.comb(m, 10) / math.comb(160, 10)) ** 64 for m in range(161))
    assert 8.1e-3 < finer < 8.2e-3


def brute_classes(rows, kept=False):
    """rows: (id, text); the least id of each row's component of pairs at 0.8, by all pairs; or that of each component."""

    def bag(t):
        w = WORD.findall((t or "").translate(LOW))
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None

    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a is None or b is None:
                same = a is b and (rows[i][1] or "") == (rows[j][1] or "")
            else:
                n = sum((a & b).values()) if min(len(a), len(b)) and (a.keys() & b.keys()) else 0
                same = 5 * n >= 4 * (a.total() + b.total() - n)
            if same:
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(rows))] if not kept else [least.get(i) for i in range(len(rows)) if top(i) == i]


def test_near_duplicates_equal_all_pairs(spark, docs, edges):
    rnd = random.Random(9)
    base = [f"wort{rnd.randint(0, 500)}" for _ in range(120)]
    star = [(1000 + k, " ".join(w if rnd.random() > 0.02 * (k % 4) else "neu" + str(rnd.random()) for w in base)) for k in range(90)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(r["doc_id"], r["text"]) for r in edges.collect()] + star + [(3000, ""), (3001, "!!"), (3002, "??")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter(zip([d for d, _ in rows], brute_classes(rows)))
    assert collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.classes(df).collect()) == want
    kept = neardup.dedupe(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, brute_classes(rows, kept=True)))
    assert neardup.dedupe(edges).columns == edges.columns and neardup.dedupe(edges.limit(0)).count() == 0


def test_large_buckets_are_whole(spark, monkeypatch):
    """300 texts at up to 0.793 of each other, each with one twin at 0.802: nearly every bucket they share holds more than SMALL."""
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 20, raising=False)
    rnd, rows, taken = random.Random(3), [], []
    while len(rows) < 300:
        own = [set(rnd.sample(range(200), 13)) for _ in "ab"]
        both = own[0] & own[1]
        if len(both) != 2 or any(len(o & t) > 3 for o in own for t in taken):
            continue
        taken += own
        for o in own:
            words = [f"w{i}" for i in range(1004)]
            for at in o:
                words[5 * at + 4] = f"n{len(taken)}x{at}" if at in both else f"n{len(rows)}y{at}"
            rows.append((len(rows), " ".join(words)))
    assert brute_classes(rows[:40]) == [i - i % 2 for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != i - i % 2 for i in got) == 0 and len(got) == 300


def test_near_duplicates_of_words_alike(spark):
    a, b = thue_morse(1024)
    rows = [(1, f"u v w {a} x y z"), (2, f"u v w {b} x y z"), (3, f"U v, w {a} x y z!")]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_recall(spark):
    """Every fiftieth text against all: each pair at 0.8 or more is in one class, whatever its words' weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    of = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    bags = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").translate(LOW))
        bags[r["doc_id"]] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    holders = collections.defaultdict(set)
    for d, bag in bags.items():
        for s in bag or ():
            holders[s].add(d)
    found = together = 0
    for d in (d for d in bags if d % 50 == 0 and bags[d]):
        for e in set().union(*(holders[s] for s in bags[d])) - {d}:
            n = sum((bags[d] & bags[e]).values())
            if 5 * n >= 4 * (bags[d].total() + bags[e].total() - n):
                found += 1
                together += of[d] == of[e]
    assert found > 0 and together == found


def test_near_duplicates_without_ids(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:99])), (None, "something else"), (7, "one more thing here"), (7, "of the same id")]
    kept = neardup.dedupe(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(len(r["text"].split()) for r in kept.collect()) in ([2, 4, 4, 99], [2, 4, 4, 100])


def brute_clause(names, weight=1.0):
    """A clause's score by the forms of the docstring, looked up word by word."""
    total = 0.0
    for i, name in enumerate(names):
        if name == "insult":
            total += weight * (toxicity.NEGATED if "negation" in names[max(0, i - toxicity.REACH) : i] else 1.0)
    waiting = 0  # words that an unaimed threat still waits for its target
    for i, name in enumerate(names):
        if name == "target":
            total += toxicity.THREAT_WEIGHT if waiting else 0.0
            waiting = 0
        elif name == "threat" and "target" in names[max(0, i - toxicity.BEFORE) : i]:
            total += toxicity.THREAT_WEIGHT
            waiting = 0
        else:
            waiting = toxicity.AFTER if name == "threat" else max(0, waiting - 1)
    return total * (toxicity.AIMED if "target" in names else 1.0) * (toxicity.REPORTED if "report" in names else 1.0)


def test_toxicity_grammar():
    names = ("other", "insult", "threat", "target", "negation", "report")
    score = lambda text: toxicity.clause_scores([names.index(w) for w in text.split()], [1.0 if w == "insult" else 0.0 for w in text.split()], [True] + [False] * (len(text.split()) - 1))
    assert score("other other") == score("target") == score("threat") == score("negation target report") == []
    assert score("insult") == [1.0] and score("target insult") == score("insult other target") == [pytest.approx(1.3)]
    assert score("negation insult")[0] < 1 and score("insult other report")[0] < 1 and score("threat target") == score("target threat") == [pytest.approx(3.9)]
    rnd = random.Random(8)
    for _ in range(5000):
        clause = [rnd.choice(names + ("other",) * 4) for _ in range(rnd.randint(1, 14))]
        assert sum(score(" ".join(clause))) == pytest.approx(brute_clause(clause))
    two = toxicity.clause_scores([1, 3, 1], [1.0, 0.0, 2.0], [True, False, True])
    assert two == [pytest.approx(1.3), 2.0]
    assert toxicity.lowered("ÉCOLE Über ×Ж") == "école über ×Ж" and toxicity.chosen([("a", 5, 0)], 0, 3) == []


def test_toxicity_keeps_all_that_pass(spark):
    """No candidate that passes the tests is dropped before them, though labels of 1 are few."""
    rows = [(i, f"w{i} " + ("grumpf" if i < 30 or i % 100 == 7 else "plain"), int(i < 160)) for i in range(16_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    p, n = sum("grumpf" in t and y for d, t, y in rows if d not in held), sum("grumpf" in t and not y for d, t, y in rows if d not in held)
    toxic, clean = sum(y for d, _, y in rows if d not in held), sum(not y for d, _, y in rows if d not in held)
    odds, g = toxicity._tests(p, n, toxic, clean, math.log)
    assert n > 4 * p and odds >= toxicity.LEAST_ODDS and g >= toxicity.LEAST_G
    assert any(w.startswith("grumpf"[: len(w)]) for w, *_ in toxicity.learn(df, df.select("doc_id", "toxic")).insults)


def test_toxicity_tells_words_apart():
    a, b = thue_morse(1024)
    lexicon, hasher = toxicity.Lexicon([(a, True, 5.0)]), SliceHash()
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    classes, weights = lexicon.classify(hasher.load(data), data, starts, ends)
    assert classes.tolist() == [toxicity.INSULT, toxicity.OTHER] and weights.tolist() == [5.0, 0.0]


def test_toxicity_learns(spark, edges):
    rnd = random.Random(11)
    neutral = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = [rnd.choice(neutral) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rnd.randint(0, 39)] = rnd.choice(["grumpf", "zonkele", "zonkari", "zonkuma"])
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    assert {"grumpf"} <= {w for w, *_ in model.insults} and any(w.startswith("zonk") for w, *_ in model.insults)
    got = toxicity.score(df, model).where(toxicity.held_out()).select("toxic", (F.col("score") >= toxicity.CUT).cast("int").alias("p")).collect()
    assert sum(r["toxic"] != r["p"] for r in got) <= 0.02 * len(got)
    out = toxicity.score(edges, model)
    assert out.where("score is null or score < 0 or score > 1").count() == 0 and toxicity.clean(edges, model).columns == edges.columns
    none = toxicity.learn(df, df.limit(0).select("doc_id", "toxic"))
    assert none.insults == [] and toxicity.score(edges, none).count() == len(EDGES) and toxicity.score(edges.limit(0), none).count() == 0


def test_stages_take_odd_rows(spark, sf, edges):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables go through each stage on its own and through all."""
    import corpus_pipeline as cp

    for rows in (edges, edges.limit(0)):
        through = rows
        for name, stage in cp.STAGES[:-1]:
            assert stage(spark, rows, sf).columns == rows.columns, name
            through = stage(spark, through, sf)
            assert through.columns == rows.columns and through.count() <= rows.count()
        out = cp.STAGES[-1][1](spark, through, sf)
        assert out.where("n_tokens is null or decoded_sha256 is null").count() == 0 and out.count() == through.count()
    assert through.count() == 0


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-dedup", "decontamination", "secrets", "byte-bpe"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = docs.select("doc_id", "text").join(toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, labels)).where(F.col("score") < toxicity.CUT).select("doc_id"), "doc_id").orderBy("doc_id").collect()
    rows = [tuple(r) for r in clean]
    rows = [r for r, c in zip(rows, brute_classes(rows)) if r[0] == c]
    rows = [r for r, c in zip(rows, brute_contamination([t for _, t in rows], bench)) if not c[3]]

    def masked(text):
        out, at = "", 0
        for _, a, b, _ in secrets.spans(text):
            if a > at or not out:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    want = {d: hashlib.sha256((masked(t) if secrets.spans(t) else t).encode()).hexdigest() for d, t in rows}
    got = cp.run(spark, sf)
    assert {r["doc_id"]: r["decoded_sha256"] for r in got.collect()} == want
    sized = cp.mask_secrets(spark, docs, sf)
    assert sized.columns == docs.columns and sized.where("n_chars <> length(text)").count() == 0 and json.dumps(cp.ORACLE_SQL) == "null"


def test_components_read_edges_once(spark, monkeypatch):
    """Components equal plain ones, and joins read hardly more edges than there are, whatever the groups' sizes."""
    from schleier.llm import graph

    rnd = random.Random(11)
    star = [(0, i) for i in range(1, 400)]
    path = [(1000 + i, 1001 + i) for i in range(12)]
    hub = [(2900, 2000 + i) for i in range(200)]
    dense = [(4000 + rnd.randrange(60), 4000 + rnd.randrange(60)) for _ in range(900)]
    edges = [*star, *path, *hub, *dense, (-5, -5), (-9, -7), (0, 0)]
    edges += [(b, a) for a, b in edges[::7]]
    read, spread = [], graph.spread
    monkeypatch.setattr(graph, "spread", lambda left, *rest: (read.append(left.count()) if {"a", "b"} <= set(left.columns) else None, spread(left, *rest))[1])
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert sum(read) <= 3 * len({(min(e), max(e)) for e in edges})
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == [(3, 3)]


def test_workers_let_go_of_what_another_operator_kept(spark, monkeypatch):
    """A worker outlives its stage: the tokenizer stays for its own next task and goes when another operator's begins."""
    df = spark.createDataFrame([(1, "a token = 'k3Jx9_Qm2vLp8Rt'")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    batches = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a token = 'k3Jx9_Qm2vLp8Rt'"]})])
    encode = bpe.encode(df, bpe.default_vocabulary())
    bpe.encoder.cache_clear()
    first, again = list(encode(batches())), list(encode(batches()))
    assert bpe.encoder.cache_info()[:2] == (1, 1) and first == again
    assert len(list(secrets.scan(df)(batches()))) == 1
    assert bpe.encoder.cache_info().currsize == 0
    assert list(encode(batches())) == first
