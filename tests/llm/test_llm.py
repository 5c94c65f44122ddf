"""The training-data operators against brute force, round trips and odd inputs."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import automaton, media, mixing, neardup, packing, quality, repeats, scoring, sharding, topk, toxicity, webp
from loamgrid.llm.common import crc_rest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, score string, t string"
WORDS = "the of and to in is that it was for on are as with his they at be this from have or one had by word but not what all were we when your can said there".split()


def make(spark, texts, sources=None, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    n = len(texts)
    rows = [(ids[i] if ids else i, texts[i], "en", sources[i] if sources else f"s{i % 3}", len(texts[i] or ""), "x", "y", "z", "w") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "er", "ing"]) + rng.choice(["", ".", ","], p=[0.8, 0.1, 0.1]) for _ in range(n))


def odd_texts(rng):
    """Null, empty, blank, one word, repeated, very long, other scripts."""
    long = prose(rng, 20000)
    same = prose(rng, 120)
    return [None, "", "   \n\t ", "one", same, same, "word " * 300, long, "Été déjà vu — naïve 日本語 テスト", "a\x00b \x0b c", prose(rng, 80), prose(rng, 200)]


@pytest.fixture(scope="module")
def texts():
    return odd_texts(np.random.default_rng(7))


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ------------------------------------------------------------------- 1 mixing


def water(sizes, weights, cap):
    """Targets by resharing the excess until nothing is above its cap."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        out = [cap * s if i in capped else left * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > cap * sizes[i]}
        if not over:
            return out
        capped |= over


def test_mixing(spark, texts):
    rng = np.random.default_rng(1)
    more = texts + [prose(rng, int(n)) for n in rng.integers(1, 60, 300)]
    sources = [None if i % 11 == 0 else ["é", "b", "a", "huge"][min(3, i % 7)] for i in range(len(more))]
    got = mixing.mix(make(spark, more, sources)).collect()
    assert len(got) == len(more)
    by = defaultdict(list)
    for r in got:
        assert r.size == len(tokens(more[r.doc_id])) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    names = sorted(x for x in by if x is not None) + [None]
    sizes = [sum(r.size for r in by[x]) for x in names]
    for name, size, want in zip(names, sizes, water(sizes, [1, 2, 3, 1, 2][: len(names)], 3)):
        assert {r.source_size for r in by[name]} == {size}
        assert by[name][0].target == pytest.approx(want)
        assert abs(sum(r.taken for r in by[name]) - want) <= 1.2 * max(r.size for r in by[name])
    again = {(r.doc_id, r.taken) for r in mixing.mix(make(spark, more, sources).repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    kept = mixing.mixed(make(spark, more, sources))
    assert kept.columns == make(spark, ["a"]).columns and kept.count() == sum(r.copies for r in got)


def test_targets_reshare(spark):
    sizes = [1, 1, 50, 3, 900]
    rows = spark.createDataFrame([(f"0{i}", s) for i, s in enumerate(sizes)], "mix_key string, source_size long")
    got = [r.target for r in mixing.targets(rows, (1, 2, 3), 3).orderBy("mix_key").collect()]
    assert got == pytest.approx(water(sizes, [1, 2, 3, 1, 2], 3))


# ----------------------------------------------------------------- 2 toxicity


def test_grammar():
    g = toxicity.Grammar({"idiot": 4.0, "vequ*": 4.0}, toxicity.PRIOR)
    kinds = lambda s: [toxicity.KINDS[k] for k, _ in g.clauses(toxicity.fold(s))]
    assert kinds("You are an IDIOT. Fine day.") == ["aimed"]
    assert kinds("what an idiot") == ["plain"]
    assert kinds("he is not an idiot") == ["negated"]
    assert kinds("someone said idiot") == ["reported"]
    assert kinds("I will kill you") == ["threat"]
    assert kinds("I will kill time") == [] and kinds("they kill you") == []
    assert kinds("not today. idiot!") == ["plain"]
    assert kinds("le vequille") == ["plain"] and kinds("vequ") == ["plain"] and kinds("veq") == []
    assert g.score("you idiot") > 0.3 > g.score("not an idiot") > g.score("a day")


def read_by_hand(symbols):
    """Matches of a string of symbols, each read from the whole string again."""
    t = toxicity
    n, out = len(symbols), []
    words = (t.OTHER, t.INSULT, t.THREAT, t.WILL, t.TARGET, t.REPORT, t.NEGATION)
    ends = [i for i, s in enumerate(symbols) if s in (t.END, t.BREAK)]

    def clause(i):
        first = max([e + 1 for e in ends if e < i], default=0)
        return first, min([e for e in ends if e >= i], default=n)

    def negated(i):
        back = [k for k in range(clause(i)[0], i) if symbols[k] in words][-t.SCOPE :]
        return any(symbols[k] == t.NEGATION for k in back)

    def reported(i):
        state = 0
        for s in symbols[:i]:
            if s == t.REPORT:
                state = state or 1
            elif s == t.MARK:
                state = {0: 0, 1: 2, 2: 0}[state]
            elif s == t.BREAK or (s == t.END and state == 1):
                state = 0
        return state > 0

    for i, s in enumerate(symbols):
        first, last = clause(i)
        if s == t.INSULT:
            if reported(i):
                out.append(t.REPORTED)
            elif negated(i):
                out.append(t.NEGATED)
            else:
                out.append(t.AIMED if t.TARGET in symbols[first:last] else t.PLAIN)
        elif s == t.TARGET:
            verbs = [k for k in range(first, i) if symbols[k] == t.THREAT and t.WILL in symbols[first:k] and t.TARGET not in symbols[k:i]]
            if verbs:
                out.append(t.REPORTED if reported(verbs[-1]) else t.NEGATED if negated(verbs[-1]) else t.THREATENED)
    return sorted(out)


def test_grammar_by_hand():
    import itertools

    t, rng = toxicity, np.random.default_rng(5)
    some = [list(w) for n in range(5) for w in itertools.product(range(t.SYMBOLS), repeat=n)]
    some += [rng.integers(0, t.SYMBOLS, int(rng.integers(5, 16))).tolist() for _ in range(5000)]
    for word in some:
        # insults weigh 1, so that what is held and released at once adds up
        got = sorted(k for kind, w in t.read([(x, float(x == t.INSULT)) for x in word]) for k in [kind] * max(1, round(w)))
        assert got == read_by_hand(word), word


def test_grammar_keeps_reports_and_scopes():
    g = toxicity.Grammar({"idiot": 3.0, "scum": 3.0}, toxicity.PRIOR)
    kinds = lambda s: sorted(toxicity.KINDS[k] for k, _ in g.clauses(toxicity.fold(s)))
    assert kinds('he said: "you are an idiot"') == ["reported"]
    assert kinds('she said "no. you idiot" but you are scum') == ["aimed", "reported"]
    assert kinds('you are not "a total idiot"') == ["negated"]
    assert kinds("you idiot, i am not scum") == ["aimed", "negated"]
    assert kinds("you said i will kill you") == ["reported"] and kinds("i will not kill you") == ["negated"]
    assert kinds("i will kill you") == ["threat"] and g.score("i will kill you") >= 0.3 > g.score("i will not kill you")


def test_toxicity(spark, texts):
    rng = np.random.default_rng(2)
    docs, marks = list(texts), [0] * len(texts)
    for i in range(400):
        body = prose(rng, 60)
        bad = i % 5 == 0
        if bad:
            at = int(rng.integers(0, 60))
            body = " ".join([*body.split()[:at], rng.choice(["you scoundrel", "grumpfle" + rng.choice(["x", "yz", "ab"])]), *body.split()[at:]])
        docs.append(body)
        marks.append(int(bad))
    d = make(spark, docs)
    labels = spark.createDataFrame([(i, m, 1) for i, m in enumerate(marks)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    g = toxicity.train(d, labels, toxicity.held_in)
    got = {r.doc_id: r.score for r in toxicity.scored(d, g, ["doc_id"]).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) != bool(m) for i, m in enumerate(marks)) <= 2
    left = toxicity.without_toxic(d, labels)
    assert left.columns == d.columns and left.count() == sum(s < 0.3 for s in got.values())


def test_toxicity_without_labels(spark, texts):
    d = make(spark, texts)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.without_toxic(d, none).count() == len(texts)
    assert toxicity.without_toxic(d.limit(0), none).count() == 0


# -------------------------------------------------------------------- 3 media


def test_webp_round_trips():
    rng = np.random.default_rng(1)
    for w, h in [(1, 1), (2, 3), (17, 9), (64, 33)]:
        n = w * h
        full = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        few = rng.choice(full[:3], n)
        smooth = ((np.arange(n) % w * 3) | ((np.arange(n) // w * 5) << 8) | 0xFF000000).astype(np.uint32)
        bw, bh = -(-w >> 3), -(-h >> 3)
        elements = rng.integers(0, 2**24, bw * bh)
        entropy = rng.integers(0, 3, bw * bh)
        of = webp._block_values(entropy, w, h, 3)
        for px in (full, few, smooth):
            options = [{}, {"cache_bits": 5}, {"transforms": [("green",)]}, {"groups": (3, w, of, entropy)}, {"groups": (3, w, of, entropy), "cache_bits": 4, "transforms": [("green",)]}]
            options += [{"transforms": [("predictor", 2, np.full((-(-w >> 2)) * (-(-h >> 2)), m))]} for m in range(14)]
            options.append({"transforms": [("predictor", 3, rng.integers(0, 14, bw * bh)), ("cross", 3, elements), ("green",)]})
            if len(np.unique(px)) <= 256:
                options.append({"transforms": [("palette", np.unique(px))]})
            for o in options:
                assert (webp.decode(webp.encode(w, h, px, **o))[2] == px).all()
            if n > 20:
                copy = px.copy()
                copy[10:20], copy[30:] = copy[:10], copy[29]
                assert (webp.decode(webp.encode(w, h, copy, copies=[(10, 10, 10), (30, n - 30, 1)]))[2] == copy).all()


def test_webp_refuses_broken_files():
    good = webp.encode(8, 8, np.arange(64, dtype=np.uint32) * 999)
    for bad in (b"", good[:10], b"JUNK" + good[4:], good[:24] + b"\0"):
        with pytest.raises((ValueError, IndexError, struct_error)):
            webp.decode(bad)


struct_error = __import__("struct").error


def test_short_distances_cover_the_plane():
    assert len(webp.PLANE) == len(set(webp.PLANE)) == 120
    assert webp.distance(1, 50) == 50 and webp.distance(2, 50) == 1 and webp.distance(4, 50) == 49 and webp.distance(121, 50) == 1


def test_prefix_codes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(0, 50, 80) ** rng.integers(1, 6)
        lengths = webp.code_lengths(counts, 11)
        used = lengths[lengths > 0]
        assert used.max() <= 11 and (len(used) < 2 or (2.0**-used).sum() == 1)


def test_media(spark, texts):
    got = {r.doc_id: r for r in media.media(make(spark, texts), ["doc_id"], with_file=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.load(bytes(r.media)).tobytes() == pad
    assert got[4][1:] == got[5][1:] and media.media(make(spark, texts).limit(0), ["doc_id"]).count() == 0


def test_each_image_takes_what_costs_least():
    ramp = bytes((32 + (i % 192 + i // 192 * 7) % 90) for i in range(192 * 40))
    stripes = bytes(np.random.default_rng(61).integers(33, 120, 192).astype(np.uint8)) * 30
    text = prose(np.random.default_rng(62), 2000).encode()
    few = b"abcabcacb" * 200
    found = {}
    for name, raw in (("ramp", ramp), ("stripes", stripes), ("text", text), ("few", few)):
        data = media.payload(raw)
        file = media.store(data)
        assert media.load(file).tobytes() == data
        width, height = media.sides(len(data))
        pixels = (np.frombuffer(data, np.uint8).astype(np.uint32) << 8) | media.OPAQUE
        assert len(file) <= len(webp.encode(width, height, pixels)) + 8
        found[name] = (bool(int.from_bytes(file[25:26], "little") & 1), int.from_bytes(file[25:26], "little") >> 1 & 3)
    assert found["ramp"] == (True, webp.PREDICTOR) and found["stripes"] == (True, webp.PREDICTOR)
    assert found["few"] == (True, webp.PALETTE) and not found["text"][0]


def test_kept_columns_of_results_names_are_left_out(spark):
    d = make(spark, ["a b", None, "x"]).withColumns({"feature": F.lit(1), "score": F.lit("s"), "base": F.lit(2), "at": F.lit(3)})
    assert media.media(d, ["doc_id", "feature", "at"]).columns[:2] == ["doc_id", "at"]
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = quality.train(d, none, lambda c: crc_rest(c, 5) != 0)
    assert quality.scored(d, model, ["doc_id", "score"]).columns == ["doc_id", "score"]
    assert quality.scored(d.limit(0), model, ["doc_id"]).count() == 0
    assert scoring.score(d, F.lit(True), ["doc_id", "score", "base", "at"]).columns[0] == "doc_id"


def test_large_payloads():
    data = b"ab c" * (192 * 5000)  # too high for one column of rows
    w, h = media.sides(len(data))
    assert w * h == len(data) and h <= webp.MAX_SIDE
    assert media.load(media.store(data)).tobytes() == data


# -------------------------------------------------------------------- 4 top-k


def test_topk(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (400, 16)).astype(np.float32)
    v[100:140] = v[0]  # ties
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(400, None, 1), (450, [float("nan")] * 16, 1), (500, [None] + [0.0] * 15, 1), (501, [float("inf")] * 16, 1), (550, [0.0] * 16, 1), (600, [1.0, 2.0], 1), (700, [], 1), (None, [0.5] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    ids, q = np.append(np.arange(400), 550), np.vstack([q, np.zeros((1, 16), np.int64)])
    want = set()
    for i in range(0, 401, 50):
        at = int(np.flatnonzero(ids == i)[0]) if i < 400 else 400
        s = q @ q[at]
        best = sorted((-int(x), int(k)) for x, k in zip(s, ids) if k != ids[at])[:5]
        want |= {(int(ids[at]), n + 1, k, -x) for n, (x, k) in enumerate(best)}
    old = topk.ROWS, topk.QUERIES
    try:
        topk.ROWS, topk.QUERIES = 90, 4
        got = {tuple(r) for r in topk.top(df, lambda c: c % 50 == 0).collect()}
    finally:
        topk.ROWS, topk.QUERIES = old
    assert got == want
    assert topk.top(df.limit(0), lambda c: c % 50 == 0).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(41)
    v = rng.normal(0, 1, (120, 3)) * 10.0 ** rng.integers(0, 9, (120, 3))
    v[7], v[8] = [1e30, -1e30, 0.5], [-3e20, 1, 1]
    rows = [(i, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)] + [(500, [], 1), (550, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    whole = {i: [math.floor(256 * x) for x in r] for i, r, _ in rows}
    want = set()
    for i in (0, 50, 100, 500, 550):
        s = sorted((-sum(a * b for a, b in zip(whole[i], x)), k) for k, x in whole.items() if k != i and len(x) == len(whole[i]))[:5]
        want |= {(i, n + 1, k, max(-(2**63), min(2**63 - 1, -x))) for n, (x, k) in enumerate(s)}
    assert {tuple(r) for r in topk.top(df, lambda c: c % 50 == 0).collect()} == want


def test_digits():
    for v in range(-300, 300):
        d = topk.digits(v)
        assert sum(s << p for p, s in d) == v and all(b - a > 1 for (a, _), (b, _) in zip(d, d[1:]))


# ------------------------------------------------------------------ 5 quality


def test_quality(spark, texts):
    rng = np.random.default_rng(6)
    docs, marks = list(texts), [1] * len(texts)
    for i in range(400):
        body = prose(rng, int(rng.integers(5, 90)))
        junk = i % 4 == 0
        docs.append(" ".join(w + "%%%" for w in body.split()) if junk else body)
        marks.append(int(not junk))
    d = make(spark, docs)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, quality int")
    model = quality.train(d, labels, lambda c: crc_rest(c, 5) != 0)
    got = {r.doc_id: r.score for r in quality.scored(d, model, ["doc_id"]).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(len(texts), len(docs)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(marks[i]) for i in held]) > 0.95
    one = quality.train(d, labels.filter("quality = 1"), lambda c: crc_rest(c, 5) != 0)
    assert {round(r.score, 6) for r in quality.scored(d, one, ["doc_id"]).collect()} != {0.5}
    none = quality.train(d, labels.limit(0), lambda c: crc_rest(c, 5) != 0)
    assert {r.score for r in quality.scored(d, none, ["doc_id"]).collect()} == {0.5}


def test_features_by_brute_force():
    seen = np.zeros(quality.DIM, bool)
    text = b"abcab"
    two = {256 + text[i] * 256 + text[i + 1] for i in range(4)}
    got = set(quality.features(np.frombuffer(text, np.uint8), seen).tolist())
    assert {*text} | two <= got and len(got) == 3 + 3 + 3 and not seen.any()


# ----------------------------------------------------------------- 6 sharding


def test_sharding(spark, texts):
    rng = np.random.default_rng(8)
    more = texts + [prose(rng, int(n)) for n in rng.integers(1, 300, 900)] + ["a hot text of many copies " * 4] * 500
    got = sharding.shard(make(spark, more)).collect()
    assert len(got) == len(more)
    load = Counter()
    slots = defaultdict(list)
    for r in got:
        raw = (more[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r.size for r in got)
    rest = [load[s] for s in range(40) if load[s] < longest]
    assert max(rest) - min(rest) < 0.05 * np.mean(rest)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(make(spark, more).repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    assert sharding.shard(make(spark, more).limit(0)).count() == 0


# ------------------------------------------------------------------ 7 packing


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = texts + ["two  spaces", " lead", "trail ", "tab\t x\n\ny", "<|endoftext|> don't we'll 12 3.5", "x y   z"]
    got = packing.pack(make(spark, more).repartition(3), with_ids=True).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(more)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(x)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, x in sequences.items():
        at = 0
        for start, n in sorted(x):
            assert start == at
            at += n
        assert at == 1024 or s == len(sequences) - 1
    assert packing.pack(make(spark, more).limit(0)).count() == 0


def test_encoder_agrees_with_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    rng = np.random.default_rng(31)
    signs = list("aZé日'.,!12 \t\n\r\x0b\x0c\x00\x1c\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff") + ["'s", "'ll", "  ", "<|endoftext|>", " the", "\n\n"]
    for _ in range(6000):
        text = "".join(rng.choice(signs, int(rng.integers(0, 12))))
        assert np.frombuffer(encode(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    letters = list("etaoinshrdluäöüßéèçñ") + ["the", "ing", "tion", "sch", "'", "-", "7", "\n", " ", "…", "“"]
    for _ in range(6000):  # words that the vocabulary has to merge
        text = " ".join("".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(3))
        assert np.frombuffer(encode(text), "<u2").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_keeps_columns_of_any_name(spark):
    d = make(spark, ["a b", None]).select("doc_id", "text", F.lit(1).alias("n"), F.lit("p").alias("part"), F.lit(2).alias("at"), F.lit(3).alias("ids"), F.lit(4).alias("start"))
    got = packing.pack(d, keep=["doc_id", "n", "part", "at", "ids", "start"]).collect()
    assert sorted((r.doc_id, r.n, r.part, r["at"], r.start) for r in got) == [(0, 1, "p", 2, 0), (1, 1, "p", 2, 0)] and "ids" not in got[0]


# ------------------------------------------------------------------ 8 repeats


def brute_repeats(texts, least=repeats.LEAST):
    """Words of each text that lie in a run of `least` that another text holds."""
    holders = defaultdict(set)
    split = {i: tokens(t) for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - least + 1):
            holders[tuple(w[k : k + least])].add(i)
    out = {}
    for i, w in split.items():
        mark = np.zeros(len(w), bool)
        for k in range(len(w) - least + 1):
            if len(holders[tuple(w[k : k + least])]) > 1:
                mark[k : k + least] = True
        out[i] = mark
    return out


def repeated_texts():
    rng = np.random.default_rng(9)
    a, b, c = prose(rng, 50), prose(rng, 73), prose(rng, 300)
    out = [prose(rng, 200) for _ in range(30)]
    for i in range(12):
        out.append(f"{prose(rng, int(rng.integers(0, 60)))} {a} {prose(rng, int(rng.integers(0, 60)))}")
    for i in range(4):
        out.append(f"{prose(rng, 10)} {b}\n{prose(rng, 5)} {c} {a}")
    out += [c, c, " ".join(c.split()[100:260]), " ".join(a.split()[:49]), None, "", "of the " * 200, "of the " * 120, "x"]
    return out


def test_repeats(spark):
    texts = repeated_texts()
    want = brute_repeats({i: t for i, t in enumerate(texts)})
    found = {i: np.zeros(len(m), bool) for i, m in want.items()}
    for r in repeats.passages(make(spark, texts)).filter("NOT cut").collect():
        found[r.id][r.start : r.start + r.n_words] = True
        assert r.other_id != r.id
    for i in want:
        if i not in (51, 52):  # a pattern of two words over and over: whole runs count
            assert (want[i] == found[i]).all(), i


def test_repeats_stay_once(spark):
    texts = repeated_texts()
    left = {r.doc_id: r for r in repeats.without_repeats(make(spark, texts)).collect()}
    # nothing is lost: every run of words still stands somewhere
    held = {tuple(w[k : k + 10]) for r in left.values() for w in [tokens(r.text)] for k in range(len(w) - 9)}
    for t in texts[:46]:
        w = tokens(t)
        lost = sum(tuple(w[k : k + 10]) not in held for k in range(len(w) - 9))
        assert lost <= 40  # runs over the edge of a cut
    again = brute_repeats({i: r.text for i, r in left.items()})
    assert sum(m.sum() for m in again.values()) <= 100
    assert left[0].text == texts[0] and left[0].n_chars == len(texts[0])
    assert repeats.without_repeats(make(spark, texts)).columns == make(spark, ["a"]).columns
    assert repeats.without_repeats(make(spark, texts).limit(0)).count() == 0


def test_repeats_cut_beside_larger_ids(spark):
    rng = np.random.default_rng(11)
    a = prose(rng, 50).split()
    # the earliest documents hold all runs of KEY words, but under LEAST words
    texts = [f"{prose(rng, 30)} {' '.join(some)} {prose(rng, 30)}" for some in (a[:49], a[1:])]
    texts += [f"{prose(rng, 30)} {' '.join(a)} {prose(rng, 30)}" for _ in range(40)]
    left = {r.doc_id: r.text for r in repeats.without_repeats(make(spark, texts)).collect()}
    assert sum(m.sum() for m in brute_repeats(left).values()) == 0
    assert all(left[i] == texts[i] for i in range(3))


def test_repeats_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(23)
    a, b, c = prose(rng, 90), prose(rng, 80), prose(rng, 60)
    rows = [(1, a), (5, b), (5, a), (9, c), (7, "one two"), (None, f"{prose(rng, 20)} {c}"), (None, None), (3, None), (5, f"{c} {prose(rng, 30)}")]
    left = sorted(((r.doc_id, r.text) for r in repeats.without_repeats(identified(spark, rows)).collect()), key=str)
    # the least id that holds a passage keeps it; rows of which nothing is left go
    want = [(1, a), (5, b), (7, "one two"), (None, " ".join(rows[5][1].split()[:20])), (None, None), (3, None), rows[8]]
    assert left == sorted(want, key=str)
    found = {(r.id, r.other_id) for r in repeats.passages(identified(spark, rows)).filter("NOT cut").collect()}
    assert found == {(1, 5), (5, 1), (9, None), (9, 5), (None, 5), (5, None)} - {(9, None)} or (9, 5) in found
    same = [(2, f"{prose(rng, 20)} {c}"), (2, f"{c} {prose(rng, 20)}")]
    held = [r.text for r in repeats.without_repeats(identified(spark, same)).collect() if c in r.text]
    assert len(held) == 1


# ------------------------------------------------------------------ 9 scoring


def test_scoring(spark, texts):
    rng = np.random.default_rng(10)
    more = list(texts)
    for n in rng.integers(1, 200, 300):  # words that depend on the word before
        at, some = int(rng.integers(0, 40)), []
        for _ in range(int(n)):
            at = int(at * 7 + rng.integers(0, 3)) % len(WORDS)
            some.append(WORDS[at] if rng.random() < 0.95 else WORDS[at] + prose(rng, 1))
        more.append(" ".join(some))
    d = make(spark, more)
    trained = crc_rest(F.col("doc_id"), 5) != 1
    old = scoring.HOT, scoring.CONTEXTS, scoring.GATHER, scoring.ASKED
    try:
        scoring.HOT, scoring.CONTEXTS, scoring.GATHER, scoring.ASKED = 40, 10, 24000, 500  # most is asked for, in several rows
        got = {r.doc_id: r for r in scoring.score(d, trained).collect()}
        model, _ = scoring.train(d.filter(trained).select("text"))
    finally:
        scoring.HOT, scoring.CONTEXTS, scoring.GATHER, scoring.ASKED = old
    split = {i: [*tokens(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in enumerate(more)}
    count, follow = Counter(), Counter()
    for i, ws in split.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(ws)
            follow.update(zip([None, *ws], ws))
    n, v, once = sum(count.values()), len(count), sum(c == 1 for c in count.values())

    @functools.cache
    def alone(w):  # probability in the empty context
        share = (count[w] or once + 1) / (n + once + 1)
        spelled = 0.0
        if w is not None and count[w]:
            data = np.frombuffer(w.encode(), np.uint8)
            spelled = 10.0 ** model.automaton().read(automaton.stream(data, np.array([0, len(data)]))[0]).astype(float).sum()
        return scoring.SHARES * share + (1 - scoring.SHARES) * spelled

    ours = base = 0.0
    for i, ws in split.items():
        r = got[i]
        want = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        walked = sum(math.log10((follow[p, w] + scoring.PRIOR * alone(w)) / (count[p] + scoring.PRIOR)) for p, w in zip([None, *ws], ws))
        assert r.score == pytest.approx(walked, rel=1e-5)
        if zlib.crc32(str(i).encode()) % 5 == 1:
            ours, base = ours + r.score, base + want
    assert len(got) == len(more) and ours > base


def test_scoring_without_training(spark, texts):
    got = scoring.score(make(spark, texts), F.lit(False)).collect()
    assert len(got) == len(texts) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert scoring.score(make(spark, texts).limit(0), F.lit(True)).count() == 0


def test_spellings_beyond_the_tables(spark, texts):
    """Words are spelled by all contexts, however few states are laid out as tables."""
    rng = np.random.default_rng(12)
    more = [*texts, *[prose(rng, 40) for _ in range(20)], "a\x00b \x00\x00 \x00b", " ".join("x" * int(n) for n in rng.integers(1, 30, 20))]
    d = make(spark, more)
    trained = crc_rest(F.col("doc_id"), 5) != 1
    old = scoring.HOT, scoring.STATES, scoring.GATHER
    try:
        scoring.HOT, scoring.STATES, scoring.GATHER = 20, 15, 300  # both kinds of words need states beyond
        model, table = scoring.train(d.filter(trained).select("text"))
        got = {r.doc_id: r.score for r in scoring.score(d, trained).collect()}
    finally:
        scoring.HOT, scoring.STATES, scoring.GATHER = old
    assert {r.doc_id: r.score for r in scoring.score(d, trained).collect()} == pytest.approx(got, rel=1e-6)
    assert 0 < sum(model.automaton().depth > 1) <= 15

    count = Counter()
    for i, t in enumerate(more):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(re.sub("[A-Z]", lambda m: m[0].lower(), w).encode() for w in tokens(t))
    arcs = defaultdict(Counter)
    for w, times in count.items():
        whole = b" " + w + b" "
        for at in range(1, len(whole)):
            for n in range(min(at, automaton.ORDER - 1) + 1):
                arcs[whole[at - n : at]][whole[at]] += times

    def byte(context, b):
        below = byte(context[1:], b) if context else 1 / automaton.SYMBOLS
        of = arcs[context]
        return (of[b] + len(of) * below) / (of.total() + len(of))

    def spelled(w):
        whole = b" " + w + b" "
        return sum(math.log10(byte(whole[max(0, at - automaton.ORDER + 1) : at], whole[at])) for at in range(1, len(whole)))

    rows = table.collect()
    told = {k: (c, s) for r in rows for k, c, s in zip(*(np.frombuffer(x, t).tolist() for x, t in ((r["keys"], np.uint64), (r.counts, np.int64), (r.spelled, np.float64))))}
    assert len(told) == len(count) + 1 and told.pop(int(scoring.END[0]))[1] == -math.inf
    for w, times in count.items():
        key = scoring.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        assert told[int(key)] == (times, pytest.approx(spelled(w), rel=1e-5))


def test_automaton_is_a_distribution():
    rng = np.random.default_rng(11)
    raw = (prose(rng, 3000) + " ").encode()
    data = np.frombuffer(raw, np.uint8)
    text, starts = automaton.stream(data, np.array([0, len(data)]))
    assert text.tobytes() == b" ".join(raw.lower().split()) + b" "
    codes, counts = automaton.grams(text, starts)
    arcs = {n: automaton.shorter(codes, counts, n) for n in range(automaton.ORDER)}
    a = automaton.Automaton(arcs)
    p = 10.0 ** a.logp.reshape(-1, a.width).astype(float)
    p[:, 0] *= automaton.SYMBOLS - a.width + 1
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    state, each = a.start * a.width, a.read(text)
    for i in range(2000):  # lanes agree with one walk
        at = state + a.column[text[i]]
        assert a.logp[at] == each[i]
        state = a.follow[at]


# --------------------------------------------------------------- 10 near copies


def shingle_counts(text):
    w = tokens(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in {*a, *b}) for d in a.keys() & b.keys())


def near_texts():
    rng = np.random.default_rng(12)
    out = [prose(rng, int(n)) for n in rng.integers(20, 200, 40)]
    for base in out[:8]:
        for _ in range(6):
            w = base.split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = "changed"
            out.append(" ".join(w))
    chain = prose(rng, 150).split()
    for i in range(25):  # neighbours are alike, ends are not
        w = list(chain)
        for k in range(i):
            w[5 * k] = f"new{k}"
        out.append(" ".join(w))
    return out + [None, None, "", "", "one", "one", "One", "two words", "same line\n" * 60, "same line\n" * 61]


def test_near_copies(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in neardup.classes(make(spark, texts)).collect()}
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    counts = [shingle_counts(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            alike = texts[i] is not None and texts[i] == texts[j] or counts[i].keys() & counts[j].keys() and probability_jaccard(counts[i], counts[j]) >= 0.8
            if alike:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert got == {i: top(i) for i in range(len(texts))}
    left = neardup.deduplicated(make(spark, texts + texts[:3], ids=[*range(len(texts)), 0, 1, 2]))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(got.values())) and left.columns == make(spark, ["a"]).columns
    assert neardup.classes(make(spark, texts).limit(0)).count() == 0


def identified(spark, rows):
    """Documents of (id, text) as given."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def test_near_copies_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(21)
    a, b, c, d = (prose(rng, 70) for _ in range(4))
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in neardup.deduplicated(identified(spark, rows)).collect()), key=str)
    assert kept([(1, a), (5, b), (5, a), (9, c)]) == sorted([(1, a), (5, b), (9, c)], key=str)
    assert kept([(None, a), (None, a), (3, a), (None, b), (None, b), (None, None), (None, None), (4, None), (7, d + " x"), (7, d)]) in (
        sorted([(3, a), (None, b), (None, None), (None, None), (4, None), (7, d)], key=str),
        sorted([(3, a), (None, b), (None, None), (None, None), (4, None), (7, d + " x")], key=str),
    )
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(identified(spark, [(None, a), (3, a), (None, b), (None, None), (4, None)])).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (None, None), (None, None), (4, 4)], key=str)


def test_components(spark):
    from loamgrid.llm.components import components

    rng = np.random.default_rng(22)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 60)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (70, 2))]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert len({(got[x], up[x]) for x in nodes}) == len({got[x] for x in nodes}) == len({up[x] for x in nodes})
    assert not components(spark.createDataFrame([], "a long, b long")).count()


def test_similarity_by_brute_force():
    rng = np.random.default_rng(13)
    for _ in range(200):
        a, b = (Counter({int(k): int(c) for k, c in zip(rng.choice(30, 12, replace=False), rng.integers(1, 5, 12))}) for _ in range(2))
        key = lambda c: (np.array(sorted(c)), np.array([c[k] for k in sorted(c)]))
        assert neardup.similarity(*key(a), *key(b)) == pytest.approx(probability_jaccard(a, b))


def test_registers_estimate_similarity():
    rng = np.random.default_rng(14)
    a, b = prose(rng, 600), None
    w = a.split()
    for i in rng.choice(600, 12, replace=False):
        w[i] = "zz"
    b = " ".join(w)
    raw = (a + b).encode()
    at = np.array([0, len(a.encode()), len(raw)])
    row, key, count = neardup.shingles(np.frombuffer(raw, np.uint8), at)
    s = neardup.signatures(row, key, count, 2)
    want = probability_jaccard(shingle_counts(a), shingle_counts(b))
    assert abs((s[0] == s[1]).mean() - want) < 0.15


# ------------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(15)
    shared = prose(rng, 60)
    docs = [prose(rng, 80) for _ in range(120)] + [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(6)]
    docs += [docs[0], docs[1] + " tail"] + [f"{prose(rng, 30)} you idiot {prose(rng, 30)}" for _ in range(30)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(docs)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(128 <= i < 158)) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = now
    kept = {r.doc_id for r in seen["toxicity"].collect()}
    assert not kept & set(range(128, 158)) and len(kept) >= len(docs) - 32
    assert {r.doc_id for r in seen["near copies"].collect()} == kept - {126, 127}
    holders = [r.doc_id for r in seen["repeated passages"].collect() if r.text and shared in r.text]
    assert holders == [120] and seen["repeated passages"].columns == d.columns
    assert seen["mixing"].columns == d.columns
    pieces = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 1024 for r in pieces if r.sequence_id < len(pieces) - 1)
    assert pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()
