"""Every training-data operator against a plain version, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from airledger.llm import archive, common, decontaminate, language, packing, pii, quality, secrets, simhash, spotsigs, toxicity
from airledger.llm.components import connected_components

#: Columns beside those of documents have the names of results and of what operators add on their way.
EXTRA = "fp spans component_id score predicted lang_pred votes posterior ids signatures base starts __h __row place".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "src0", len(t or ""), *("x" * len(EXTRA))) for i, t, lang in rows], DOCS)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "is", *("".join(r.choice("abcdeé") for _ in range(r.randint(3, 8))) for _ in range(80))]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 120))), "en") for i in range(n)]
    rows += [(n, rows[0][1], "en"), (n + 1, rows[1][1] + " tail", "en"), (n + 2, None, None), (n + 3, "", None), (n + 4, "A.", "en"), (n + 5, "  \n\t ", "en"), (n + 6, "word " * 30_000, "en")]
    return rows


EMPTY: list = []


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(120)] + [(7, 7), (3, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.root for x in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus()
    fps = {i: plain_simhash(t) for i, t, _ in rows}
    got = {x.doc_id: (x.fp % 2**64, x.component_id) for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert {i: g[0] for i, g in got.items()} == fps
    component = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    component[b] = min(component[a], component[b])
    assert {i: g[1] for i, g in got.items()} == component
    assert sorted(x.doc_id for x in simhash.keep_one(frame(spark, rows)).collect()) == sorted(set(component.values()))


def test_simhash_edges_equal_brute_force(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = list({f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for f in base for _ in range(8)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.ball_edges(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((e.u ^ e.v) % 2**64).bit_count() <= 2 for e in edges.collect())
    got = {x.node: x.root for x in connected_components(edges).collect()}
    root = {f: f for f in signed}
    for _ in range(10):
        for a in signed:
            for b in signed:
                if ((a ^ b) % 2**64).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {f: got.get(f, f) for f in signed} == root


def test_simhash_odd_rows(spark):
    rows = [(1, "a b c d", None), (1, "a b c d", None), (None, "a b c d", None), (None, None, None), (5, "a b c d", None), (6, "other words are here", None), (6, "quite different text now", None)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 7 and {x.component_id for x in got if x.doc_id in (1, 5)} == {1}
    kept = [x.doc_id for x in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == [1, 6, None, None]
    assert simhash.near_duplicates(frame(spark, EMPTY)).count() == 0 and simhash.keep_one(frame(spark, EMPTY)).columns == frame(spark, EMPTY).columns


def plain_contamination(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(13, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(name) if name is not None else "null")
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [1 << 27, 1 << 8])
def test_decontamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", min(bits, 1 << 16))
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)  # a full filter lets all through
    rows = corpus(3)
    r = random.Random(2)
    items = [(k, " ".join(rows[k][1].split()[a : a + n])) for k in range(40) for a, n in [(r.randint(0, 30), r.choice([3, 9, 12, 13, 14, 40]))]]
    items += [(90, ""), (91, None), (3, items[3][1].upper() + "!"), (None, "zzz yyy"), (92, "word " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1)).withColumn("name", F.lit("x"))
    docs = frame(spark, [*rows, rows[5]])
    found = decontaminate.judged(decontaminate.contamination(docs, bench)).collect()
    assert len(found) == len(rows) + 1
    for x in found:
        text = next(t for i, t, _ in rows if i == x.doc_id)
        assert (x.n_words, x.n_hit, list(x["items"])) == plain_contamination(text, items), x.doc_id
        assert sum(s.end - s.start for s in x.spans) == x.n_hit and all(a.end < b.start for a, b in zip(x.spans, x.spans[1:], strict=False))
        assert x.contaminated == (x.n_hit > 0 and 20 * x.n_hit >= x.n_words)
    kept = sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect())
    assert kept == sorted(x.doc_id for x in found if not x.contaminated)


def test_decontamination_of_windows_that_many_items_share(spark):
    passage = lambda tag: " ".join(f"{tag}{i}" for i in range(20))
    items = [(i, passage("a")) for i in range(40)] + [(i, passage("a") + " " + passage("b")) for i in range(40, 60)]
    items += [(60 + i, passage("c") + f" own{i} " + passage("d")) for i in range(20)] + [(3, passage("e")), (3, passage("e")), (3, passage("a"))]
    texts = [passage("a")] * 30 + [passage("b")] * 30 + [passage("a") + " x " + passage("c"), passage("d"), passage("e"), "nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = lambda *ids: sorted(str(i) for own in ids for i in own)
    a, b, c = names(range(60)), names(range(40, 60)), names(range(60, 80))
    want = [a] * 30 + [b] * 30 + [sorted(a + c), c, ["3"], [], []]
    got = {x.doc_id: list(x["items"]) for x in decontaminate.contamination(docs, bench).collect()}
    assert got == dict(enumerate(want))


def test_decontamination_of_one_word_over_and_over(spark):
    bench = spark.createDataFrame([(1, "word " * 1000), (2, "word " * 1000 + "end")], "item_id long, text string")
    x = decontaminate.judged(decontaminate.contamination(frame(spark, [(1, "word " * 8000, None)]), bench)).first()
    assert (x.n_words, x.n_hit, list(x["items"])) == (8000, 8000, ["1", "2"])


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(frame(spark, corpus(3)), none).count() == len(corpus(3))
    assert decontaminate.contamination(frame(spark, EMPTY), none).count() == 0


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 5000).astype(np.uint64)
    chosen = decontaminate.winnow(h, 9)
    assert np.diff(chosen).max() <= 9 and len(chosen) < 0.3 * len(h)


def languages():
    r = random.Random(9)
    syllables = {"aa": ["ba", "do", "mi", "lu"], "bb": ["ste", "krö", "zin", "ach"], "cc": ["ño", "rra", "que", "lle"]}
    make = lambda lang: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 60)))
    return [(i, make(lang := list(syllables)[i % 3]), lang) for i in range(90)]


def test_language(spark):
    rows = [*languages(), (200, None, "aa"), (201, "12 34 !!", "aa"), (202, "", None), (203, "ba" * 20_000, "aa"), (204, "BADO MILU", None)]
    model = language.learn(frame(spark, rows), common.remainder("doc_id", 4) != 2)
    got = {x.doc_id: x for x in language.identify(frame(spark, rows), model).collect()}
    held = [i for i, _, _ in rows[:90] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert [got[i].lang_pred for i in (200, 201, 202, 203, 204)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = language.keep_identified(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 3
    nothing = language.learn(frame(spark, EMPTY))
    assert {x.lang_pred for x in language.identify(frame(spark, rows[:3]), nothing).collect()} == {"und"}


def test_cross_parsing_equals_greedy():
    text = "banana bandana cabanañ"
    model = language.train({"x": [text], "y": ["zzz zyx zz zyz yxy zxx"]}, 100)
    symbols = lambda t: model.symbols[language.to_bytes(language.to_letters(t, model.letters))]
    for t in ("bananaband", "nanabanx", "ñ", "q", "cabana  banana", "BANDANA, cabaná" * 300):
        s = symbols(t).tolist()
        known = "".join(map(chr, symbols(text)[: model.length]))
        at = count = 0
        while at < len(s):
            n = 1
            while at + n < len(s) and "".join(map(chr, s[at : at + n + 1])) in known:
                n += 1
            at, count = at + n, count + 1
        # Singly, and side by side with so many others that texts are matched in step.
        if all(chr(c) in known for c in s):
            assert language.phrases([np.array(s, np.uint8)], model)[0][0] == count, t
            assert language.phrases([np.array(s, np.uint8)] * 50, model)[:, 0].tolist() == [count] * 50


def test_a_small_language_changes_no_prediction(spark):
    rows = [*languages(), *((1000 + i, None, "aa") for i in range(300))]
    predicted = lambda more: {x.doc_id: x.lang_pred for x in language.identify(frame(spark, rows), language.learn(frame(spark, [*rows, *more]))).collect()}
    before = predicted([])
    assert all(before[i] == lang for i, _, lang in rows[:90])
    assert predicted([(500, "a b", "xx"), (501, "hola mundo", "yy"), (502, "12 34", "zz")]) == before


def test_no_letters_are_merged():
    han, kana = "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0x5000, 0x5000 + 400)))
    model = language.train({"x": [han * 5], "y": [kana * 5]})
    got = language._kernel(model)([han[50:90], kana[100:140], han[390:] + han[:20]])
    assert got["lang_pred"] == ["x", "y", "x"]


def test_a_text_of_a_million_letters():
    import time

    model = language.train({"x": ["banana bandana " * 100], "y": ["zzz zyx zy " * 100]})
    began = time.time()
    assert language._kernel(model)(["ban" * 333_333, "zyx zz"])["lang_pred"] == ["x", "y"] and time.time() - began < 20


def test_archive(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://d/ x\r\n", ""), (5, "u", "long " * 40_000), (6, "u", "one"), (None, "n", "one"), (None, "n", "only null"), (7, "r", "twice"), (7, "r", "twice")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, sha256 string, row int")
    path = archive.write_archive(df, f"{tmp_path}/w")
    got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in archive.read_index(spark, path).collect()), key=str)
    import base64

    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        ids = [p for p, _, o in pages if (o or "").encode() == raw and p is not None]
        top = max(ids) if ids else None
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == sorted(want, key=str)
    assert archive.stored_payloads(spark, path).count() == len({h or "" for _, _, h in pages})
    records = archive.read_records(spark, path).where("page_id = 2").first()
    head, _, body = bytes(records.record).partition(b"\r\n\r\n")
    http, _, payload = body.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and payload == "<p>é</p>".encode() + b"\r\n\r\n"
    assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(body) - 4}".encode() in head.split(b"\r\n")[-1]
    ids = [re.search(rb"WARC-Record-ID: (<[^>]+>)", bytes(x.record))[1] for x in archive.read_records(spark, path).collect()]
    assert len(set(ids)) == len(pages)
    revisit = bytes(archive.read_records(spark, path).where("page_id = 1").first().record)
    assert b"WARC-Refers-To: <urn:airledger:page:2:" in revisit and revisit.endswith(b"\r\n\r\n\r\n\r\n")
    small = archive.read_index(spark, archive.write_archive(df, f"{tmp_path}/m", min_bytes=5)).where("page_id IN (1, 3, 4)")
    assert {x.page_id: x.record_type for x in small.collect()} == {1: "revisit", 3: "response", 4: "response"}
    assert archive.read_index(spark, archive.write_archive(df.where("false"), f"{tmp_path}/e")).count() == 0


def test_archive_detects_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    path = archive.write_archive(df, f"{tmp_path}/w")
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    bad.write.parquet(f"{tmp_path}/x/payloads")
    with pytest.raises(Exception, match="match its digest"):
        archive.stored_payloads(spark, f"{tmp_path}/x").collect()
    whole = archive.read_records(spark, path)
    for old, new, why in (("text\r\n\r\n", "tex\r\n\r\n", "as long"), ("text\r\n\r\n", "tExt\r\n\r\n", "digest")):
        broken = whole.withColumn("record", F.replace(F.col("record").cast("string"), F.lit(old), F.lit(new)).cast("binary"))
        with pytest.raises(Exception, match=why):
            archive.parsed(broken).collect()


def test_toxicity(spark):
    r = random.Random(6)
    neutral = ["river", "women", "muslim", "gay", *("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300))]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [r.choice(neutral) for _ in range(40)] + (["idiot", "scum"] if toxic else [])
        if toxic and r.random() < 0.7:
            w += ["gay"] * 3
        r.shuffle(w)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None), (901, "", None), (902, "river " * 20_000, None)]
    marks = spark.createDataFrame([*labels, (5, 1, 0), (None, 1, 1), (950, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame(spark, rows), marks, common.remainder("doc_id", 5) != 0)
    got = {x.doc_id: x for x in toxicity.score(frame(spark, rows), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert [got[i].predicted for i in (900, 901, 902)] == [0, 0, 0]
    assert toxicity.score(frame(spark, EMPTY), model).count() == 0
    nothing = toxicity.learn(frame(spark, rows), marks.where("false"))
    assert toxicity.score(frame(spark, rows[:2]), nothing).count() == 2


def test_counterfactuals_are_never_lacking(spark):
    for text, gone, come in (("The women and men walk.", 1, 1), ("Une femme parle.", 1, 1), ("No group at all here.", 0, 1), ("old and black and white stones", 0, 1)):
        made = toxicity.counterfactuals(text.encode())
        assert made and all(len(a) <= 1 and len(b) <= 1 for a, b in made), text
        assert {len(a) for a, b in made} & {gone} and any(a + b for a, b in made), text
    assert toxicity.identity_places([b"old", b"stones"]) == [] and toxicity.identity_places([b"old", b"people"]) == [0]
    assert toxicity.counterfactuals(b"") == [] == toxicity.counterfactuals(b"?!")
    rows = [(i, f"stone river {'idiot' if i % 2 else 'walks'} w{i % 7}", "en") for i in range(60)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(frame(spark, rows), marks).pairs >= 60


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    r = random.Random(3)
    group = ["muslim", "gay", "women", "immigrants"]
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "walks", "under", *(f"w{i}" for i in range(60))]
    texts = []
    for i in range(600):  # most toxic texts speak of a group, few others do
        bad = i % 3 == 0
        own = [r.choice(words) for _ in range(12)] + ([r.choice(group)] if r.random() < (0.8 if bad else 0.03) else [])
        texts.append((" ".join([*own, *(["scum"] if bad and r.random() < 0.7 else [])]).encode(), int(bad)))
    neutral = [" ".join([*(r.choice(words) for _ in range(12)), g]).encode() for g in group for _ in range(50)]

    def fitted(pairing):
        examples = toxicity.Examples()
        for text, bad in texts:
            examples.add(text, bad)
        return toxicity.fit(examples, pairing=pairing)

    def score(model, text):
        return model.bias + sum(model.weights[toxicity.word_features(w)].sum() for w in set(decontaminate.words(text)))

    plain, paired = fitted(0.0), fitted(20.0)
    wrong = lambda m: sum(score(m, t) >= 0 for t in neutral)
    assert plain.pairs == paired.pairs >= len(texts)
    assert wrong(plain) > 50 and wrong(paired) < 0.2 * wrong(plain)
    found = lambda m: sum(score(m, t) >= 0 for t, bad in texts if bad and b"scum" in t)
    assert found(paired) >= 0.9 * found(plain)


def test_toxicity_scores_equal_a_plain_version(spark):
    rows = [(1, "An Idiot, an idiot! walks.", None), (1, "An Idiot, an idiot! walks.", None), (2, None, None), (3, "walks", None)]
    weights = np.zeros(toxicity.BUCKETS)
    for w, x in (("idiot", 2.0), ("<idio", 0.5), ("walks", -1.0), ("<walk", 0.25), ("an", 0.1)):
        weights[zlib.crc32(w.encode()) % toxicity.BUCKETS] = x
    got = sorted((x.doc_id, round(x.score, 6), x.predicted) for x in toxicity.score(frame(spark, rows), toxicity.Classifier(weights, -1.5)).collect())
    sigmoid = lambda z: round(1 / (1 + np.exp(-z)), 6)
    one = sigmoid(-1.5 + 2.0 + 0.5 - 1.0 + 0.25 + 0.1)
    assert got == [(1, one, int(one >= 0.5)), (1, one, int(one >= 0.5)), (2, sigmoid(-1.5), 0), (3, sigmoid(-1.5 - 1.0 + 0.25), 0)]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    digits = lambda m: sum(c.isdigit() for c in m[0])
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 14 <= digits(m) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit())), "phone": lambda m: 10 <= digits(m) <= 15}
    kinds = list(PII)
    return sorted([(m.start(), m.end(), k) for k, p in PII.items() for m in re.finditer(p, text) if ok[k](m)], key=lambda s: (s[0], kinds.index(s[2])))


def test_pii_patterns():
    r = random.Random(11)
    pieces = ["a.b@c.de", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (042) 555-7845", "+", "@", ".", " ", "é", "007", "0000000000000000", "ab", "-", "+12", "(", "@@", "a@b.c@d.e", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_pii(spark):
    r = random.Random(2)
    say = lambda: r.choice(["mail bob.27@mail6.example.com now", "from 10.20.30.40 to", "card 4111111111111111 used", "call +1 (042) 555-7845 today", "version 3. of it", "see 2.0 and 4.0"])
    rows = [(i, f"some words {say()} and {say()} here", "en") for i in range(200)]
    rows += [(300, None, None), (301, "", None), (302, "1 " * 30_000, None), (303, "card 4111111111111112 and 4111111111111111 and 4111111111111112 used", None), (304, "no data at all", None)]
    field = pii.learn(frame(spark, rows))
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, rows), field).collect()}
    for i, t, _ in rows:
        base = [(s.start, s.end, s.kind) for s in got[i].base]
        every = [(s.start, s.end, s.kind) for s in got[i].spans]
        assert base == plain_pii(t or "") and set(base) <= set(every) and every == sorted(every, key=lambda s: (s[0], pii.KINDS.index(s[2])))
    assert [s.start for s in got[303].spans] == [26] and not got[304].spans  # numbers with a wrong check digit are none
    masked = pii.redact(frame(spark, rows), field)
    assert masked.columns == frame(spark, rows).columns
    by = {x.doc_id: x for x in masked.collect()}
    assert by[303].text == "card 4111111111111112 and [CARD] and 4111111111111112 used" and by[303].n_chars == len(by[303].text)
    assert by[304].text == "no data at all" and by[300].text is None and by[301].text == ""
    assert pii.find_pii(frame(spark, EMPTY), pii.learn(frame(spark, EMPTY))).count() == 0


def pii_texts(seed=7, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card():
        while not pii.luhn(c := "4" + number(15)):
            pass
        return c

    kinds = [lambda: f"{word()}.{number(2)}@{word()}{number(1)}.example.com", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({number(3)}) 555-{number(4)}"]
    return [" ".join(r.choice(kinds)() if r.random() < 0.05 else word() for _ in range(60)) for _ in range(n)]


def test_skip_edges_carry_labels_to_distant_similar_tokens(spark):
    field = pii.learn(frame(spark, [(i, t, "en") for i, t in enumerate(pii_texts())]))
    assert field.skip.diagonal()[1:].min() > 1 > 0 > field.skip[0, 1:].max()
    for text, kind, piece in (
        ("write to bob.27@mail6.example.com today and ask abc def for bob.27 again", "email", "bob.27"),
        ("call +1 (042) 555-7845 or then at night 042-555-7845 they said", "phone", "042-555-7845"),
        ("card 4111111111111111 was read as 4111.1111.1111.1111 by them", "card", "4111.1111.1111.1111"),
        ("from 10.20.30.40 it came and went to 10-20-30-40 in the end", "ip", "10-20-30-40"),
    ):
        a = text.rindex(piece)
        with_edges, without = pii.find(text, field), pii.find(text, field.without_skips())
        assert (a, a + len(piece), kind) in with_edges[1] and with_edges[1] != without[1] == without[0], text
        alone = text.replace(text[with_edges[0][0][0] : with_edges[0][0][1]], "it")
        assert pii.find(alone, field)[1] == [], alone
    decoys = "order 9000426309966109 of 2019, version 3. and 4.0, 2019 again, 9000426309966109 again"
    assert pii.find(decoys, field) == ([], [])
    docs = frame(spark, [(1, "ask bob.27@mail6.example.com or abc or bob.27 then", None), (1, None, None)])
    assert sorted(str(x.text) for x in pii.redact(docs, field).collect()) == ["None", "ask [EMAIL] or abc or [EMAIL] then"]


def other_notations(r):
    """(text, kind, piece): findings again in notations that training never makes."""
    word = lambda: "".join(r.choice("mnopqrstuvw") for _ in range(r.randint(2, 7)))
    number = lambda k: r.choice("123456789") + "".join(r.choice("0123456789") for _ in range(k - 1))
    area, own, last = number(2), number(3), number(4)
    phone = f"+49 {area} {own}{last}"
    while not pii.luhn(card := "5" + number(15)):
        pass
    ip = [str(r.randint(10, 255)) for _ in range(4)]
    local, host = f"{word()}.{word()}{number(2)}", f"{word()}.example.org"
    told = r.choice([
        (phone, "phone", r.choice([f"(0{area}) {own}-{last}", f"0{area}/{own}{last}", f"0049.{area}.{own}.{last}", f"0{area} {own} {last}"])),
        (card, "card", r.choice([f"{card[:4]}/{card[4:8]}/{card[8:12]}/{card[12:]}", f"{card[:8]}.{card[8:]}"])),
        (".".join(ip), "ip", " ".join(ip)),
        (f"{local}@{host}", "email", r.choice([f"{local} [at] {host}", f"{local} <AT> {host.replace('.', ' dot ')}", local.replace(".", "_"), local.replace(".", "")])),
    ])
    words = lambda k: " ".join(word() for _ in range(k))
    return f"{words(9)} {told[0]} {words(40)} {told[2]} {words(9)}.", told[1], told[2]


def test_pii_in_notations_that_training_never_makes():
    field, r = pii.fit(pii.joined([e for t in pii_texts(3, 300) if (e := pii.examples_of(t))])), random.Random(17)
    found = {k: [] for k in pii.KINDS}
    for _ in range(400):
        text, kind, piece = other_notations(r)
        a = text.rindex(piece)
        found[kind].append(any(k == kind and s <= a + 1 and e >= a + len(piece) for s, e, k in pii.find(text, field)[1]))
    assert all(sum(v) / len(v) >= 0.9 for v in found.values()), {k: sum(v) / len(v) for k, v in found.items()}


def test_parts_of_findings_are_no_personal_data():
    field, r, wrong = pii.fit(pii.joined([e for t in pii_texts(3, 300) if (e := pii.examples_of(t))])), random.Random(18), 0
    text = "Call +1 202 555 2024 or mail jo.smith24@mail.example.com from 10.20.30.40; in the year 2024 it says that 555 people came in 2024 to 202 Smith Street, 10 at 20 past 30 of 40, card 555 2024, mail or mail.example.com"
    assert [s[2] for s in pii.find(text, field)[1]] == ["phone", "email", "ip"]
    for _ in range(300):
        finding = f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
        parts = finding[1:].split()
        said = " ".join(f"{r.choice(['in', 'of', 'page', 'about'])} {r.choice([*parts, str(r.randint(1900, 2030)), ' '.join(parts[2:])[:6]])} {r.choice(['people', 'items', 'years'])}" for _ in range(8))
        wrong += len(pii.find(f"ring {finding} now. {said}", field)[1]) - 1
    assert wrong == 0


def test_pii_of_very_long_runs():
    import time

    field, began = pii.fit(pii.joined([e for t in pii_texts(3, 100) if (e := pii.examples_of(t))])), time.time()
    for text in ("语" * 1_000_000 + "7", "a" * 1_000_000 + "@", "7" * 1_000_000, "a@" * 500_000, "1." * 500_000):
        pii.find(text, field)
    assert time.time() - began < 60


def test_messages_agree_over_distant_tokens():
    f = pii.empty_field()
    n = len(pii.KINDS) + 1
    g = pii.Graph([(0, 1), (5, 6), (9, 10)], [[1], [2], [3]], [], [(0, 1)], [0, 0, 0])
    f.unary[1, 3], f.unary[2, 3] = 6.0, -0.5
    alone = pii.beliefs(pii.Graph(g.spans, g.features, [], [], g.known), f)
    f.skip = np.eye(n) * 4
    linked = pii.beliefs(g, f)
    assert alone[1, 3] < 0.2 < 0.85 < linked[1, 3] and np.allclose(linked[2], alone[2])


SECRETS = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_secrets(text):
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    kinds = list(SECRETS)
    return sorted([(m.start(), m.end(), k) for k, p in SECRETS.items() for m in re.finditer(p, text) if ok[k](m)], key=lambda s: (s[0], kinds.index(s[2])))


def test_secret_patterns():
    r = random.Random(5)
    pieces = ["token", "ToKen", "api_key", "APIKEY", "secret", "password", '"', "'", " ", "=", ":", "abc123", "deadbeef" * 3, "0" * 23, "AKIA", "ABCDEF0123456789", "é", "K", "\n", "x", "ſecret"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 10)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def secret_texts(n=400, seed=4):
    r = random.Random(seed)
    key = lambda n=40: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice("aeioubcdfgst") for _ in range(r.randint(3, 12)))
    other = lambda: r.choice([word(), word().title(), f"{word()}@mail{r.randint(1, 9)}.example.org", str(r.randint(0, 10**9)), f"{word()}-{word()}", f"{word()}: {word()}", "192.168.17.240"])
    text = lambda: [other() for _ in range(30)]
    return [(i, " ".join([*text(), *([f'token = "{key()}"'] if i % 3 == 0 else []), *text()]), "en") for i in range(n)]


def test_secrets(spark):
    rows = secret_texts()
    hidden = "9F8E7D6C5B4A39281706F5E4D3C2B1A098877665"
    rows += [(400, None, None), (401, "", None), (402, "ab " * 30_000, None), (403, f"see {hidden} there", None), (403, f"see {hidden} there", None), (None, f"see {hidden} there", None)]
    net = secrets.learn(frame(spark, rows))
    assert net.trained and net.figures["findings"] > 100 and net.figures["others"] > 100
    assert net.figures["recall"] >= 0.98 and net.figures["false_positives"] <= 0.02
    found = secrets.find_secrets(frame(spark, rows), net).collect()
    assert len(found) == len(rows)
    got = {x.doc_id: x for x in found}
    for i, t, _ in rows:
        base = [(s.start, s.end, s.kind) for s in got[i].base]
        assert base == plain_secrets(t or "") and set(base) <= {(s.start, s.end, s.kind) for s in got[i].spans}
    assert [(s.start, s.end, s.kind) for s in got[403].spans] == [(4, 4 + len(hidden), "other")]
    extra = [rows[i][1][s.start : s.end] for i in range(400) for s in got[i].spans if s.kind == "other"]
    assert len(extra) < 8, extra
    untrained = secrets.learn(frame(spark, EMPTY))
    assert not untrained.trained and secrets.find_secrets(frame(spark, EMPTY), untrained).count() == 0
    with pytest.raises(ValueError, match="spans"):
        secrets.find_secrets(frame(spark, rows), net, keep=("doc_id", "spans"))


def test_every_candidate_is_scored_over_its_whole_length():
    table = secrets.symbol_table()
    x, y = [], []
    for _, t, _ in secret_texts():
        a, b = secrets.labelled(t, table)
        x, y = x + a, y + b
    net = secrets.train(np.array(x), np.array(y, np.float32))
    for text, want in (("name = hunter2x", ["hunter2x"]), ("a longword, écolelongue", ["longword"]), ("x.y-12345678.", ["x.y-12345678"]), ("ab12cd34==", ["ab12cd34=="]), ("short one", [])):
        symbols, starts = secrets.symbols_of([text], table)
        assert [text[a - starts[0] : b - starts[0]] for a, b in zip(*secrets.candidates(symbols), strict=True)] == want, text
    texts = [t for _, t, _ in secret_texts(20)] + ["", "z" * 3000 + "9F8E7D6C5B4A39281706F5E4D3C2B1A098877665" + "z" * 3000]
    symbols, starts = secrets.symbols_of(texts, table)
    a, b = secrets.candidates(symbols)
    whole = net.logits(symbols, a, b)
    assert np.allclose(whole, net.logits(symbols, a, b, block=100), atol=1e-4)
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):  # the convolution, one candidate at a time
        e = net.embed[symbols[p - secrets.LEFT - 2 : q + secrets.RIGHT + 2]]
        n = len(e) - secrets.SPAN + 1
        h = np.maximum(np.concatenate([e[j : n + j] for j in range(secrets.SPAN)], axis=1) @ net.kernel + net.shift, 0)
        parts = h[: secrets.LEFT], h[secrets.LEFT : secrets.LEFT + q - p], h[secrets.LEFT + q - p :]
        pooled = np.concatenate([x.max(axis=0) for x in parts])
        assert abs(pooled @ net.out[: len(pooled)] + net.out[len(pooled) + np.searchsorted(secrets._LENGTHS, q - p, side="right")] + net.bias - whole[k]) < 1e-3
    import time

    began = time.time()
    secrets.scan(["x1" * 500_000, "语" * 1_000_000], net, table)
    assert time.time() - began < 20


def test_planted_keys_of_six_kinds_in_prose(spark):
    """Keys in the small corpus's own prose, in documents that training doesn't see; what is like a key but is none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(3000).toPandas()
    seen, unseen = docs[docs.doc_id % 5 != 0], docs[docs.doc_id % 5 == 0]
    net = secrets.learn(spark.createDataFrame(seen[["doc_id", "text"]]))
    assert set(net.figures["by_kind"]) == set(secrets.LABELS.values())
    r, table = random.Random(3), secrets.symbol_table()
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kinds = {
        "letters 20": lambda: of(letters, 20), "letters 40": lambda: of(letters, 40), "prefixed": lambda: "ghp_" + of(letters, 36),
        "base64": lambda: of(letters + "+/", 43) + "=", "upper hex": lambda: of("0123456789ABCDEF", 32), "named": lambda: "client_key = " + of(letters, 24),
    }
    texts, found = unseen.text.tolist(), {}
    for kind, make in kinds.items():
        got = []
        for _ in range(150):
            text, said = r.choice(texts), make()
            at = text.find(" ", r.randrange(len(text) - 50))
            whole = f"{text[:at]} {said}{text[at:]}"
            a, b = at + 1 + said.rfind(" ") + 1, at + 1 + len(said)
            got.append(any(s < b and e > a for s, e, _ in secrets.scan([whole], net, table)[0][1]))
        found[kind] = sum(got) / len(got)
    assert min(found.values()) >= 0.9, found
    assert sum(len(s) - len(b) for b, s in secrets.scan(texts, net, table)) <= len(texts) // 100
    digits = "0123456789"
    others = {
        "capitals": lambda: of("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), "date": lambda: f"20{of(digits, 2)}-{of(digits, 2)}-{of(digits, 2)}/{of(digits, 2)}.{of(digits, 2)}",
        "number": lambda: of(digits, 12), "section": lambda: f"Section-{of(digits, 2)}-{of(digits, 3)}", "name": lambda: "_".join(r.choice(texts).split()[0].lower() for _ in range(4)),
    }
    wrong = {}
    for kind, make in others.items():
        wrong[kind] = sum(bool(secrets.scan([f"{(t := r.choice(texts))[:60]} {make()} {t[60:120]}"], net, table)[0][1]) for _ in range(150)) / 150
    assert max(wrong.values()) <= 0.1, wrong


def test_calibration_holds_whole_documents_out():
    """Windows that only their document can tell: with documents held out as a whole, nothing is learned by heart."""
    r = np.random.default_rng(1)
    x = r.integers(1, secrets.SYMBOLS, (800, secrets.WIDTH + 2)).astype(np.int32)
    x[:, secrets.WIDTH :] = 20
    x = np.repeat(x, 4, axis=0)  # four siblings of each
    kinds, documents = np.repeat(r.integers(0, 2, 800), 4), np.repeat(np.arange(800), 4)
    leaked, whole = secrets.train(x, kinds, epochs=6), secrets.train(x, kinds, documents, epochs=6)
    assert leaked.figures["false_positives"] < whole.figures["false_positives"] > 0.8


def test_every_window_of_every_document_is_learned_from(spark):
    """Counts of the fit are those of all windows, with many findings and many others in one text, however rows lie."""
    r = random.Random(8)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, t, "en") for i, t, _ in secret_texts(120)]
    rows += [(200, " ".join(f'token = "{key()}"' for _ in range(40)), None), (201, " ".join(f"longerword{i} otherwords" for i in range(300)), None), (202, None, None), (203, rows[0][1], None)]
    kinds = [k for _, t, _ in rows for k in secrets.labelled(t or "", secrets.symbol_table())[1]]
    assert kinds.count(1) >= 2 * 80 and kinds.count(0) >= 600
    net = secrets.learn(frame(spark, rows).repartition(1))
    assert (net.figures["findings"], net.figures["others"]) == (sum(k > 0 for k in kinds), sum(k <= 0 for k in kinds))
    of = {k: net.figures["taught"][name] + net.figures["by_kind"].get(name, (0, 0))[1] for k, name in secrets.LABELS.items()}
    assert of == {k: kinds.count(k) for k in secrets.LABELS}
    again = secrets.learn(frame(spark, rows).repartition(5))
    assert all(np.array_equal(getattr(net, p), getattr(again, p)) for p in secrets.PARAMETERS) and net.threshold == again.threshold


def test_steps_take_every_window():
    taken = set()

    class Recorder:
        def learn(self, x, y, weight):
            assert abs(weight[y == 1].sum() - 0.5) < 1e-6 and abs(weight[y == 0].sum() - 0.5) < 1e-6
            taken.update(row.tobytes() for row in x)

    made = secrets.examples([t for _, t, _ in secret_texts(150)] + ["x" * 1000, "ab12" * 100], secrets.symbol_table())
    secrets.learn_from(Recorder(), made, 1)
    every = made.rows(np.arange(len(made.kinds)))
    assert len(every) > 5 * secrets.STEP_PLAIN and taken == {row.tobytes() for row in every}


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(5, 300), (900, "ÉLAN vital's 12<|endoftext|>3 ²½ 中文 don't", None), (900, "again", None), (None, "nameless", None)]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows]
    pieces = packing.pack(frame(spark, rows).repartition(3)).collect()
    left = {}
    for i, own in ids:
        left.setdefault((i, len(own)), []).append(own)
    for p in pieces:
        assert any(np.frombuffer(p.ids, '<u4').tolist() == own[p.start : p.start + p.length] for own in left[p.doc_id, p.doc_tokens])
    assert sum(p.length for p in pieces) == sum(len(own) for _, own in ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(frame(spark, EMPTY)).count() == 0


def plain_bm25(docs, idf, mean):
    table = np.zeros((len(docs), 65_536), np.float32)
    for i, d in enumerate(docs):
        t, n = np.unique(d, return_counts=True)
        table[i, t] = idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return np.array([table[:, np.unique(d)].sum(axis=1) for d in docs])


def zipf_docs(n, seed=3):
    r = np.random.default_rng(seed)
    docs = [np.append(r.zipf(1.3, r.integers(1, 200)) % 900 + 2, 1).astype(np.uint16) for _ in range(n)]
    df = np.zeros(65_536)
    for d in docs:
        df[np.unique(d)] += 1
    return docs, np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))


def test_index_scores_are_bm25():
    docs, idf, mean = zipf_docs(700)
    want = plain_bm25(docs, idf, mean)
    near = packing.Neighbours(packing.Index(docs, idf, mean))
    assert np.allclose(near.scores, want, rtol=1e-4, atol=1e-3)
    near.unused[::3] = False
    for i in (1, 5, 400):
        left = np.flatnonzero(near.unused)
        got = list(near.of(i))
        assert sorted(got) == left.tolist() and np.allclose(want[i][got], np.sort(want[i][left])[::-1], rtol=1e-4, atol=1e-3)


def test_sequences_take_the_best_unused_neighbours():
    docs, idf, mean = zipf_docs(300)
    scores, unused = plain_bm25(docs, idf, mean), set(range(300))
    for k, sequence in enumerate(packing.fill(docs, idf, mean, 256)):
        assert sum(n for _, _, n in sequence) == 256 or k > sum(map(len, docs)) // 256 - 1
        for (seed, _, _), (doc, start, _) in zip([sequence[0]] * len(sequence), sequence, strict=True):
            if doc in unused and doc != seed and sum(n for _, _, n in sequence) == 256:
                left = [d for d in unused if d != seed]
                assert start == 0 and scores[seed, doc] >= max(scores[seed, d] for d in left) - 1e-2
            unused.discard(doc)
    assert not unused


def test_packing_puts_related_documents_together(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    common, far = [word() for _ in range(400)], 400
    topics = [[word() for _ in range(30)] for _ in range(far)]
    rows = [(i, " ".join(r.choice(topics[i % far] if r.random() < 0.5 else common) for _ in range(150)), "en") for i in range(2 * far)]
    pieces = packing.pack(frame(spark, rows).repartition(5), window=512, shard_docs=100).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.doc_id, set()).add(p.sequence_id)
    together = sum(bool(sequences[i] & sequences[i + far]) for i in range(far)) / far
    assert together >= 0.25, together  # by chance 1 in 100


def test_encoder_equals_the_tokenizer():
    r = random.Random(3)
    encode = packing.Encoder(packing.tokenizer_path())
    assert encode.words is not None
    letters = "abcdefghijklmnopqrstuvwxyzßàáâäåæçèéêëìíîïðñòóôõöøùúûüýþÿABCÄÉ"
    texts = []
    for _ in range(4000):
        text = " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) + r.choice(["", ".", "7", "!!", "'s", " <|endoftext|>", "×", "÷"]) for _ in range(r.randint(1, 4)))
        texts.append(text)
    texts += ["Words, and stops. Next\nline", "Two.. stops", "a,.b", " . ", ""]
    for text in texts:
        assert np.frombuffer(encode(text), np.uint16).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encode.words is not None


def test_spotsigs(spark):
    rows = corpus(7)
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in spotsigs.edited_fingerprints(docs, range_rows=7).collect()}
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    order = sorted(text, reverse=True)
    signs = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
    for k, i in enumerate(order):
        t, following = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == spotsigs.encode(spotsigs.signatures(t.encode())) and x.edited_fingerprint == spotsigs.encode(spotsigs.signatures(edited.encode()))
        a, b, c = signs(x.fingerprint), signs(x.edited_fingerprint), signs(got[order[(k + 1) % len(order)]].fingerprint)
        assert x.near_edited == pytest.approx(len(a & b) / len(a | b)) and x.near_next == pytest.approx(len(a & c) / len(a | c))
    assert got[0].fingerprint == got[60].fingerprint
    odd = frame(spark, [(3, "the ab cd", None), (3, "the ab cd", None), (None, "x", None), (None, None, None)])
    assert spotsigs.edited_fingerprints(odd).count() == 4
    one = spotsigs.edited_fingerprints(frame(spark, [(3, "the ab cd", None)])).first()
    assert one.near_next == 1.0
    assert spotsigs.edited_fingerprints(frame(spark, EMPTY)).count() == 0


def test_spotsigs_pairs_equal_brute_force(spark):
    r = random.Random(12)
    rows = []
    for i in range(60):
        base = [r.choice(["the", "of", "a"]) + " " + "".join(r.choice("abcdefgh") for _ in range(5)) + " " + r.choice(["kk", "ll", "mm"]) for _ in range(40)]
        rows.append((2 * i, " ".join(base), None))
        for _ in range(r.choice([0, 1, 2])):
            base[r.randrange(40)] = "the zz" + str(r.random())[2:8] + " kk"
        rows.append((2 * i + 1, " ".join(base), None))
    pairs, member = spotsigs.near_pairs(frame(spark, rows), 0.8)
    classes = {x.doc_id: x.class_id for x in member.collect()}
    signs = {i: frozenset(spotsigs.signatures(t.encode()).tolist()) for i, t, _ in rows}
    assert all((signs[a] == signs[b]) == (classes[a] == classes[b]) for a in signs for b in signs)
    reps = sorted(set(classes.values()))
    want = {tuple(sorted((a, b))) for a in reps for b in reps if a < b and len(signs[a] & signs[b]) >= 0.8 * len(signs[a] | signs[b])}
    assert {tuple(sorted((x.a, x.b))) for x in pairs.collect()} == want and want


@pytest.mark.parametrize("at_once", [10**9, 0])
def test_near_links_join_what_all_pairs_would(spark, at_once):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"the x{g}w{r.randrange(10**6)} kk{r.randrange(99)}" for _ in range(40)]
        for _ in range(r.choice([1, 2, 30])):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 9])):
                own[r.randrange(40)] = f"the y{r.randrange(10**6)} zz"
            rows.append((len(rows), " ".join(own), None))
    rows += [(900, "the ab cd", None), (901, "the ab cd", None), (902, "the ab ce", None)]
    sets = {i: frozenset(spotsigs.signatures(t.encode()).tolist()) for i, t, _ in rows}
    labelled = spark.createDataFrame([(i, [x - 2**32 if x >= 2**31 else x for x in sorted(sets[i])]) for i in sets], "fp long, signatures array<int>")
    edges = [(e.u, e.v) for e in spotsigs.near_links(labelled, 0.8, at_once=at_once).collect()]

    def roots(pairs):
        root = {i: i for i in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    long = [i for i in sets if len(sets[i]) >= spotsigs.LEAST_SIGNATURES]
    every = [(a, b) for a in long for b in long if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert roots(edges) == roots(every) and len(edges) < len(every) + len(sets)


def test_near_copies_reach_further_than_two_bits(spark):
    r = random.Random(2)
    vocabulary = [*["the", "of", "and"] * 30, *("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300))]
    rows = []
    for g in range(30):
        base = [r.choice(vocabulary) for _ in range(200)]
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(200)] = "zzzz"
        rows += [(2 * g, " ".join(base), "en"), (2 * g + 1, " ".join(copy), "en")]
    rows += [(100, None, None), (101, "", None), (102, "x", None), (102, "x", None), (None, "x", None)]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, rows)).collect()}
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(30)) >= 27 and len({got[2 * g] for g in range(30)}) == 30
    kept = [x.doc_id for x in simhash.keep_one(frame(spark, rows), simhash.near_copies(frame(spark, rows))).collect()]
    assert kept.count(102) == 1 and None in kept and 100 in kept and 101 not in kept
    assert simhash.near_copies(frame(spark, EMPTY)).count() == 0


def test_spotsigs_pairs_keep_null_and_repeated_ids(spark):
    text = lambda x, n: " ".join(f"the {x}{chr(97 + i)} kk" for i in range(n))
    rows = [(1, text("b", 20), None), (1, text("c", 20), None), (2, text("b", 19), None), (3, text("c", 19), None), (None, text("d", 20), None), (None, text("d", 19), None)]
    pairs, member = spotsigs.near_pairs(frame(spark, rows), 0.8)
    assert member.count() == 6 and member.select("key").distinct().count() == 6
    assert sorted((sorted((x.a or 0, x.b or 0)) for x in pairs.collect())) == [[0, 0], [1, 2], [1, 3]]


def test_quality(spark):
    r = random.Random(1)
    words = ["the", "of", "and", "river", "stone", "walks", "under", "bright", "morning", "to", "is", "valley", *("w" + "".join(r.choice("abcdef") for _ in range(5)) for _ in range(60))]
    rows = []
    for i in range(400):
        w = [r.choice(words) for _ in range(80)]
        poor = i % 8
        text = " ".join(w)
        if poor == 0:
            text = " ".join(x + "%%%" for x in w)
        elif poor == 1:
            text = "!! ".join(w).upper()
        elif poor == 2:
            text = " ".join(w[i % 3] for _ in range(100))
        rows.append((i, text, "en"))
    rows += [(900, None, None), (901, "", None), (902, "river walks. " * 10, None)]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in quality.score(docs, quality.learn(docs)).collect()}
    assert sum(got[i].predicted == (i % 8 > 2) for i in range(400)) >= 390
    assert len(got) == len(rows) and got[900].posterior < 0.5
    assert quality.score(frame(spark, EMPTY), quality.learn(frame(spark, EMPTY))).count() == 0


def test_label_model_beats_the_vote():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.6
    # One labeller calls a fifth of all good documents poor, two are sure, one is unsure of most poor ones.
    poor = np.array([[0.5, 0.2], [0.7, 0.01], [0.6, 0.02], [0.1, 0.01]])
    unsure = np.array([[0.1, 0.1], [0.05, 0.05], [0.1, 0.1], [0.8, 0.1]])
    x, rate, doubt = r.random((20_000, 4)), np.where(good[:, None], poor[:, 1], poor[:, 0]), np.where(good[:, None], unsure[:, 1], unsure[:, 0])
    votes = np.where(x < rate, -1, np.where(x < rate + doubt, 0, 1))
    votes[r.random((20_000, 4)) < 0.1] = quality.SILENT
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts.astype(float))
    assert abs(model.good - 0.6) < 0.05
    assert np.abs(model.rates[0, :, 0] - poor[:, 0]).max() < 0.08 and np.abs(model.rates[1, :, 0] - poor[:, 1]).max() < 0.05
    right = lambda p: float((p == good).mean())
    assert right(model.posterior(votes) >= 0.5) > right(~(votes == -1).any(axis=1)) + 0.05
    assert right(model.posterior(votes) >= 0.5) > right(np.where(votes == quality.SILENT, 0, votes).sum(axis=1) > 0) + 0.02


def test_posterior_equals_the_product_rule():
    rates = np.array([[[0.5, 0.2, 0.3], [0.4, 0.4, 0.2]], [[0.1, 0.1, 0.8], [0.05, 0.15, 0.8]]])
    model = quality.LabelModel(0.7, rates)
    for votes in ((-1, 1), (0, quality.SILENT), (quality.SILENT, quality.SILENT), (1, 0)):
        chance = [0.3, 0.7]
        for k in (0, 1):
            for m, v in enumerate(votes):
                chance[k] *= 1 if v == quality.SILENT else rates[k, m, v + 1]
        assert model.posterior(np.array([votes]))[0] == pytest.approx(chance[1] / sum(chance))


def test_quality_scores_equal_a_plain_version(spark):
    rows = [(1, "A river walks under the stone. " * 5, None), (1, "##% %% !!", None), (2, None, None), (3, "x" * 50_001 + " !! ##", None)]
    docs = frame(spark, rows)
    scorer = quality.learn(docs)
    known = quality.Known(quality._shape)
    want = []
    for i, t, _ in rows:
        s, shapes = quality.style((t or "").encode())
        at, x = quality.features(s, shapes, known)
        z = float((scorer.weights[at] * x).sum())
        want.append((i, round(1 / (1 + np.exp(-z)), 9), round(float(scorer.labels.posterior(np.array([quality.votes(s)]))[0]), 9)))
    assert sorted((x.doc_id, round(x.score, 9), round(x.posterior, 9)) for x in quality.score(docs, scorer).collect()) == sorted(want)


def test_odd_rows_everywhere(spark):
    """Repeated and null ids, null and empty texts: every operator returns a row for each."""
    rows = [(7, "a river of stone", "en"), (7, "a river of stone", "en"), (7, "other words are here 1.2.3.4", "de"), (None, "no name here", None), (None, None, None), (8, "", None)] * 2
    docs = frame(spark, rows)
    marks = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    made = {
        "language": language.identify(docs, language.learn(docs)),
        "toxicity": toxicity.score(docs, toxicity.learn(docs, marks)),
        "quality": quality.score(docs, quality.learn(docs)),
        "pii": pii.find_pii(docs, pii.learn(docs)),
        "secrets": secrets.find_secrets(docs, secrets.learn(docs)),
        "simhash": simhash.near_duplicates(docs),
        "copies": simhash.near_copies(docs),
        "spotsigs": spotsigs.edited_fingerprints(docs),
        "decontaminate": decontaminate.contamination(docs, spark.createDataFrame([(1, "river of stone")], "item_id long, text string")),
        "packing": packing.pack(docs),
    }
    for name, df in made.items():
        got = sorted(map(str, (x.doc_id for x in (df.where("start = 0") if name == "packing" else df).collect())))
        assert got == sorted(str(i) for i, _, _ in rows), name


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Session())
