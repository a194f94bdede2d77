"""Operators over documents: edge cases, brute force, held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.llm import chosenpath, components, ecoc, mixing, pii, quality, spm, textvec

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, IDS string"
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(n=60, seed=1):
    """Small documents with nulls, empty and long texts, ties and repeated rows, and columns named like results."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "straße", "x1", "😀", "and", "the"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 80)))
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text), "s", "p", "ids"))
    base = out[3]
    out += [base, base, (100, base[1], "en", "a", 1, "", "", ""), (101, base[1] + " tail", "en", "b", 1, "", "", ""), (None, base[1], None, None, None, None, None, None)]
    out += [(102, None, "en", "a", None, None, None, None), (103, "", "en", "a", 0, None, None, None), (104, " \n\t ", None, None, 4, None, None, None), (None, None, None, None, None, None, None, None)]
    out += [(105, "one two", "en", "c", 7, None, None, None), (106, "one two", "en", "c", 7, None, None, None), (107, "word " * 30000, "en", "c", 150000, None, None, None), (108, "w" * 100000, "en", "c", 100000, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingle_sets(texts, width=5):
    out = []
    for t in texts:
        w = WORDS.findall(t or "")
        k = min(width, len(w))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute_links(texts, threshold=0.8):
    sets = shingle_sets(texts)
    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverse[x].append(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverse[x] if j > i).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def reachable(n, links):
    out = list(range(n))
    for s in range(n):
        seen, todo = {s}, [s]
        while todo:
            for y in links.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out[s] = seen
    return out


def test_word_hashes_tell_words_apart():
    texts = ["a b", None, "", "ab a", "é\u00a0é b", "x" * 3_000_000 + " b"]
    h, first = textvec.words(*textvec.texts(pa.array(texts)))
    words = [w for t in texts for w in WORDS.findall(t or "")]
    assert list(np.diff(first)) == [len(WORDS.findall(t or "")) for t in texts]
    assert {(h[i] == h[j], words[i] == words[j]) for i in range(len(words)) for j in range(i)} == {(False, False), (True, True)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(40)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(None, 1), (2, None), (7, 7), (5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links[a].add(b)
            links[b].add(a)
    want = {}
    for s in links:
        seen, todo = {s}, [s]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        want[s] = min(seen)
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    # Hubs: stars of 1,500 and 400 leaves, joined by a leaf, whose centres are the largest and the middle node.
    star = [(9000, i) for i in range(1500)] + [(4000, 4001 + i) for i in range(400)] + [(1499, 4100)]
    got = components.components(spark.createDataFrame(star, "u long, v long")).collect()
    assert len(got) == 1902 and all(r.root == 0 for r in got)
    assert components.components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string").limit(2)).where("root = 'a'").count() == 3


# --- 1: mixing ---------------------------------------------------------------------------------------------------------------------------


def test_mix_nears_targets_and_reruns_agree(spark, docs):
    got = [r.asDict() for r in mixing.copies(docs).collect()]
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 2
    order = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    full, target = set(), {}
    while True:
        rate = (1.5 * total - sum(2 * size[s] for s in full)) / max(1e-9, sum(weight[s] for s in order if s not in full))
        more = {s for s in order if weight[s] * rate > 2 * size[s]}
        target = {s: min(2 * size[s], weight[s] * rate) for s in order}
        if more == full:
            break
        full = more
    for s, v in by.items():
        assert v[0]["target"] == pytest.approx(target[s])
        assert v[0]["source_size"] == size[s]
        biggest = max(r["size"] for r in v)
        assert abs(sum(r["copies"] * r["size"] for r in v) - target[s]) <= max(biggest / 2, 0.01 * size[s]) + 1
    again = mixing.copies(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(key(r.asDict()) for r in again)


def test_mix_takes_each_size_at_the_rate(spark, monkeypatch):
    """Of every size the share of documents that is taken nears the source's rate: no size is preferred. A third of all rows are equal, and are dealt in chunks."""
    monkeypatch.setattr(mixing, "CHUNK", 100)
    sizes = (1, 3, 10, 40)
    rows = [(i, "w " * sizes[i % 4], "s") for i in range(4000)] + [(9999, "a b c", "s")] * 2000 + [(5000 + i, "x " * 30, "t") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs, weights=(1, 3), share=0.4, most=1.0).groupBy("source", "size", F.col("doc_id") == 9999).agg(F.avg("copies"), F.max(F.col("target") / F.col("source_size")), F.count("*"), F.count_distinct("dup")).collect()
    assert len(got) == 6 and sum(r[5] for r in got) == 9000
    for r in got:
        assert 0.05 < r[4] < 0.95 and abs(r[3] - r[4]) < 0.03
        assert r[6] == (2000 if r[2] else 1)
    taken = mixing.mixed(docs, weights=(1, 3), share=0.4, most=1.0).where("doc_id = 9999").count()
    assert abs(taken / 2000 - next(r[4] for r in got if r[2])) < 0.03


def test_mixed_rows(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.size): 0 for r in mixing.copies(docs).collect()}
    for r in mixing.copies(docs).collect():
        taken[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in out.collect())
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert mixing.mixed(empty).count() == 0 and mixing.copies(empty).count() == 0


# --- 6: Jaccard join ---------------------------------------------------------------------------------------------------------------------


def test_jaccard_join_equals_brute_force(spark, docs, empty):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = []
    for i in range(150):  # a cluster of different texts, larger than a leaf
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        near.append((1000 + i, " ".join(w), "en", "n", 1, "", "", ""))
    extra = spark.createDataFrame(near, DOCS)
    all_docs = docs.unionByName(extra)
    local = [(r.doc_id, r.text) for r in all_docs.collect()]
    links = brute_links([t for _, t in local])
    groups = reachable(len(local), links)
    want = Counter()
    for i, (doc_id, t) in enumerate(local):
        ids = [local[j][0] for j in groups[i] if local[j][0] is not None]
        want[doc_id, len(links[i]), min(ids) if ids else None] += 1
    got = Counter((r.doc_id, r.n_links, r.component_id) for r in chosenpath.near_duplicates(all_docs).collect())
    assert got == want
    assert chosenpath.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_one_row_of_each_group(docs, empty):
    local = [(r.doc_id, r.text) for r in docs.collect()]
    groups = reachable(len(local), brute_links([t for _, t in local]))
    wordless = sum(not WORDS.findall(t or "") for _, t in local)
    kept = chosenpath.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({min(g) for i, g in enumerate(groups) if WORDS.findall(local[i][1] or "")}) + wordless
    assert chosenpath.one_of_each(empty).count() == 0


def test_blocks_and_splits_lose_nothing(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("LEAF", 8)):
        monkeypatch.setattr(chosenpath, name, value)
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(12))
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(90)] = f"e{i}"
        texts.append(" ".join(w))
    texts += [common + " " + " ".join(f"u{i}_{j}" for j in range(30)) for i in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = brute_links(texts)
    groups = reachable(len(texts), links)
    got = {r.doc_id: (r.n_links, r.component_id) for r in chosenpath.near_duplicates(d).collect()}
    assert got == {i: (len(links[i]), min(groups[i])) for i in range(len(texts))}


def test_runs_grow_with_recall():
    assert chosenpath.runs_for(0.9, 0.8) < chosenpath.runs_for(0.999, 0.8) < chosenpath.runs_for(0.999, 0.5)


# --- 7, 10: classifiers ------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality.train(d, labels)
    got = {r.doc_id: r for r in quality.score(d, weights, keep=["doc_id"]).collect()}
    test = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in test]) > 0.95
    assert np.mean([got[r.doc_id].predicted for r in test if r.quality == 1]) > 0.97
    assert np.array_equal(weights, quality.train(d.repartition(5), labels))


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7), (1, 1)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels))
    assert Counter(c.lower() for c in out.columns) == Counter(c.lower() for c in docs.columns)
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    none = quality.train(empty, labels.limit(0))
    assert quality.score(empty, none).count() == 0
    assert {r.score for r in quality.score(docs.limit(3), none).collect()} == {0.5}


TEXTS = ["", " \n", "Hello, World! 42", "aa aa bb  aa", "straße été; ÉTÉ", "x" * 40 + "9.", "<p>no</p>\t__init__", "日本 語", "A1 b2 C3 ... !!", "w " * 300]


def arrays(texts):
    return textvec.texts(pa.array(texts, pa.string()))


def plain_features(text, bits):
    """Feature numbers of a text, token by token."""
    word = 2**64 - 1

    def mix(h):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & word
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & word
        return h ^ h >> 32

    def hashed(token):
        return int(textvec.hash_runs(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]))[0])

    def shape(t):
        kind = 0 if re.match(rb"[0-9A-Za-z\x80-\xff]", t) else 1
        upper = lambda c: 65 <= c <= 90
        at = (((kind * 2 + upper(t[0])) * 2 + upper(t[min(1, len(t) - 1)])) * 2 + (48 <= t[-1] <= 57)) * 16 + min(len(t), 15)
        return int(quality._SHAPES[at])

    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", text.encode())
    salt = [int(x) for x in quality._SALT]
    h, p = [hashed(t) for t in tokens], [shape(t) for t in tokens]
    found = [mix(x ^ salt[0]) for x in h] + [mix(x ^ salt[1]) for x in p]
    for i in range(1, len(tokens)):
        found.append(salt[2] if h[i] == h[i - 1] else mix((h[i - 1] * salt[3] + h[i]) & word))
        found.append(mix((p[i - 1] * salt[4] + p[i]) & word))
    for i in range(2, len(tokens)):
        found.append(mix(((p[i - 2] * salt[5] + p[i - 1]) * salt[6] + p[i]) & word))
    return [f >> (64 - bits) for f in found]


def test_quality_scores_equal_a_plain_model():
    """Weights learned one coordinate at a time in a dict, and scores summed feature by feature."""
    bits = 10
    rows = [(i.tolist(), v.tolist(), k % 2) for k, (i, v) in enumerate(quality.features(*arrays(TEXTS), bits))]
    for (index, share, _), text in zip(rows, TEXTS, strict=True):
        count = Counter(plain_features(text, bits))
        assert dict(zip(index, share, strict=True)) == pytest.approx({i: n / sum(count.values()) for i, n in count.items()})
    alpha, beta, l1, l2 = 3.0, 0.1, 1e-4, 1e-4
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(3):
        for index, share, y in rows:
            pairs = [*zip(index, share, strict=True), (1 << bits, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    learned = quality.ftrl([(np.array(i, np.int32), np.array(v, np.float32), y) for i, v, y in rows], bits)
    assert learned.tolist() == pytest.approx([weight(i) for i in range((1 << bits) + 1)], abs=1e-5)
    want = []
    for text in TEXTS:
        found = plain_features(text, bits)
        want.append(1 / (1 + math.exp(-(sum(float(learned[i]) for i in found) / max(1, len(found)) + float(learned[-1])))))
    assert quality.scores(*arrays(TEXTS), learned).tolist() == pytest.approx(want, abs=1e-6)


def test_language_scores_equal_a_plain_model(spark):
    """N-grams counted one by one, bits and codewords' losses added one by one."""
    bits, names = 8, ["de", "en", "fr"]
    code = ecoc.codebook(3)
    weights = np.random.default_rng(2).normal(size=((1 << bits) + 1, code.shape[1])).astype(np.float32) * 3
    low = 2**32 - 1
    tables = [[int(x) for x in t] for t in (ecoc._T1, ecoc._T2, ecoc._T3)]

    def predicted(text):
        if not any(c.isalpha() for c in text):
            return "und", 1.0
        raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        raw = [b | 0x20 if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E else b for i, b in enumerate(raw)]
        place = lambda x: (x * 0x9E3779B1 & low) >> (32 - bits)
        a, b, c = ([t[x] for x in raw] for t in tables)
        found = [place(x) for x in a] + [place(x + y & low) for x, y in zip(b, c[1:])]
        found += [place((x * 5 & low) ^ (y * 9 & low) ^ (z * 17 & low)) for x, y, z in zip(a, b[1:], c[2:])]
        x = {i: math.sqrt(n / len(found)) for i, n in Counter(found).items()}
        margins = [sum(v * float(weights[i, k]) for i, v in x.items()) + float(weights[-1, k]) for k in range(code.shape[1])]
        losses = [sum(math.log1p(math.exp(-m * float(s))) for m, s in zip(margins, word, strict=True)) / len(margins) for word in code]
        p = [math.exp(-4 * (x - min(losses))) for x in losses]
        return names[losses.index(min(losses))], max(p) / sum(p)

    got = ecoc.predict(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), names, weights).orderBy("doc_id").collect()
    for r, text in zip(got, TEXTS, strict=True):
        name, score = predicted(text)
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-4)


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ecoc.predict(d, *ecoc.train(d), keep=["doc_id", "lang"]).collect()
    test = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.97


def test_language_edges(docs, empty):
    languages, weights = ecoc.train(docs)
    assert languages == ["de", "en"]
    got = ecoc.predict(docs, languages, weights).collect()
    for r in got:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    assert ecoc.train(empty)[0] == []
    assert {(r.lang_pred, r.ambiguous) for r in ecoc.predict(docs, *ecoc.train(empty)).collect()} == {("und", False)}
    one = docs.where("lang = 'en'")
    assert {r.lang_pred for r in ecoc.predict(docs.where("doc_id < 50"), *ecoc.train(one)).collect()} == {"en"}


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 20):
        code = ecoc.codebook(k)
        distance = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(distance) >= (1 if k == 2 else 2)


# --- 9: personal data --------------------------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "@", ".", "-", "1", "2", "45", "+", "(", " ", "%", "@b.c", "1.2.3.4", "4539 1488 0343 6467", "é", "+1 (202) 555-0143", "256.1.1.1"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a@" * 100_000) == [] and pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]


def test_contexts_find_unseen_identifiers(spark):
    lines = [f"please write to contact {chr(97 + i)}user{i}@mail{i}.example.com for details" for i in range(12)]
    lines += [f"please write to contact QX-{10000 + i * 37} for details" for i in range(6)]
    lines += [f"the year saw item B{20000 + i} of many" for i in range(6)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(90, None), (91, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.extract(d).collect()}
    assert [got[i].n_email for i in range(12)] == [1] * 12
    assert [got[i].n_id for i in range(12, 24)] == [1] * 6 + [0] * 6
    assert got[12].spans == "id:24:32" and got[90].spans == "" and got[91].n_ip == 0
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert clean[0] == "please write to contact [EMAIL] for details" and clean[12] == "please write to contact [ID] for details"
    assert clean[20] == lines[20] and clean[90] is None


def test_unrelated_documents_remove_no_spans(spark):
    lines = [f"please write to contact {chr(97 + i)}user{i}@mail{i}.example.com for details" for i in range(12)]
    lines += [f"please write to contact QX-{10000 + i * 37} for details" for i in range(6)] * 2
    noise = [" ".join(f"row{j % 7} B{k}{j:05d}" for j in range(2000)) for k in range(10, 90)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(lines + noise)] + [(900, None), (901, ""), (None, lines[12])], "doc_id long, text string").repartition(3)
    frequent, rare = pii.learn(d)
    assert not frequent and rare.count() == 2  # 25 mentions each of some 320,000
    got = pii.extract(d).collect()
    assert len(got) == d.count()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_id for i in range(24)] == [0] * 12 + [1] * 12 and by_id[12].spans == by_id[None].spans == "id:24:32"
    assert sum(r.n_id for r in got) == 13 and by_id[900].spans == ""
    out = pii.redact(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    clean = {r.doc_id: r.text for r in out.collect()}
    assert clean[0] == "please write to contact [EMAIL] for details" and clean[12] == clean[None] == "please write to contact [ID] for details"
    assert clean[24] == noise[0] and clean[900] is None and clean[901] == ""


def test_frequent_and_rare_patterns_find_the_same(spark, docs, monkeypatch):
    lines = [f"please write to contact {chr(97 + i)}user{i}@mail{i}.example.com for details" for i in range(12)]
    lines += [f"please write to contact QX-{10000 + i * 37} for details, ref: AB{10000 + i}" for i in range(6)]
    d = docs.limit(0).unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string"), True).unionByName(docs)
    want = [sorted(map(str, f(d).collect())) for f in (pii.extract, pii.redact)]
    monkeypatch.setattr(pii, "SHARE", 2.0)
    assert pii.learn(d)[0] == frozenset() and pii.learn(d)[1] is not None
    assert [sorted(map(str, f(d).collect())) for f in (pii.extract, pii.redact)] == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(map(str, f(d).collect())) for f in (pii.extract, pii.redact)] == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_personal_data_edges(docs, empty):
    assert pii.extract(docs).count() == docs.count() and pii.extract(empty).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == docs.count()


# --- 3: SentencePiece --------------------------------------------------------------------------------------------------------------------


def encoded(c, texts):
    """ids, parity and round trip of each text."""
    flat, at, parity, back = c.encoded(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], parity.tolist(), back.tolist()


def odd_texts():
    rng = random.Random(1)
    odd = ["", " ", "  a", "a  b ", "\n", "a▁b", "<s>x", "<0x0A>", "é̀😀\u0000z", "\t\tx   y", "▁▁", "a ", " a", "w" * 5000] + [" " * n + "x" + " " * n for n in range(2, 40)]
    return odd + ["".join(rng.choice([" ", "a", "the", "\n", "é", "😀", "▁", "  ", "ñ", "x1", "!!"]) for _ in range(rng.randrange(30))) for _ in range(500)]


def test_ids_are_the_rebuilt_tokenizers_and_parity_compares_whole_texts():
    c = spm.Codec(spm.model_bytes(), 1)
    odd = odd_texts()
    ids, parity, back = encoded(c, odd)
    assert ids == [e.ids for e in c.tokenizer.encode_batch(odd, add_special_tokens=False)]
    true = c.original.encode(odd)
    assert parity == [a == b for a, b in zip(ids, true, strict=True)] and sum(parity) > 0.99 * len(odd)
    assert back == [c.tokenizer.decode(a, skip_special_tokens=False) == b for a, b in zip(ids, odd, strict=True)]


def test_a_broken_model_shows(monkeypatch):
    """Ids come from the rebuilt tokenizer: without its merges they are others, which parity tells."""
    texts = ["the same words", "other words", ""]
    whole = encoded(spm.Codec(spm.model_bytes(), 1), texts)
    monkeypatch.setattr(spm, "merges", lambda m: [])
    broken = encoded(spm.Codec(spm.model_bytes(), 1), texts)
    assert whole[1] == [True] * 3 and broken[1] == [False, False, True]
    assert broken[0][0] != whole[0][0] and broken[2] == [True] * 3


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(spm, "CACHE", 50)
    c = spm.Codec(spm.model_bytes(), 1)
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(20)) for _ in range(5)]
        assert encoded(c, texts) == (c.original.encode(texts), [True] * 5, [True] * 5)


def test_encode_and_decode(docs, empty):
    model = spm.model_bytes()
    out = spm.encode(docs, model)
    assert [c.lower() for c in out.columns].count("ids") == 1
    got = out.collect()
    assert len(got) == docs.count() and all(r.parity and r.round_trip for r in got)
    assert all((r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) for r in got)
    back = spm.decode(spm.encode(docs.where("doc_id IS NOT NULL"), model, keep=["doc_id"]), model)
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(r.text == text[r.doc_id] for r in back.collect())
    assert spm.encode(empty, model).count() == 0


def message(fields):
    """A protocol buffer message."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    out = b""
    for n, v in fields:
        if isinstance(v, bytes):
            out += number(n << 3 | 2) + number(len(v)) + v
        elif isinstance(v, float):
            out += number(n << 3 | 5) + struct.pack("<f", v)
        else:
            out += number(n << 3) + number(v)
    return out


def test_unigram_models_are_rebuilt():
    """A small unigram model written by hand, and one of 32,000 pieces with byte fallback: those of the model at hand, scored by rank."""
    small = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -5.0, 1), ("▁", -3.0, 1), ("a", -3.5, 1)]
    large = [(p, -5 - math.log(i + 1) if kind == spm.NORMAL else s, kind) for i, (p, s, kind) in enumerate(spm.parse(spm.model_bytes()).pieces)]
    words = ["the", "words", "of", "a", "tokenizer", "naïve", "x1", "日本", "😀", "unbelievable", "zzz", "Ωmega", "123456", "re-entry,"]
    rng = random.Random(3)
    many = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(200)] + ["", " a", "a  b", "w" * 300]
    for pieces, trainer, texts in ((small, [(3, 1)], ["ab a", "aab", "b", "", "ab ab"]), (large, [(3, 1), (35, 1)], many)):
        data = b"".join(message([(1, message([(1, p.encode()), (2, float(s)), (3, t)]))]) for p, s, t in pieces)
        data += message([(2, message(trainer)), (3, message([(3, 1), (4, 0), (5, 1)]))])
        c = spm.Codec(data, 1)
        assert spm.parse(data).kind == spm.UNIGRAM
        ids, parity, back = encoded(c, texts)
        assert ids == c.original.encode(texts) and all(parity)
        assert back == [c.tokenizer.decode(a, skip_special_tokens=False) == b for a, b in zip(ids, texts, strict=True)]
