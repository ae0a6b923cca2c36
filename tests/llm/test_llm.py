"""Operators of tidemark.llm against brute force, round trips and held-out accuracy, on small fixtures with odd rows."""

import base64
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from tidemark.llm import bit_sliced, byte_bpe, minhash, packing, pii, quality_classifier, quality_rules, sharding, toxicity, warc
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "on", "ti", "re", "ha", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    base = [prose(rng, 80) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.02 else "zz" + w for w in base[0].split()) for _ in range(25)]
    far = [" ".join(w if rng.random() > 0.06 else "yy" + w for w in base[1].split()) for _ in range(25)]
    return [*base, *near, *far, base[2], base[2].upper(), None, "", " \n\t ", "one", "one", "ONE two", "one two three", "a\x0bb\x0cc", prose(rng, 6000), "é ü ñ " * 30]


# ---- 1


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute_components(texts, k):
    sets, up = [shingles(t, k) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], list(map(len, sets))


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_brute_force(spark, odd_texts, words):
    comp, sizes = brute_components(odd_texts, words)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, odd_texts).withColumn("component_id", F.lit(9)), words=words).collect()}
    assert [got[i]["component_id"] for i in range(len(odd_texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(odd_texts))] == sizes
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(rows).collect()) == [("7", "7", True), ("7", "7", True), ("9", "9", True), ("None", "None", True)]


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100}


def test_agreement_at_the_similarity_bound():
    """Pairs of sets at similarity 0.8 to 0.85 agree on MATCHES coordinates: none of 6,000 is missed."""
    rng, (mul, add) = np.random.default_rng(7), minhash._family(minhash.COORDS)
    least = 64
    for _ in range(6000):
        both = int(rng.integers(4, 60)) * 4
        more = both // 4
        h = rng.integers(0, 2**64, both + more, dtype=np.uint64)
        share = int(rng.integers(0, more + 1))
        sigs = [((mul[:, None] * x[None] + add[:, None]).min(axis=1) >> np.uint64(32)) for x in (h[: both + share], np.concatenate([h[:both], h[both + share :]]))]
        least = min(least, int((sigs[0] == sigs[1]).sum()))
    assert least >= minhash.MATCHES


@pytest.mark.parametrize("block", [3, 40])
def test_near_duplicates_over_several_blocks(spark, monkeypatch, block):
    """Chains of near copies that a star doesn't join, dealt into many small blocks; dense blocks go through the matrix product."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(31)
    texts = []
    for _ in range(3):
        words = prose(rng, 120).split()
        for _ in range(40):
            words = [w if rng.random() > 0.02 else "q" + w for w in words]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    comp, _ = brute_components(texts, 4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, texts), words=4).collect()}
    assert [got[i] for i in range(len(texts))] == comp


def test_common_sizes_equal_intersections():
    rng = random.Random(32)
    sets = [[np.array(sorted(rng.sample(range(60), rng.randint(0, 30))), np.int64) for _ in range(7)] for _ in range(2)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[1]] for a in sets[0]]
    assert minhash._common(*sets).tolist() == want and minhash._common(*sets, columns=5).tolist() == want


def test_joins_of_a_key_with_very_many_rows(spark):
    from tidemark.llm.common import cut
    from tidemark.llm.components import hot_keys, spread_join

    left = cut(spark.range(6000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS k"))
    right = spark.createDataFrame([(1, "hub"), (3, "three")], "k long, name string")
    rows, hot = hot_keys(left, "k")
    assert rows == 6000 and [tuple(r) for r in hot.collect()] == [(1, 6)] and hot_keys(right, "k") == (2, None)
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("id", "k", "name").collect()))
        assert sorted(map(str, spread_join(left, right, "k", hot, how).select("id", "k", "name").collect())) == want
    star = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(9)], "a long, b long")
    assert Counter(r["component"] for r in connected_components(star).collect()) == {0: 3000, 5000: 10}


# ---- 2


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 600)]
    df = spark.createDataFrame([(k, None if k == 1 else f"é{k}") for k in keys] + [(100, "again"), (None, "x")], "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = sharding.shard_table(df, shards=8, buckets=16).collect()
    assert len(rows) == len(keys) + 2
    slots = defaultdict(list)
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"] or 0, 8), jump(r["doc_id"] or 0, 9))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one = next(r for r in rows if r["doc_id"] == 101)
    assert (one["size"], one["text_crc32"]) == (len("é101".encode()) + 1, zlib.crc32("é101".encode()))
    assert next(r["size"] for r in rows if r["doc_id"] == 1) == 1
    assert sharding.shard_table(df.limit(0)).count() == 0
    again = sharding.shard_table(df.union(df).union(df), shards=8, buckets=16).groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("top"), F.count("slot").alias("rows")).collect()
    assert all(r["n"] == r["rows"] == r["top"] + 1 for r in again) and sum(r["rows"] for r in again) == 3 * len(rows)  # rows that repeat have slots of their own
    many = spark.range(200).select(F.col("id"), sharding.jump_hash(F.col("id"), 1000).alias("s")).collect()
    assert all(r["s"] == jump(r["id"], 1000) for r in many)


# ---- 3

CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(t):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(CONTRACT.items()) for m in re.finditer(p, t or "") if passes(k, m.group()))


def test_spans_equal_the_contract(spark):
    texts = [
        "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0001.0255.003.4", "+1 (377) 555-0100. +44 20 7946 0958 +1", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "é😀 x.y@z.co.uk, 4111111111111111", "", None,
        "1" * 5000, "a" * 5000 + "@b.c", "x@" + ".a" * 3000, ".a@b.c.d..e@f.g", "12 34 5678-9012 3456-", "a%b+c@d-e.f-g.h@i.j", "+12345678901 +1234567890123456 (+1 2 3 4 5 6 7 8 9)", "1.1.1.1@a.b 10.0.0.1",
    ]
    df = docs(spark, texts).withColumn("base", F.lit(1))
    rows = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in rows[i]["base"]] == brute_spans(t), t
    assert rows[4]["clean"] == "é😀 [EMAIL], [CARD]"
    digests = {r["doc_id"]: r for r in pii.digest(pii.sanitise(df)).collect()}
    want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_spans(texts[2]))
    assert digests[2]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and digests[2]["n_phone"] == len(brute_spans(texts[2]))
    assert pii.digest(pii.sanitise(df.limit(0))).count() == 0


def test_terms_that_disclose(spark):
    rng = random.Random(8)
    told = [f"{prose(rng, 20)} Zyxwv of {'q@mail.example.com'} wrote {prose(rng, 20)}" for _ in range(5)]
    rest = [prose(rng, 60) for _ in range(60)] + ["wrote of " + prose(rng, 30) for _ in range(20)]
    rows = {r["doc_id"]: r for r in pii.sanitise(docs(spark, told + rest)).collect()}
    for i in range(5):
        assert [s["value"] for s in rows[i]["spans"] if s["kind"] == "term"] == ["Zyxwv"]
        assert "Zyxwv" not in rows[i]["clean"] and "wrote" in rows[i]["clean"] and "[EMAIL]" in rows[i]["clean"]
    assert all(not rows[i]["spans"] for i in range(5, 85))


def terms_of(row):
    return [s["value"] for s in row["spans"] if s["kind"] == "term"]


def test_terms_that_disclose_values_seen_once(spark):
    """Values of one document each: the estimate is made for the value and, where that is too weak, for its class and kind."""
    rng = random.Random(9)
    unique = [f"{prose(rng, 20)} Qwxyz {prose(rng, 5)} u{i}@firm.example.com {prose(rng, 20)}" for i in range(8)]
    kinds = [f"{prose(rng, 20)} Vrklm 10.{i}.{2 * i}.7 {prose(rng, 20)}" for i in range(40, 48)]
    rest = [prose(rng, 60) for _ in range(400)]
    rows = {r["doc_id"]: r for r in pii.sanitise(docs(spark, [*unique, *kinds, *rest])).collect()}
    assert all("Qwxyz" in terms_of(rows[i]) and "Qwxyz" not in rows[i]["clean"] for i in range(8))
    assert all("Vrklm" in terms_of(rows[i]) and "Vrklm" not in rows[i]["clean"] for i in range(8, 16))
    assert all(not rows[i]["spans"] for i in range(16, 416))


def test_terms_far_from_the_entity_and_with_digits(spark):
    rng = random.Random(10)
    told = [f"Zyxwv {prose(rng, 120)} B7421 of q@mail.example.com wrote {prose(rng, 20)}" for _ in range(6)]
    rows = {r["doc_id"]: r for r in pii.sanitise(docs(spark, told + [prose(rng, 60) for _ in range(200)])).collect()}
    assert all({"Zyxwv", "B7421"} <= set(terms_of(rows[i])) for i in range(6))
    assert all(not {"mail", "example", "com"} & set(terms_of(rows[i])) for i in range(6))


def brute_terms(texts):
    """Disclosing terms of each text, by counting: every term with every value, class and kind."""
    import math

    word = re.compile(r"[^\W_]+")  # letters and digits; the texts have no combining marks
    n, spans = len(texts), [brute_spans(t) for t in texts]
    keys, own = [], []
    for t, found in zip(texts, spans, strict=True):
        here = set()
        for a, _, b, kind in found:
            v = (t or "")[a:b].lower()
            d = re.sub("[^0-9]", "", v)
            wide = {"email": v.rsplit("@", 1)[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]
            here |= {("v", kind, v), ("c", kind, wide), ("k", kind)}
        keys.append(here)
        left = list(t or "")
        for a, _, b, _ in found:
            left[a:b] = " " * (b - a)
        own.append(set(word.findall("".join(left).lower())))
    whole = [own[i] if spans[i] else set(word.findall((t or "").lower())) for i, t in enumerate(texts)]
    n_t, n_e = Counter(w for s in whole for w in s), Counter(k for s in keys for k in s)
    both = Counter((k, w) for i, s in enumerate(keys) for k in s for w in own[i])
    telling = set()
    for (k, w), c in both.items():
        if n_e[k] == n or n_t[w] > n_e[k] ** pii.GENERALISE * n ** (1 - pii.GENERALISE) + 1e-6:
            continue
        p, m, z = c / n_t[w], n_t[w], pii.Z
        low = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if 1 + math.log(low) / math.log(n / n_e[k]) >= pii.GENERALISE:
            telling.add((k, w))
    return [{w for w in own[i] if any((k, w) in telling for k in keys[i])} for i in range(n)]


def test_terms_equal_those_of_plain_counting(spark):
    """Values that repeat and don't, classes and kinds, rows that repeat, nulls, clashing columns."""
    rng = random.Random(33)
    texts = [f"{prose(rng, 25)} Name{i % 7} {prose(rng, 5)} u{i % 11}@firm{i % 3}.example.com {'10.%d.3.4' % (i % 5) if i % 2 else ''} Qx{i} {prose(rng, 15)}" for i in range(60)]
    texts += [prose(rng, 40) for _ in range(500)] + [None, ""] + texts[:9] * 2
    df = docs(spark, texts).withColumn("terms", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("keys", F.lit(0))
    want = brute_terms(texts)
    assert sum(map(len, want)) > 50
    got = {r["doc_id"]: {v.lower() for v in terms_of(r)} for r in pii.sanitise(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    same = df.withColumn("doc_id", F.lit(7).cast("long"))  # one id for all rows
    assert Counter(tuple(sorted({v.lower() for v in terms_of(r)})) for r in pii.sanitise(same).collect()) == Counter(tuple(sorted(w)) for w in want)


def test_terms_whose_lower_case_is_longer(spark):
    rng = random.Random(11)
    told = "mail a@b.com \u0130stanbulx \u1e9eqwx Zqwxe is the of"
    rows = {r["doc_id"]: r for r in pii.sanitise(docs(spark, [told, *["is the of " + prose(rng, 30) for _ in range(1500)]])).collect()}
    assert {s["value"] for s in rows[0]["spans"] if s["kind"] == "term"} >= {"\u0130stanbulx", "\u1e9eqwx", "Zqwxe"}
    assert "stanbulx" not in rows[0]["clean"] and rows[0]["clean"].startswith("[TERM] [EMAIL] ") and rows[0]["clean"].endswith(" is the of")


def test_marks_in_a_long_text(spark):
    """Blocks and runs of spans make no difference: places, overlaps and letters of several bytes."""
    rng = random.Random(12)
    text = "".join(rng.choice("ab\u00e9\U0001d400 ") for _ in range(4 * pii.BLOCK + 77))
    spans, at = [], 0
    while at < len(text) - 40:
        at += rng.choice([0, 1, 5, 9, 30])
        spans.append((at, rng.randint(0, 4), at + rng.randint(1, 9)))
        at += rng.randint(0, 9)
    spans = sorted(spans)
    want, end = "", 0
    for start, _, stop in spans:
        if stop > end:
            want, end = want + text[end:start] + "#", stop
    want += text[end:]
    df = spark.createDataFrame([(text, [(a, r, b) for a, r, b in spans]), ("", []), ("abc", [(0, 0, 3)])], "text string, spans array<struct<start:bigint,rank:int,end:bigint>>")
    assert len(spans) > 2 * pii.RUN
    assert [r[0] for r in df.select(pii._marked("spans", lambda x: F.lit("#"))).collect()] == [want, "", "#"]


# ---- 4


def test_pieces_and_packing(spark, odd_texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [*odd_texts, "a <|endoftext|> B<|STARTOFTEXT|>c end.| don't I'VE İstanbul ǅx ﬁx ẍ é ΑΣ Σ x\x1cy z w"]
    rows = packing.pack(docs(spark, texts).withColumn("piece", F.lit("x")), path).collect()
    tok, want = Tokenizer.from_file(path), {}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            part = ids[k * 2048 : (k + 1) * 2048]
            want[i, k] = (k * 2048, len(part), zlib.crc32(part.tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack(docs(spark, []), path).count() == 0


def test_words_whose_letters_the_tokenizer_changes_before_marks():
    """Letters that come apart into a letter and a mark, jamo that come together, capitals and signs, each before and between marks."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, ids = Tokenizer.from_file(path), packing.WordIds(path, memo_bytes=20_000)
    odd = ["kedİ", "\u0958", "x\u09dcy", "\u1100\u1161", "한국어", "日本語", "Привет", "ΑΣ", "ß", "éa\u0301", "a\u0301", "ǅx", "ﬁx", "don't", "3rd", "a1", "€5", "ªº", "ſ", "K", "\u0345", "नमस्ते", "שלום", "\u2126", "ŉ"]
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice([*odd, "word", "The", "<|endoftext|>", "<|"]) + rng.choice(["", ",", ". ", " ", "!? ", "'s ", "...", "|>", "\n", "\u0301. "]) for _ in range(12))
        texts = [text, "", None, " \t" + text + "\n", text.upper()]
        got = [np.frombuffer(x, "<u4").tolist() for x in ids.encode(pa.array(texts, pa.binary()))]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in texts], text


def test_ranks_of_one_common_length(spark):
    """Pieces of one length in many buckets still get every place once."""
    rows = packing.pack(docs(spark, ["one two"] * 500 + [None] * 300), P.path("word_bpe_49k.json"), ranked=16).collect()
    assert len(rows) == 800 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 800
    assert len({r["sequence_id"] for r in rows}) == 1


def test_fullest_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts, room = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}, rng.randint(1, 80)
        used = packing.fullest(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * i for s in sums for i in range(n + 1)}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


# ---- 5, 8


def test_quality_on_the_held_out_fold(spark):
    rng = random.Random(11)
    rows = [(i, (t := prose(rng, 60)) if i % 5 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), int(i % 5 != 0)) for i in range(600)]
    df, labels = docs(spark, [r[1] for r in rows] + [None, ""]), spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(df, quality_classifier.train(df, labels)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in held) >= 0.97 * len(held) > 90
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 602
    untaught = quality_classifier.score(df, quality_classifier.train(df, labels.limit(0))).agg(F.min("score"), F.max("score")).first()
    assert tuple(untaught) == (0.5, 0.5)
    assert quality_classifier.score(df.limit(0), np.zeros(1 << 18, np.float32)).count() == 0


def test_toxicity_of_plain_and_disguised_words(spark):
    rng = random.Random(12)
    rude = ["idiot", "moron", "scum", "worthless", "stupid"]
    texts = [prose(rng, 30) + (f" {rng.choice(rude)}, " if i % 3 == 0 else " ") + prose(rng, 20) for i in range(600)]
    disguised = ["1d10t", "m0r0n", "i d i o t", "s.c.u.m", "stuuupid", "iiidiooot", "W0RTHLE5S", "$cum"]
    df = docs(spark, [*texts, *(f"{prose(rng, 20)} {w} {prose(rng, 20)}" for w in disguised), None, "", "$$$ ### 1.2.3 &&&"])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.letter_model(df)
    got = {r["doc_id"]: r for r in toxicity.score(df, model, *toxicity.train(df, labels, model)).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert [got[600 + i]["predicted"] for i in range(len(disguised))] == [1] * len(disguised)
    assert [got[608 + i]["predicted"] for i in range(3)] == [0] * 3
    assert toxicity.score(df.limit(0), model, {}, 0.0).count() == 0

def test_toxicity_of_further_disguises(spark):
    rng = random.Random(13)
    rude = ["idiot", "moron", "scum", "worthless", "stupid"]
    texts = [prose(rng, 30) + (f" {rng.choice(rude)}, " if i % 3 == 0 else " ") + prose(rng, 20) for i in range(600)]
    disguised = ["idiiot", "stuupid", "$$$tupid", "m0r0n.", '"$tupid', "(1diot)", '"s.c.u.m"', "(i d i o t)", "s\tc\tu\tm", "m/o/r/o/n", "s*t*u*p*i*d", "i   d   i   o   t!"]
    df = docs(spark, [*texts, *(f"{prose(rng, 20)} {w} {prose(rng, 20)}" for w in disguised)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.letter_model(df)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model, *toxicity.train(df, labels, model)).collect()}
    assert not [w for i, w in enumerate(disguised) if not got[600 + i]]
    assert not [i for i in range(600) if i % 3 and got[i]]



def all_readings(word, model):
    """Every path of the lattice with its cost, one by one."""
    paths = [((0, 0), 0.0, "")]
    before = ""
    for ch in word:
        then = []
        for (a, b), cost, out in paths:
            for x, more in toxicity._options(ch, before):
                if x == "" or x == " " and b == 0:
                    then.append(((a, b), cost + more, out))
                else:
                    k = 0 if x == " " else toxicity._code(x)
                    then.append(((b, k), cost + more - float(model[a, b, k]), out + x))
        paths, before = then, ch
    return {out: cost - float(model[a, b, 0]) * (b > 0) for (a, b), cost, out in sorted(paths, key=lambda p: -p[1])}, min(cost - float(model[a, b, 0]) * (b > 0) for (a, b), cost, out in paths)


def test_restored_words_equal_the_enumerated_lattice(spark):
    rng = random.Random(14)
    model = toxicity.letter_model(docs(spark, [prose(rng, 400), "idiot moron scum stupid worthless " * 20]))
    for _ in range(300):
        word = "".join(rng.choice(["i", "d", "o", "t", "1", "0", "!", "$", "|", "*", "s", "u", "uu", " ", "."]) for _ in range(rng.randint(1, 8)))
        costs, least = all_readings(word, model)
        assert abs(costs[toxicity.restore(word, model)] - least) < 1e-6, word


def test_long_disguised_words_are_read_whole(spark):
    rng = random.Random(15)
    model = toxicity.letter_model(docs(spark, [prose(rng, 400), "idiot moron scum stupid worthless " * 50]))
    assert toxicity.restore("1d10t" * 60, model).replace(" ", "") == toxicity.restore("1d10t" * 60, model)
    assert toxicity.restore("1d10t" * 60, model).count("idiot") == 60
    assert toxicity.restore(" ".join("1d10t" * 60), model).replace(" ", "").count("idiot") == 60
    assert len(toxicity.restore("m0r0n" * 20_000, model)) == 100_000


def test_toxicity_of_repeated_rows_clashing_columns_and_long_texts(spark):
    rng = random.Random(16)
    texts = [prose(rng, 30) + (" idiot " if i % 3 == 0 else " ") + prose(rng, 20) for i in range(300)]
    df = docs(spark, [*texts, " ".join([prose(rng, 40_000), "1d10t"])]).withColumn("score", F.lit("x")).withColumn("label", F.lit(None)).withColumn("features", F.lit(1))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.letter_model(df)
    weights = toxicity.train(df.union(df.limit(40)), labels, model)
    got = toxicity.score(df.union(df.filter("doc_id < 10")), model, *weights).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*range(301), *range(10)])
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in got)
    assert toxicity.train(df, labels.limit(0), model) == ({}, 0.0)


def test_ftrl_equals_the_published_update():
    """The dense textbook loop, one coordinate at a time."""
    import math

    from tidemark.llm.ftrl import Ftrl

    rng, fit = random.Random(17), Ftrl(12, alpha=0.7, beta=0.5, l1=0.05, l2=0.02)
    z, n = [0.0] * 12, [0.0] * 12
    for _ in range(400):
        idx = sorted(rng.sample(range(12), 4))
        x, y = [rng.uniform(-1, 2) for _ in idx], rng.randint(0, 1)
        w = {i: 0.0 if abs(z[i]) <= 0.05 else -(z[i] - math.copysign(0.05, z[i])) / ((0.5 + math.sqrt(n[i])) / 0.7 + 0.02) for i in idx}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(idx, x, strict=True))))
        for i, v in zip(idx, x, strict=True):
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
            z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
        fit.update(np.array(idx), np.array(x), y)
    assert np.allclose(fit.z, z) and np.allclose(fit.n, n)


def test_quality_scores_equal_a_plain_sum_of_weights(spark):
    """n-grams by their words, hashed one at a time; repeated rows, clashing columns, a very long text and few labels."""
    import xxhash

    rng = random.Random(18)
    weights = np.random.default_rng(1).normal(0, 1, 1 << 18).astype(np.float32)
    mask, prime, mix = 2**64 - 1, int(quality_classifier._PRIME), int(quality_classifier._MIX)

    def place(h, kind):
        h = (h + kind) * prime & mask
        return ((h ^ h >> 31) * mix & mask) >> 46

    def plain(text):
        words = (text or "").split()
        w = [xxhash.xxh3_64_intdigest(x.lower()) for x in words]
        s = [xxhash.xxh3_64_intdigest(quality_classifier.shape(x)) for x in words]
        pairs = lambda v: [(a * mix + b) & mask for a, b in zip(v, v[1:])]
        kinds = [(w, 1), (s, 3), (pairs(w), 2), (pairs(s), 4), ([int(a == b) for a, b in zip(w, w[1:])], 6), ([((a * mix + b) * mix + c) & mask for a, b, c in zip(s, s[1:], s[2:])], 5)]
        total = float(weights[0]) + sum(np.mean([float(weights[place(h, k)]) for h in v]) for v, k in kinds if v)
        return 1 / (1 + np.exp(-min(max(total, -35), 35)))

    texts = [prose(rng, 30) + " Ab1!! ÉÉ zz zz 2024", "one", "one two", None, "", prose(rng, 30_000)]
    df = docs(spark, texts).withColumn("score", F.lit("clash"))
    got = quality_classifier.score(df.union(df.limit(2)), weights).collect()
    assert len(got) == 8 and all(abs(r["score"] - plain(texts[r["doc_id"]])) < 1e-5 for r in got)
    one = spark.createDataFrame([(0, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    low, high = (quality_classifier.score(df, quality_classifier.train(df.union(df), labels)).filter("doc_id = 0").first()["score"] for labels in (one.limit(0), one))
    assert low == 0.5 and (high > 0.6 or zlib.crc32(b"0") % 5 == 0)


def test_shapes_count_the_whole_word():
    assert quality_classifier.shape("x-1" * 20 + "XXXX!!") != quality_classifier.shape("x-1" * 20 + "yy")


# ---- 6


def brute_top_k(table, k=20):
    """(query, rank, candidate, score) of rows (vec_id, integers): every row but the query's own."""
    out = []
    for n, (q, x) in enumerate(table):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(table) if m != n)[:k]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(best)]
    return sorted(out)


def floors(v):
    from fractions import Fraction
    from math import floor

    return [floor(64 * Fraction(c)) for c in v]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.3, (300, 8)).astype(np.float32)
    x[100:200] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, rows[0][1])]
    more = [(380, rows[3][1][:5]), (400, []), (400, []), (420, rows[5][1]), (420, rows[5][1]), (420, rows[9][1]), (77, rows[8][1])]
    df = spark.createDataFrame(rows + odd + more, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("row", F.lit(1)).withColumn("x", F.lit("clash"))
    got = bit_sliced.top_k(bit_sliced.quantised(df), "vec_id % 20 = 0", 20, block_rows=10, batch_queries=6).collect()
    want = brute_top_k([(i, floors(v)) for i, v in rows + more])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert bit_sliced.top_k(bit_sliced.quantised(df.limit(0)), "vec_id % 20 = 0").count() == 0


def test_top_k_of_large_numbers(spark):
    """Components from 2**28 to 2**70, with scores beyond 64 bits, beside small ones: no row goes and no order is lost."""
    rng = random.Random(61)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.choice([0, 1, 28, 40, 41, 70]) if i % 3 else rng.random() for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = bit_sliced.top_k(bit_sliced.quantised(df), "vec_id % 20 = 0", 20, block_rows=16).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_top_k([(i, floors(v)) for i, v in rows])
    texts = [bit_sliced.beyond(s) for s in (-(10**30), -(10**25) - 1, -(10**25), 2**63, 10**25, 10**25 + 1, 10**30)]
    assert texts[:3] == sorted(texts[:3]) and texts[3:] == sorted(texts[3:]) and bit_sliced.beyond(-(2**63)) is None


# ---- 7


def test_packages_round_trip(spark, tmp_path):
    rows = [(3, "http://a b", "<p>é</p>"), (1, "u\r\nv", "<p>é</p>"), (2, None, None), (5, "x", ""), (4, "y", "z" * 100_000), (4, "y", "z" * 100_000), (None, "n", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("sha", F.lit("clash"))
    packages = warc.write_packages(pages, f"file://{tmp_path}/a")
    got = sorted(((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_packages(packages).collect()))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {("3", "<p>é</p>"): ("revisit", 1), ("5", ""): ("revisit", 2)}
    want = sorted((str(i), *kinds.get((str(i), h), ("response", None)), len((h or "").encode()), digest(h)) for i, _, h in rows)
    assert got == want
    for path in (tmp_path / "a").glob("*.wacz"):  # any ZIP reader opens them
        with zipfile.ZipFile(path) as z:
            assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
    assert sum(r["records"] for r in packages.collect()) == len(rows) == warc.read_package_files(spark, str(tmp_path / "a")).count()
    assert warc.read_packages(warc.write_packages(pages.limit(0), f"file://{tmp_path}/b")).count() == 0
    assert warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/c", min_bytes=50)).filter("record_type = 'revisit'").count() == 0


def test_payloads_of_very_many_pages(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE cast(id AS string) END AS html")
    got = warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/hot"))
    assert got.filter("record_type = 'revisit' and refers_to = 0").count() == 1999 and got.count() == 3000


def test_a_package_beyond_4_gigabytes_is_read_by_range(spark, tmp_path):
    """A sparse ZIP64 file with one record behind 5 GB of holes."""
    data = warc.record(7, "http://x", b"far away", base64.b32encode(hashlib.sha1(b"far away").digest()).decode(), None)
    part, hole = zlib.compress(data, wbits=31), 5 << 30
    line = ("x 20240101000000 " + '{"offset": %d, "length": %d, "filename": "data.warc.gz"}' % (hole, len(part)) + "\n").encode()
    path = tmp_path / "big.wacz"
    with open(path, "wb") as f:

        def local(name, size):
            at = f.tell()
            f.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, size))
            return at

        entries = []
        for name, size in ((warc.DATA.encode(), hole + len(part)), (warc.INDEX.encode(), len(line))):
            entries.append((name, size, local(name, size)))
            if name == warc.DATA.encode():
                f.seek(hole, 1)
                f.write(part)
            else:
                f.write(line)
        start = f.tell()
        for name, size, at in entries:
            f.write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, end = f.tell() - start, f.tell()
        f.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 2, 2, size, start) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        f.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    got = warc.read_package_files(spark, str(tmp_path)).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(7, b"far away")]


def test_zip64_directories_and_damage():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("archive/a"), "w", force_zip64=True) as f:
            f.write(b"hello world")
    data = buf.getvalue()
    at = data.rindex(b"PK\5\6")
    count, size, start = struct.unpack_from("<HII", data, at + 10)
    central = bytearray(data[start : start + size])
    n_name, n_extra = struct.unpack_from("<HH", central, 28)
    real = struct.unpack_from("<II", central, 20)
    struct.pack_into("<II", central, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<I", central, 42, 0xFFFFFFFF)
    extra = struct.pack("<HHQQQ", 1, 24, real[1], real[0], 0)
    struct.pack_into("<H", central, 30, len(extra))
    central = bytes(central[: 46 + n_name]) + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 7) + b"comment"
    z = warc.ZipDirectory(io.BytesIO(data[:start] + central + end64 + locator + end))
    assert z.read("archive/a", 6, 5) == b"world" and z.read("archive/a") == b"hello world"
    with pytest.raises(warc.ZipError):
        z.read("archive/a", 6, 50)
    with pytest.raises(warc.ZipError):
        warc.ZipDirectory(io.BytesIO(b"nothing"))


# ---- 9


def test_bpe_equals_tiktoken(spark, odd_texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = [*odd_texts, "<|endoftext|> it's 日本語 😀‍ x  \n\n y", "a" * 500, "".join(rng.choice("abcdefg") for _ in range(700)), " " * 300]
    df = docs(spark, texts).withColumn("ids", F.lit(1))
    for rows in (byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN), path).collect(), byte_bpe.encode_and_decode(df, path, P.PATTERN).collect()):
        assert {r["doc_id"]: r["ids"] for r in rows} == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
        assert {r["doc_id"]: bytes(r["decoded"]) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0), path, P.PATTERN), path).count() == 0


def test_bpe_of_white_space_of_every_kind(spark):
    """Words between single spaces take their ids from a memo; runs, edges and other white space don't upset it, nor does a memo that is always full."""
    import tiktoken

    path, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(3)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    known = byte_bpe.Pieces(path, P.PATTERN, memo_bytes=4000)
    space = [" "] * 12 + ["\n", "\n", "\n\n", "\n\n\n", "  ", "\t", " \n", "\n ", "\u00a0", "\u2003", "\x1c", "\x00", "\r\n", "\x85", ""]
    for _ in range(60):
        texts = ["".join(rng.choice(["it's", "don't", "Word", "x1y", "é", "日本", "12,5", "...", "\u0301", "ª", "_", "zyzzyva"]) + rng.choice(space) for _ in range(rng.randint(0, 14))) for _ in range(6)]
        texts += [rng.choice(space) + t for t in texts]
        ids = byte_bpe._lists(known.encode(texts))
        assert ids.to_pylist() == [ref.encode_ordinary(t) for t in texts], texts
        assert byte_bpe.decoded(known.con, ids).to_pylist() == [t.encode() for t in texts]


def test_bpe_of_long_pieces():
    """Many places a round: equal to tiktoken for pieces of every length and kind, and linear for runs of 100,000 letters."""
    import tiktoken

    path, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(9)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    known = byte_bpe.Pieces(path, P.PATTERN, long=3)
    plain = []
    contract = known._contract
    known._contract = lambda part, long=False: plain.extend(p for p, d in part if not long and len(d) > 3) or contract(part, long)
    words = "the of international information representative aaaa zzz understanding".split()
    makers = [
        lambda: "".join(rng.choice("abcdefg") for _ in range(60)), lambda: rng.choice("a=- #") * rng.randint(3, 200), lambda: "".join(rng.choice(words) for _ in range(8)), lambda: "".join(rng.choice("ab") for _ in range(50)),
        lambda: "".join(chr(rng.choice([0xE9, 0x4E00 + rng.randint(0, 99), 0x1F600])) for _ in range(20)), lambda: rng.choice(words)[: rng.randint(1, 5)] * rng.randint(2, 20), lambda: "".join(rng.choice("!?.,-=") * rng.randint(1, 5) for _ in range(15)),
    ]
    texts = [make() for make in makers for _ in range(80)]
    assert byte_bpe._lists(known.encode(texts)).to_pylist() == [ref.encode_ordinary(t) for t in texts]
    assert len(plain) < 0.02 * len(texts)
    known = byte_bpe.Pieces(path, P.PATTERN)
    known._contract = lambda part, long=False: contract(part, long) if long else pytest.fail("a long piece went through the plain query")
    contract = byte_bpe.Pieces._contract.__get__(known)
    for t in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "x" * 100_000):
        assert byte_bpe._lists(known.encode([t])).to_pylist() == [ref.encode_ordinary(t)]


def test_decoding_follows_the_order_of_the_ids(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = spark.createDataFrame([(1, [1026, 338]), (2, [338, 1026]), (3, []), (4, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(ids, path).collect()}
    of = {v: k for k, v in byte_bpe.read_ranks(path).items()}
    assert got == {1: of[1026] + of[338], 2: of[338] + of[1026], 3: b"", 4: b""}


# ---- 10


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_brute_force(spark, odd_texts):
    texts = [*odd_texts, "x y z\nx y z\n\nx y z \n#$%", "a b a b a b", "é b c", "one\ntwo\none"]
    rows = quality_rules.ledger(docs(spark, texts).withColumn("n_words", F.lit(0))).cache()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows.collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    mask = quality_rules.POLICIES["v2"]
    kept = quality_rules.apply_policy(rows, mask)
    assert kept.filter("kept").count() == rows.filter("fail_bits = 0").count() > 0
    alone = {r["rule"]: (r["failed"], r["failed_alone"]) for r in quality_rules.ablation(rows, mask).collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    assert alone["few_words"] == (sum(b & 1 for b in bits), sum(b == 1 for b in bits))
    carried = quality_rules.apply_policy(quality_rules.ledger(docs(spark, texts), carry=["doc_id", "text"]), mask).filter("kept").select("row.*")
    assert carried.columns == ["doc_id", "text"] and carried.count() == kept.filter("kept").count()
    assert quality_rules.ledger(docs(spark, [])).count() == 0
