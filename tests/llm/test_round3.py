"""Repair of conversations, language-model scores and hard negatives against brute force, on small fixtures with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C
from tidemark.llm import hard_negatives as H
from tidemark.llm import language_model as L

# ---- 11


def plain_repair(rows):
    """Cheapest, ASCII-least edits of letters by trying all edits of each row from each state, one row after the other."""
    best = {0: (0, "")}
    for c in rows:
        after = {}
        for q, (cost, audit) in best.items():
            for inserted in range(3):
                state = q
                for _ in range(inserted):
                    state = C.DUE[state]
                ways = [("D", 4, state)]
                if c != "d":
                    late = 3 if c.isupper() else 0
                    ways += [("K", late, C.KEPT[c.lower()][state])] if state in C.KEPT[c.lower()] else []
                    ways.append(("R", 3 + late, C.DUE[state]))
                for op, price, to in ways:
                    new = (cost + 3 * inserted + price, audit + "I" * inserted + op)
                    after[to] = min(after.get(to, new), new)
        best = after
    return min((cost + C.ENDING[q][0], audit + C.ENDING[q][1]) for q, (cost, audit) in best.items())


def test_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(1)
    for n in range(45):
        for _ in range(60 if n < 20 else 8):
            rows = "".join(rng.choice("uuuaaaasxdUAuaXS") for _ in range(n))
            want = plain_repair(rows)
            assert C.cheapest(rows) == want
            costs, edits = C.matrix(rows)
            assert min((costs[0][q] + C.ENDING[q][0], edits[0][q] + C.ENDING[q][1]) for q in C.STATES) == want


def test_search_finds_what_trying_all_edits_finds():
    def every(rows, i, state, cost, audit, left):
        if i == len(rows) and not C.ENDING[state][0]:
            yield cost, audit
        if left:
            yield from every(rows, i, C.DUE[state], cost + 3, audit + "I", left - 1)
        if i < len(rows):
            c, late = rows[i], 3 if rows[i].isupper() else 0
            yield from every(rows, i + 1, state, cost + 4, audit + "D", left)
            if c != "d":
                yield from every(rows, i + 1, C.DUE[state], cost + 3 + late, audit + "R", left)
                if state in C.KEPT[c.lower()]:
                    yield from every(rows, i + 1, C.KEPT[c.lower()][state], cost + late, audit + "K", left)

    rng = random.Random(2)
    for _ in range(150):
        rows = "".join(rng.choice("uasxdUA") for _ in range(rng.randint(0, 5)))
        assert C.cheapest(rows) == min(every(rows, 0, 0, 0, "", 4))


def test_heuristic_never_asks_too_much():
    rng = random.Random(3)
    for _ in range(400):
        rows = "".join(rng.choice("uasxdUAXS") for _ in range(rng.randint(0, 9)))
        for a in C.STATES:
            cost = min(C.search(rows, a, b)[0] + C.ENDING[b][0] for b in C.STATES)
            assert C.estimate(rows)[0] <= cost


def plain_conversations(rows):
    """The contract on one machine."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, letters, n = set(), "", Counter()
        for _, role, text in got:
            core = text.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            n[kind] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            letters += "d" if kind in ("blank", "duplicate") else c.upper() if kind else c
        cost, audit = plain_repair(letters)
        turns = {t for t, _, _ in got if t is not None}
        initials = [r[:1] for _, r, _ in got]
        broken = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        made = "\n".join(C.repaired([(r, x) for _, r, x in got], audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], broken, cost, audit, hashlib.sha256(made.encode()).hexdigest())
    return out


def odd_conversations():
    rng = random.Random(4)
    rows = []
    for k in range(900):  # one long conversation with ties, repeats and nulls
        role, text = rng.choice(["user", "assistant", "user", "tool", None, "system", ""]), rng.choice(["Hi.", "a b c", "Long text. ", "", "same.", None, "é!\n"])
        rows.append((7, None if k % 50 == 0 else k // 2, role, text if text is None or rng.random() < 0.5 else f"{text}{k}."))
    rows += [(7, 3, "user", "same.")] * 700
    for c in range(80):
        rows += [(100 + c, t, rng.choice(["user", "assistant", "system"]), f"t {c} {t}" + rng.choice([".", "?", ""])) for t in range(rng.randint(1, 6))]
    return [*rows, (None, None, None, None), (None, 0, "user", "x y."), (None, 1, "", "z."), (5, 2**40, "user", "long " * 300_000 + "."), (5, -(2**40), "user", "q.")]


def test_conversations_against_plain_repair(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(df)).collect()}
    assert got == plain_conversations(rows)


def test_conversations_do_not_depend_on_how_they_are_cut(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(C, "CHUNK", 7)
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damaged(df)).collect()}
    assert got == plain_conversations(rows)
    assert C.repair(C.damaged(df.limit(0))).count() == 0


# ---- 12


TEXTS = [None, "", " \n", "one", "One TWO one", "a\x0bb é İx ẞ", "the cat " * 900, "x" * 5000, "<|endoftext|> hi <|x", *["the dog sat on the mat and the cat ran"] * 30]


def plain_counts(rows):
    words = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for i, t in rows}
    counts = Counter(w for i, _ in rows if not L.held_out(i) for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    return {i: (L.held_out(i), len(words[i]) + 1, sum(counts[w] > 0 for w in [*words[i], None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words[i], None])) for i, _ in rows}


def test_counts_and_base_against_plain_counts(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, block string").repartition(3)
    for block_bytes in (1 << 20, 200):
        got = {r["doc_id"]: r for r in L.score_documents(df, P.path("word_bpe_49k.json"), block_bytes, rounds=1).collect()}
        for i, (held, n, known, train, base) in plain_counts(rows).items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train) and math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert math.isfinite(r["score"]) and r["score"] < 0
    assert L.score_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    w = (L.start_weights(seed) + rng.normal(0, 0.2, len(L.start_weights()))).astype(np.float32)
    return L.Attention(w, np.log(rng.dirichlet(np.ones(L.CLASSES), L.CLASSES)).astype(np.float32))


def test_windows_score_each_token_once_as_one_by_one():
    model, rng = small_model(), np.random.default_rng(2)
    sizes = np.array([1, 2, 15, 16, 17, 33, 100])
    ids = np.concatenate([np.append(0, rng.integers(1, 200, n - 1)) for n in sizes] + [[0]])
    classes, inside = ids % L.CLASSES, np.log(rng.random(256))
    got = L.score_texts(model, ids, classes, sizes, inside, batch=3)
    p, at = model.p, 0
    for text, n in enumerate(sizes):
        total = 0.0
        for i in range(n):
            window = i // L.SPAN * L.SPAN - L.SPAN
            look = range(max(window, 0), i + 1)
            own, keys = classes[at + i], [classes[at + j] for j in look]
            e = p["embed"].astype(float)
            s = np.exp([(e[own] @ p["query"]) @ (e[k] @ p["key"]) / math.sqrt(L.WIDTH) + p["near"][i - j] for j, k in zip(look, keys, strict=True)])
            x = (s / s.sum()) @ (e[keys] @ p["value"]) + e[own]
            y = x + np.maximum(x @ p["up"] + p["bias"], 0) @ p["down"]
            z = model.base[own] + y @ p["out"]
            target = at + i + 1
            total += z[classes[target]] - np.log(np.exp(z).sum()) + inside[ids[target]]
        assert math.isclose(got[text], total, rel_tol=1e-4)
        at += n


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    model = small_model()
    keys, target = rng.integers(0, L.CLASSES, (4, 2 * L.SPAN)), rng.integers(0, L.CLASSES, (4, L.SPAN))
    keys[0, :20], keys[1, 25:], target[0, :4], target[1, 9:] = L.PAD, L.PAD, L.PAD, L.PAD

    def loss(flat):
        return -L.Attention(flat, base).of(keys, target).sum() / (target != L.PAD).sum()

    base = model.base[:-1].astype(float)
    flat = model.flat.astype(float)
    m = L.Attention(flat, base)
    g = m.gradient(*m.forward(keys), target)
    at = 0
    for k, s in L.shapes().items():
        for i in rng.choice(math.prod(s), 6):
            d = np.zeros(len(flat))
            d[at + i] = 1e-5
            assert math.isclose(g[at + i], (loss(flat + d) - loss(flat - d)) / 2e-5, rel_tol=2e-2, abs_tol=2e-6), k
        at += math.prod(s)


def test_neighbours_are_those_of_the_texts():
    rng = np.random.default_rng(8)
    lengths = np.array([0, 1, 3, 0, 2, 1])
    r = {"doc_ids": list(range(40)), "sizes": (sizes := rng.integers(0, 6, 40)).astype("<i4").tobytes(), "places": rng.integers(1, 6, sizes.sum()).astype("<i4").tobytes(), "ids": rng.integers(0, 30, 7).astype("<u2").tobytes(), "lengths": lengths.astype("<u2").tobytes()}
    b, classes = L.Block(r), rng.integers(0, L.CLASSES, 31)
    _, seq, n = b.texts(classes)
    known, want = np.repeat(~b.held, n), np.zeros(L.CLASSES**2)
    np.add.at(want, (seq[:-1] * L.CLASSES + seq[1:])[known], 1)
    assert b.held.any() and np.array_equal(L.neighbour_counts(b, classes), want)


def test_probabilities_add_up():
    counts = np.random.default_rng(5).integers(0, 50, 1000) ** 2
    classes, inside = L.grouped(counts)
    assert np.allclose(np.bincount(classes, np.exp(inside), L.CLASSES), 1)
    assert np.allclose(np.exp(L.neighbours(np.random.default_rng(6).integers(0, 9, (L.CLASSES, L.CLASSES)))).sum(1), 1, atol=1e-3)


def test_model_learns_what_is_far(spark):
    """A text's first word tells all others, ever so many neighbours apart: held-out texts score better after training than by counts of neighbours."""
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        a, b = rng.choice([("red", "apple"), ("blue", "whale")])
        texts.append(" ".join(rng.choice([a, b, "and"]) if k % 2 else "the" for k in range(120)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path = P.path("word_bpe_49k.json")
    mean = lambda rounds: L.score_documents(df, path, rounds=rounds, every=1).filter("held_out").agg(F.avg(F.col("score") / F.col("n_tokens")).alias("m")).first()["m"]
    assert mean(2) > mean(0) + 0.02


# ---- 13


def plain_negatives(rows, every=5):
    v = [(i, [math.floor(256 * c) if abs(c) < 2.0**52 else 256 * int(c) for c in x], label) for i, x, label in rows]
    clip = lambda s: min(max(s, H.LONG_MIN), H.LONG_MAX)
    out = []
    for n, (i, x, label) in enumerate(v):
        if i % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), j, m, other) for m, (j, y, other) in enumerate(v) if m != n]
        for s in sorted(s for s in scores if s[3] == label)[:5]:
            fits = sorted(q for q in scores if q[3] != label and 50 * -s[0] <= 100 * -q[0] <= 95 * -s[0])[:3]
            out += [(i, s[1], k + 1, q[1], clip(-s[0]), clip(-q[0])) for k, q in enumerate(fits)]
    return sorted(out)


def odd_vectors():
    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [a + rng.gauss(0, 0.15) for a in rng.choice(middles)][: rng.choice([8, 8, 8, 5])], rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, [0.5] * 8, i % 2) for i in range(60)] + [(600, [0.0] * 8, 0), (605, [0.0] * 8, 1), (610, [], 1), (5, [0.3] * 8, 1), (5, [0.3] * 8, 1)]
    return rows + [(700 + i * 5, [rng.gauss(0, 1) * 10 ** rng.choice([6, 12, 300]) for _ in range(8)], rng.randrange(2)) for i in range(8)]


def test_negatives_against_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, x array<double>, label long").repartition(3)
    want = plain_negatives(rows)
    assert want and sorted(map(tuple, H.mine(df, "vec_id % 5 = 0", block_rows=16, batch_anchors=20, clusters=6).collect())) == want
    assert sorted(map(tuple, H.mine(df, "vec_id % 5 = 0").collect())) == want
    assert H.mine(df.limit(0), "vec_id % 5 = 0").count() == 0


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0], 1), (7, [1.0], 9), (8, [1.0], None), (9, None, 1), (10, [None], 1), (11, [math.inf], 1), (12, [math.nan], 1), (None, [1.0], 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, label int, row string")
    assert sorted((r["vec_id"], r["label"]) for r in H.labelled(df).collect()) == [(0, 2), (7, 0)]


@pytest.mark.parametrize("spread", [0.02, 0.5])
def test_walks_stop_when_nothing_further_can_matter(spread):
    """In narrow clusters most candidates are never looked at; whatever is left out, results are those of looking at all."""
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 1, (8, 16))
    q = np.floor(256 * (middles[rng.integers(0, 8, 4000)] + rng.normal(0, spread, (4000, 16))))
    anchors = np.arange(0, 4000, 100)
    at = H.centres(q[anchors], 8)
    angles, _ = H._angles(q[anchors], at)
    own, radius = angles.argmin(1), np.zeros(len(at))
    np.maximum.at(radius, own, angles.min(1) + 1e-6)
    far, size = H._angles(q, at)
    reach = size[:, None] * np.minimum(1, np.cos(np.clip(far - radius[None], 0, math.pi)) + 1e-7)
    order = np.argsort(-reach, axis=0, kind="stable")
    labels = rng.integers(0, 3, 4000)
    block = {"x": q, "ids": np.arange(4000), "rows": np.arange(4000), "labels": labels, "orders": order.T, "bounds": np.take_along_axis(reach, order, 0).T}
    looked = 0
    for c in range(len(at)):
        m = anchors[own == c]
        free = np.full((len(m), 1), np.inf)
        group = H.Anchors(q[m], size[m], labels[m], m, -free, free, H.Best(len(m), 5), True)
        group.walk(block, c, step=64)
        looked += group.seen
        for n, i in enumerate(m):
            want = sorted((-float(q[i] @ q[j]), j) for j in np.flatnonzero(labels == labels[i]) if j != i)[:5]
            assert [(-s, j) for s, j in zip(group.best.score[group.best.slot == n], group.best.id[group.best.slot == n], strict=True)] == want
    if spread < 0.1:
        assert looked < 0.4 * 4000 * len(anchors)


def test_attention_learns_from_every_training_text():
    assert {L.turn_of(d, L.ROUNDS * L.EVERY) for d in [None, *range(2000)]} == set(range(L.ROUNDS))


def test_words_that_cannot_tell_are_not_restored_and_the_others_read_as_before(monkeypatch):
    from tidemark.llm import toxicity as T

    rng = np.random.default_rng(5)
    model = np.log(rng.dirichlet(np.ones(T.SIZE), (T.SIZE, T.SIZE))).astype(np.float32)
    wanted = {x: k for k, x in enumerate(["idiot", "idio*", "loo*", "lo", "fool*", "all", "ißé*"])}
    signs = list("idotlofaée0134!|*$.-_ (ß") + ["ll", "oo"]
    words = ["".join(rng.choice(signs, rng.integers(1, 9))).replace(" ", "-") for _ in range(3000)] + ["1d!0t", "(i.d.i.o.t)", "f00l", "fo-ol!", "idiot!!", "looool", "LOO*", "all", "a11"]
    gated, plain = T.Restorer(model, wanted), T.Restorer(model, wanted)
    monkeypatch.setattr(plain, "telling", lambda low: True, raising=False)
    assert [gated.of_word(w) for w in words] == [plain.of_word(w) for w in words]
    assert sum(map(bool, map(gated.of_word, words))) > 20
    read = []
    monkeypatch.setattr(T, "restore", lambda word, model: read.append(word) or word)
    for w in ("balloon", "committee", "b0ttom", "se77er"):
        T.Restorer(model, {"idiot": 0, "fool*": 1}).of_word(w)
    assert read == []


def test_the_gradient_of_training_by_one_exponential_equals_that_of_log_probabilities():
    from tidemark.llm import language_model as L

    rng = np.random.default_rng(6)
    m = L.Attention(L.start_weights().astype(float) + rng.normal(0, 0.1, len(L.start_weights())), rng.normal(size=(L.CLASSES, L.CLASSES)))
    keys, target = rng.integers(0, L.CLASSES + 1, (9, 2 * L.SPAN)), rng.integers(0, L.CLASSES + 1, (9, L.SPAN))
    keys[:, L.SPAN :] = np.minimum(keys[:, L.SPAN :], L.CLASSES - 1)
    want = m.gradient(*m.forward(keys), target)
    assert np.abs(want).max() > 1e-3 and m.learn(keys, target) == pytest.approx(want, abs=1e-12)


def test_words_of_all_blocks_are_counted_and_cut_into_subwords_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(L, "FREQUENT", 5)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioßkln.,") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [None, "", " \n ", *[rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(60)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["doc_id", "text", "row"])
    blocks = list(L._blocks(3000)(iter([batch])))
    dealt = [d for b in blocks for d in L._dealt(7)(iter([b.select(["block", "words", "counts"])]))]
    assert len(blocks) > 3 and len(dealt) == len(blocks)
    cut, learn = [], L.WordIds.learn
    monkeypatch.setattr(L.WordIds, "learn", lambda self, words: cut.extend(words) or learn(self, words))
    table = pa.Table.from_batches(dealt)
    answers = [r for part in range(7) for r in L._looked_up(path)(table.filter(pa.compute.equal(table["part"], part))).to_pylist()]
    words = [(t or "").split() for t in texts]
    assert sorted(w.decode() for w in cut) == sorted({"", *[w for t in words for w in t]})
    counts = Counter(w for i, t in enumerate(words) if not L.held_out(i) for w in [*t, ""])
    assert sum(r["distinct"] for r in answers) == len(counts)
    whole = Tokenizer.from_file(path)
    size, seen = L._vocabulary(path) + 1, 0
    for b in blocks:
        mine = [[r for r in answers if r["block"] == b.column("block")[0].as_py()]]
        rng.shuffle(mine[0])
        row = pa.RecordBatch.from_arrays([*b.columns, pa.array(mine)], [*b.schema.names, "parts"])
        (made,) = [r for g in L._gathered(iter([row])) for r in g.to_pylist()]
        block, known = L.Block(L._opened(made)), L._unpacked(made["known"])
        ids, _, n = block.texts(np.arange(size) % L.CLASSES)
        assert known[0] == counts[""]
        for at, size_, end, m in zip(np.cumsum(block.sizes) - block.sizes, block.sizes, np.cumsum(n), n, strict=True):
            assert ids[end - m + 1 : end].tolist() == whole.encode(texts[seen] or "", add_special_tokens=False).ids
            assert known[block.places[at : at + size_]].tolist() == [counts[w] for w in words[seen]]
            seen += 1
    assert seen == len(texts)


@pytest.mark.parametrize("most", [0, 255, 256, 70_000, 1 << 40])
def test_packed_numbers_come_back(most):
    for n in (0, 1, 1000):
        values = np.random.default_rng(n).integers(0, most + 1, n)
        assert L._unpacked(L._packed(values)).tolist() == values.tolist()
