"""Operators on documents, against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sparkwire.llm import common, decontam, langid, linededup, lm_score, packing, pii, simhash


def test_hash_words_are_of_words():
    text = "Ab  cd\tab\ncd é " + "y" * 300_000 + " ab"
    hashes, starts = common.hash_words(text.encode().lower())
    words = text.encode().lower().split()
    assert len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert [text.encode()[s : s + 1].lower() for s in starts] == [w[:1] for w in words]


def test_argsort_falls_back_on_collisions():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    x[1::2] = x[::2] ^ np.uint64(1)  # agree in all but the lowest bit
    assert (x[common.argsort(x)] == np.sort(x)).all()
    values, inverse = common.unique_inverse(x)
    assert (values[inverse] == x).all()


# ---- 1: language-model scores


def test_lm_score(docs, all_rows):
    got = defaultdict(list)
    for r in lm_score.score(docs).collect():
        got[r["doc_id"]].append(r)
    toks = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b" END"]) for i, t, _ in all_rows]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    counts = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, got.values())) == len(toks)
    for i, t in toks:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        match = [r for r in got[i] if r["n_tokens"] == len(t) and abs(r["base_score"] - base) <= 1e-6 * abs(base)]
        assert match, i
        r = match[0]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held(i), sum(counts[w] > 0 for w in t), n)
        assert math.isfinite(r["score"]) and r["score"] <= 0
    total = lambda c: sum(r[c] for rs in got.values() for r in rs)
    assert total("score") > total("base_score")


def test_lm_probabilities_sum_to_one():
    """With the totals of its own samples, a context's probabilities sum to one for every sample."""
    rng = np.random.default_rng(1)
    import pyarrow as pa

    words = rng.integers(1, 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    contexts = rng.integers(0, 5, 4000).astype(np.uint32)
    order = np.argsort(words, kind="stable")
    w, u = words[order], contexts[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    runs = np.diff(np.append(first, len(w))).astype(np.uint32)
    row = {"g": pa.array([0], pa.int32()), "batch": ["0.0"], "held": [False], "w": [lm_score.squeeze(np.diff(w[first], prepend=np.uint64(0)))], "n": [lm_score.squeeze(runs)], "u": [lm_score.squeeze(u)], "d": [lm_score.squeeze(np.zeros(4000, np.uint16))]}
    group = lm_score.Group(pa.table(row), np.zeros(0, np.uint64))
    setup = {"hot": {}, "contexts": np.bincount(contexts, minlength=1 << 17), "groups": 1, "train": 4000, "discounts": (0.7, 0.6)}

    def totals(before):
        out, slices = lm_score.Totals(), {}
        for r in lm_score.totals_rows(group, setup, before).to_pylist():
            x = lm_score.unsqueeze(r["blob"], np.int64)
            if r["kind"] == "context":
                slices[r["key"]] = x.reshape(-1, lm_score.SLICE)
            else:
                out.sums = x
        out.tables = np.concatenate([slices[k] for k in sorted(slices)], axis=1)
        return out

    before = totals(None)
    after = totals(before)
    types, d, d0 = len(group.words), 0.7, 0.6
    for s, t in enumerate(lm_score.seatings(group, setup, before)):
        assert (t[group.c > 0] >= 1).all() and (t <= group.c).all()
        root = after.root(s)
        parent = (group.tables_of_words(t) - d0) / (lm_score.ROOT_THETA + root)
        unseen = (lm_score.ROOT_THETA + d0 * types) / (lm_score.ROOT_THETA + root)
        assert parent.sum() + unseen == pytest.approx(1)
        for c in range(5):
            mine = group.u == c
            weight = lm_score.THETA + d * after.tables[s][c]
            p = parent * weight
            p[group.word[mine]] += group.c[mine] - d * t[mine]
            assert (p.sum() + weight * unseen) / (lm_score.THETA + setup["contexts"][c]) == pytest.approx(1)


def seated_one_by_one(docs, sweeps, burn, rng):
    """log10 scores of (held, words) by a hierarchical Pitman-Yor model whose customers are seated one at a time."""
    pairs, words = Counter(), Counter()
    for held, w in docs:
        if not held:
            pairs.update(zip(["START", *w[:-1]], w, strict=True))
            words.update(w)
    d = lm_score.discount(*(sum(c == k for c in pairs.values()) for k in (1, 2)))
    into = Counter(w for _, w in pairs)
    d0 = lm_score.discount(*(sum(c == k for c in into.values()) for k in (1, 2)))
    c_u, tables, t_u, t_w = Counter(), {p: [c] for p, c in pairs.items()}, Counter(), Counter()
    for (u, w), c in pairs.items():
        c_u[u] += c
        t_u[u] += 1
        t_w[w] += 1
    mean = [[0.0] * len(w) for _, w in docs]
    for k in range(sweeps):
        for (u, w), own in tables.items():
            for _ in range(pairs[u, w]):
                i = rng.choices(range(len(own)), own)[0]
                own[i] -= 1
                if not own[i]:
                    own.pop(i)
                    t_u[u] -= 1
                    t_w[w] -= 1
                parent = max(t_w[w] - d0, 0.01) / (lm_score.ROOT_THETA + sum(t_w.values()))
                weights = [x - d for x in own] + [(lm_score.THETA + d * t_u[u]) * parent]
                i = rng.choices(range(len(weights)), weights)[0]
                if i == len(own):
                    own.append(1)
                    t_u[u] += 1
                    t_w[w] += 1
                else:
                    own[i] += 1
        if k >= burn:
            root = sum(t_w.values())
            for m, (_, ws) in zip(mean, docs, strict=True):
                for j, (u, w) in enumerate(zip(["START", *ws[:-1]], ws, strict=True)):
                    parent = (t_w[w] - d0 if words[w] else lm_score.ROOT_THETA + d0 * len(words)) / (lm_score.ROOT_THETA + root)
                    own = tables.get((u, w), [])
                    m[j] += (sum(own) - d * len(own) + (lm_score.THETA + d * t_u[u]) * parent) / (lm_score.THETA + c_u[u]) / (sweeps - burn)
    return np.array([sum(map(math.log10, m)) for m in mean])


def test_lm_scores_are_those_of_a_plain_sampler(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    follow = {w: rng.sample(vocabulary, 4) for w in vocabulary}
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary)]
        while len(w) < 30:
            w.append(rng.choice(follow[w[-1]]) if w[-1] in follow and rng.random() < 0.9 else rng.choice([*vocabulary, f"new{rng.randrange(30)}"]))
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    want = seated_one_by_one([(lm_score.held_out(k), [*t.split(), "END"]) for k, t in enumerate(texts)], 14, 4, rng)
    mine = np.array([got[k]["score"] for k in range(60)])
    assert np.abs(mine - want).max() < 0.03 * np.abs(want).mean() and abs(mine.sum() / want.sum() - 1) < 0.01


def test_lm_sums_take_what_rows_have():
    """What is merged for a batch is as long as its documents, not as long as a batch may be."""
    rows = [lm_score._sums("0.0", np.array([5, 60000], np.uint16), np.ones(2), np.ones(2), np.full(2, 0.5)) for _ in range(300)]
    merged = lm_score._merge_sums([lm_score._sums_table(rows[:200]), lm_score._sums_table(rows[200:])]).to_pylist()
    assert len(merged) == 1 and len(merged[0]["d"]) == 4 and np.frombuffer(merged[0]["base"], np.float64).tolist() == [300.0, 300.0]
    docs, sums = lm_score._sums_of(merged)
    assert sums.shape == (3, 2) and docs.tolist() == [5, 60000]


def test_seating_follows_the_restaurant():
    """One pair of c customers: the tables' number has the law a^t S(c, t) of its Gibbs conditional."""
    c, d, a = 4, 0.5, 0.8
    stirling = {(1, 1): 1.0}
    for n in range(1, c):
        for t in range(1, n + 2):
            stirling[n + 1, t] = stirling.get((n, t - 1), 0) + (n - d * t) * stirling.get((n, t), 0)
    want = np.array([a**t * stirling[c, t] for t in range(1, c + 1)])
    seating = lm_score.Seating(np.full(3000, c), np.random.default_rng(0))
    seen = np.zeros(c)
    for k in range(40):
        seating.sweep(np.full(3000, a), d)
        if k >= 10:
            seen += np.bincount(seating.t - 1, minlength=c)
    assert np.abs(seen / seen.sum() - want / want.sum()).max() < 0.01


def test_lm_hot_words_are_split(spark, monkeypatch):
    """Lists of hot words and pairs change where tokens go, not what is counted."""
    monkeypatch.setattr(lm_score, "HOT", 50)
    monkeypatch.setattr(lm_score, "GROUP", 300)
    df = spark.createDataFrame([(i, "the cat the dog " * 20 + f"w{i} x{i % 3}") for i in range(60)], "doc_id long, text string").repartition(3)
    total, train, hot, _ = lm_score.survey(df, 16)
    assert len(hot) >= 3 and total == sum(len(("the cat the dog " * 20 + "a b").split()) + 1 for _ in range(60))
    got = lm_score.score(df).collect()
    n_train = sum(r["n_tokens"] for r in got if not r["held_out"])
    assert all(r["train_tokens"] == n_train == train for r in got)
    counts = Counter()
    for r in got:
        if not r["held_out"]:
            counts.update([*("the cat the dog " * 20 + f"w{r['doc_id']} x{r['doc_id'] % 3}").split(), None])
    for r in got:
        words = [*("the cat the dog " * 20 + f"w{r['doc_id']} x{r['doc_id'] % 3}").split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (train + 0.1 * (len(counts) + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-6) and r["score"] > base


# ---- 2: language


def test_language(docs, all_rows):
    got = [r for r in langid.digest(docs).collect()]
    assert len(got) == len(all_rows)
    lang = {i: x for i, _, x in all_rows if i is not None}
    for r in got:
        assert 0 <= r["score"] <= 1
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i if i is not None else "").encode()) % 4 == 2)
        if i in (130, 131, 132, 133):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif i is not None and i < 90:
            assert r["lang_pred"] == lang[i]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 90").count() == docs.where("doc_id < 90").count()


def test_language_backs_off_to_ngrams():
    model = langid.Model({"en": ["thing thing string thing string"] * 2, "de": ["schung schung schlich"] * 2})
    assert "nothing" not in model.words and model.predict("nothing")[0] == "en"
    assert model.predict("Verschlichung")[0] == "de"
    assert model.predict("12 34 !")[0] == "und" and langid.Model({}).predict("x") == ("und", 0.0)


# ---- 4: decontamination


def brute_contaminated(texts, items, least):
    words = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = {}
    for doc, text in texts:
        w = words(text)
        for item, t in items:
            b = bag(words(t))
            n = len(words(t))
            if not b:
                continue
            best = max((decontam.similarity(bag(w[s : s + n]), b) for s in range(max(1, len(w) - n + 1))), default=0)
            if best >= least:
                out[doc, item] = max(out.get((doc, item), 0), best)
    return out


def test_decontamination(spark, docs, all_rows):
    items = [(1, "The quick brown fox jumps over the lazy dog while eleven more words follow it here today"), (2, "one two three"), (3, None), (4, ""), (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"), (5, "a second text with the same number of words and so on")]
    clean = [(i, t) for i, t, _ in all_rows if i is not None and i < 50]
    long = " ".join(f"w{k}" for k in range(60))
    items.append((6, long))
    fox, greek = items[0][1], items[4][1]
    dirty = [(201, f"{clean[0][1]} {fox} {clean[1][1]}"), (202, fox.upper().replace(" ", "***  ")), (203, "noise before " + greek.replace("lambda", "changed") + " and after"), (204, greek.replace(" mu", "").replace("beta", "BETA")), (205, " ".join(greek.split()[:8])), (206, f"{fox} {fox}"), (207, greek.replace("pi", "pi inserted")), (208, "so it begins " + long.replace("w31", "other") + " and ends"), (209, long.replace("w31", "w31 more"))]
    texts = clean + dirty
    df = spark.createDataFrame([*texts, (None, fox), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contaminated(texts, items, decontam.SIMILARITY)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench).collect()}
    assert got.pop((None, 1)) == 1.0
    assert got == pytest.approx(want) and {d for d, _ in got} == {201, 202, 206, 208, 209}
    left = decontam.remove_contaminated(df, bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in texts if d not in {k for k, _ in want}} | {None}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    rng = np.random.default_rng(0)
    items = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, 20))) for k in range(7)]
    df = spark.createDataFrame([(k, "before it " + t) for k, t in items], "doc_id long, text string")
    got = decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, k) for k in range(7)]


def test_multi_index_misses_none():
    rng = np.random.default_rng(0)
    index = decontam.Index()
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for p in prints:
        index.add(p)
    for k in range(200):
        p = prints[k % 60]
        for b in rng.choice(64, k % (decontam.RADIUS + 1), replace=False):
            p ^= 1 << int(b)
        assert {i for i, _ in index.near(p)} == {i for i, q in enumerate(prints) if (p ^ q).bit_count() <= decontam.RADIUS}


# ---- 7: packing


def test_packing(docs, all_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, shard=40).collect()
    want = Counter()
    ids_of = {}
    for i, t, _ in all_rows:
        ids = np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want[i, len(ids)] += 1
        ids_of.setdefault((i, len(ids)), []).append(ids)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        covered = Counter()
        for r in pieces:
            covered.update(range(r["start"], r["start"] + r["length"]))
            assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in ids_of[key])
        assert covered == {k: want[key] for k in range(key[1])}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    full = sum(sum(n for _, n in s) == 1024 for s in sequences.values())
    assert len(sequences) - full <= -(-docs.count() // 40) + 1


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    texts = ["", None, "a  b\n\n c\t\td ", "I'll we've 12345 éàüß «x»", "日本語 🙂 текст", "x<|endoftext|>y", "\x00\x1f ​x", "'S 'LL", "   ", "a" * 5000, "€100…", "½ ² x²", "a\r\nb"]
    for t in texts:
        assert encoder(t).tolist() == slow.encode(t or "", add_special_tokens=False).ids + [0], t


def test_bm25_prefers_lexical_neighbours():
    tails = [np.array(x, np.uint16) for x in ([1, 2, 3, 4] * 20, [9, 8, 7] * 20, [1, 2, 3, 5] * 20, [9, 8, 6] * 20)]
    assert [sorted(t for t, _, _ in s) for s in packing.Shard(tails).pack(160)[:1]] == [[0, 2]]
    assert packing.Shard([]).pack() == []


def test_bm25_scores_every_term_of_a_seed():
    """Seeds share over a hundred terms with other tails; scores are those of the formula, summed over all of them."""
    rng = np.random.default_rng(8)
    tails = [np.minimum(rng.zipf(1.3, rng.integers(150, 700)), 3000).astype(np.uint16) for _ in range(60)]
    shard, n = packing.Shard(tails), len(tails)
    counts, mean = [Counter(t.tolist()) for t in tails], sum(map(len, tails)) / n
    df = Counter(x for c in counts for x in c)
    for seed in range(0, n, 7):
        want = [0.0] * n
        for x in counts[seed]:
            for d in range(n):
                if counts[d][x] and df[x] > 1:
                    idf = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5))
                    want[d] += idf * counts[d][x] * (packing.K1 + 1) / (counts[d][x] + packing.K1 * (1 - packing.B + packing.B * len(tails[d]) / mean))
        np.testing.assert_allclose(shard.scores(tails[seed]), want, rtol=1e-9)
    assert packing.Shard([np.array([1], np.uint16), np.array([2], np.uint16)]).scores(np.array([1])).tolist() == [0, 0]


# ---- 8: SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (doc_id, fp); component ids by row."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for k in range(len(fps)):
        least[find(k)].append(fps[k][0])
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(fps))]


def test_simhash(docs, all_rows):
    fps = [(i, plain_fingerprint(t)) for i, t, _ in all_rows]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps), strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c for c in brute_components(fps)})


def test_keep_one_chooses_rows(spark):
    """Rows without an id, and rows of one id with different texts, are rows of their own."""
    a, b, c, d = (" ".join(f"{x}{k * k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (7, c), (7, d), (None, d), (9, c), (None, b)]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, a), (None, b), (7, c), (7, d)])


def test_near_copies_are_all_found(spark):
    """Edited copies at similarities around 0.8, a chain, short and wordless texts, against all pairs."""
    import random

    rng = random.Random(11)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(6, 150))]
        for _ in range(6):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    rows += [" ".join(["all", "share", "this", "first", "phrase", *[f"q{k}{j}" for j in range(20)]]) for k in range(40)]
    rows += [None, "", " \n", "one", "ONE", "two words", "two words", "a b c d", "a b c d e", "a b c d e f"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(rows)]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append((i is None, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df, similarity=0.8)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min(g)[1] for g in groups.values())
    assert 60 < len(groups) < 110
    assert simhash.keep_one(df.limit(0), similarity=0.8).count() == 0


def test_simhash_links_chains_and_balls(spark):
    """A chain of steps of two bits, a ball around one point, the sign bit, and far ones."""
    chain = [sum(3 << 2 * k for k in range(n)) for n in range(12)]
    ball = [(1 << 63) | (1 << b) | 0x5555000000000000 >> 1 for b in range(0, 40, 3)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in chain + ball})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    from sparkwire.llm.graph import components

    got = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    want = brute_components([(v, v & (1 << 64) - 1) for v in values])
    assert {v: got.get(v, v) for v in values} == dict(zip(values, want, strict=True))


def test_components_of_random_graphs(spark):
    import random

    from sparkwire.llm.graph import components

    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 330)] + [(400, k) for k in range(401, 440)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- 9: personal data


def test_pii_found_and_replaced():
    text = 'Mail a.b-1@mail.example.com, call +1 (407) 555-7710, host 106.158.249.239, card 4111 1111 1111 1111, id 4111111111111112, token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6", ssn 078-05-1120, IBAN DE89 3704 0044 0532 0130 00. Mr. John Smith met Frau Анна and Frau Julia Meier; v1.2.3.4.5 999.1.1.1'
    kinds = Counter(k for _, _, k, _ in pii.find(text))
    assert kinds == Counter(email=1, phone=1, ip=1, card=1, secret=1, ssn=1, iban=1, person=3)
    own = pii.Surrogates(b"key")
    new = {k: own.of(k, text[s:e], g) for s, e, k, g in pii.find(text)}
    assert re.fullmatch(r"[a-z]\.[a-z]-\d@[a-z]{4}\.[a-z]{7}\.com", new["email"])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["phone"]) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", new["card"]) and pii.luhn(re.sub(" ", "", new["card"]))
    assert re.fullmatch(r"[0-9a-f]{40}", new["secret"]) and pii._iban_ok(new["iban"]) and new["iban"].startswith("DE")
    (replaced, found), = pii._scan([text], own)
    assert all(old not in replaced for _, old, _ in found) and "4111111111111112" in replaced and "v1.2.3.4.5" in replaced


def test_pii_names_match_gender_and_script():
    own = pii.Surrogates(b"key")
    for group, names in pii.NAMES.items():
        new = [own.of("person", n, "") for n in names]
        assert sorted(new) == sorted(names) and all(a != b for a, b in zip(new, names, strict=True)), group
    other = own.of("person", "Zorblatt", "m")
    assert other not in pii._GENDER and [c in "aeiou" for c in other.lower()] == [c in "aeiou" for c in "zorblatt"] and other[0].isupper()
    for name in ("Dagobert Klein", "Hedwiga Klein", "Степан Клинов", "Ульяна Клинова"):  # the endings that tell a gender stay
        first, last = own.of("person", name, "").split()
        assert first[-1] == name.split()[0][-1] and last == own.of("person", name.split()[1], "") and len(first) == len(name.split()[0])
    assert own.of("person", "Klinowa", "")[-1] == "a" and own.of("person", "Клинова", "").endswith("ва")


#: Texts, and the words of each that must not be left.
HARD = [
    ("Mr. O'Neill came; O'Neill sat. Ms. O’Brien-Smith left.", ["Neill", "Brien", "Smith"]),
    ("Sr. D'Angelo y Señora de la Fuente", ["Angelo", "Fuente"]),
    ("Herr van Dyke kam, Dyke ging. Frau von der Leyen blieb.", ["Dyke", "Leyen"]),
    ("Mr. LI spoke, and Li left. MS. Ms. WEBER, Weber.", ["LI", "Li", "WEBER", "Weber"]),
    ("Mrs. MacDonald spoke. MacDonald left with Dr. McKay and Mr DiCaprio.", ["MacDonald", "Donald", "McKay", "DiCaprio"]),
    ("Walter Schmidt, Heike Braun", ["Walter", "Schmidt", "Heike", "Braun"]),
    ("Then Mr Walter and Frau Heike left", ["Walter", "Heike"]),
    ("Herr Prof. Dr. Müller-Lüdenscheidt, née Çelik? Frau Çelik.", ["Müller", "Lüdenscheidt", "Çelik"]),
    ("J. Smith met Mr. J. R. Smith and Dr. Maria de la Luz", ["Smith", "Maria", "Luz"]),
    ("Ahmed Khan said so; later Priya Patel, Ahmed Khan and Wei Chen met", ["Ahmed", "Khan", "Priya", "Patel", "Wei", "Chen"]),
    ("Contact: Tomasz Wójcik, 34", ["Tomasz", "Wójcik"]),
    ("write to lena.fischer@web.de, that is Lena Fischer", ["lena", "fischer", "Lena", "Fischer"]),
    ("it was Goran Petrov, 41, they knew. Petrov slept.", ["Goran", "Petrov"]),
    ("Госпожа Иванова и господин Иванов; Ульяна Клин сказала", ["Иванова", "Иванов", "Ульяна", "Клин"]),
    ("Mr. Smith's dog. SMITH barked at Jean-Pierre Dupont and Mr. al-Sayed", ["Smith", "SMITH", "Jean", "Pierre", "Dupont", "Sayed"]),
]


def test_pii_hard_names():
    for key in (b"key", b"other"):
        own = pii.Surrogates(key)
        for text, names in HARD:
            new = next(pii._scan([text], own))[0]
            assert not set(names) & set(re.findall(r"[^\W\d_]+", new)), (text, new)
            assert [len(w) for w in re.findall(r"\S+", new) if not w[0].isalpha()] == [len(w) for w in re.findall(r"\S+", text) if not w[0].isalpha()]
    new = next(pii._scan([HARD[0][0]], pii.Surrogates(b"key")))[0]
    assert len(set(re.findall(r"O'\w+", new))) == 1 and "O’" in new and new.startswith("Mr. O'")
    for clean in ("New York said no.", "Paula Street is long", "under the Apache License, Version 2, they", "the North Sea, the Baltic Sea", "Great Britain and Northern Ireland", "the Red Cross came", "Paul.", "Dr. The"):
        assert next(pii._scan([clean], pii.Surrogates(b"key")))[0] == clean


def test_pii_nothing_is_its_own_surrogate():
    own = pii.Surrogates(b"key")
    for low, high in ((1, 21), (3, 5), (10, 100)):
        step = [own.number(v, low, high, "t") for v in range(low * high)]
        assert sorted(step) == list(range(low * high))
        at, seen = 0, 0
        while (at := step[at]) != 0:
            seen += 1
        assert seen == low * high - 1  # one cycle through all
    short = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    for names in (short, [n + "e" for n in short], [n.upper() for n in short], ["Mc" + n for n in short]):
        new = [own.of("person", n, "") for n in names]
        assert len(set(new)) == len(names) and all(x != y for x, y in zip(names, new, strict=True))
    for head in ("10.", "127.", "192.168.", "172.20."):
        old = [head + ".".join(str((k >> s) & 255) for s in range(8 * (3 - head.count(".")), -8, -8)) for k in range(200)]
        new = [own.of("ip", x, "") for x in old]
        assert len(set(new)) == 200 and not any(x == y for x, y in zip(old, new, strict=True)) and all(x.startswith(head[:4] if head == "172.20." else head) for x in new)


def test_pii_mentions_of_one_person_agree():
    own = pii.Surrogates(b"key")
    text = "Mr. John Smith came. Smith sat, John stood; Mr Smith left. Anna Weber saw Heike? Frau Heike Braun did, and Heike slept. Paul."
    (new, found), = pii._scan([text], own)
    words = dict(zip(re.findall(r"\w+", text), re.findall(r"\w+", new), strict=True))
    assert len(words) == len(set(words.values())) and Counter(re.findall(r"\w+", new)) == Counter(words[w] for w in re.findall(r"\w+", text))
    assert {w for w in words if words[w] != w} == {"John", "Smith", "Anna", "Weber", "Heike", "Braun"}
    assert pii._GENDER[words["John"]] == ("latin", "m")


def test_pii_is_what_its_parts_give():
    """Texts with surrogates against a plain loop over the entities, and entities of compressed addresses."""
    own, rng = pii.Surrogates(b"key"), random.Random(2)
    parts = ["a.b@c.example.com", "10.1.2.3", "fe80::1", "2001:db8::ff00:42:8329", "4111 1111 1111 1111", "Mr. John Smith", "std::vector", "a::b", "plain words", "no :: one"]
    for _ in range(50):
        text = ", ".join(rng.choice(parts) for _ in range(6))
        want = text
        for s, e, kind, gender in reversed(pii.find(text)):
            want = want[:s] + own.of(kind, text[s:e], gender) + want[e:]
        assert next(pii._scan([text], own))[0] == want
        left = [x for x in ("std::vector", "a::b", "plain words", "no :: one") if x in text]
        assert all(x in want for x in left)
        assert all(x not in want for x in parts[:6] if x in text)


def test_pii_surrogates_are_one_to_one():
    own = pii.Surrogates(b"key")
    for kind, values in {
        "email": [f"{a}.{b}@mail{c}.example.com" for a in ("er", "by", "ly") for b in range(100) for c in range(10)],
        "ip": [f"{a}.{b}.7.9" for a in range(1, 60) for b in range(40)],
        "card": [x for k in range(4000) if pii.luhn(x := f"4{k:015d}")],
        "secret": [hashlib.md5(str(k).encode()).hexdigest() for k in range(500)],
        "phone": [f"+1 ({k:03d}) 555-0271" for k in range(1000)],
        "person": [f"{n} {s}" for n in pii.NAMES["latin", "f"] for s in ("Meier", "Weber", "Huber")],
    }.items():
        assert len({own.of(kind, v, "") for v in values}) == len(set(values)), kind
    assert [own.of("ip", "10.0.0.7", "").split(".")[0]] and all(own.of("ip", f"10.0.0.{k}", "").split(".")[0] in ("10", "127", "172", "192") for k in range(20))


def test_pii_over_documents(spark, docs, all_rows):
    df = spark.createDataFrame([(1, "x a@b.example.com y"), (2, "a@b.example.com"), (3, None), (4, ""), (None, "+1 (407) 555-7710"), (1, "x a@b.example.com y")], "doc_id long, text string")
    spark.conf.set(pii.KEY_SETTING, b"key".hex())
    got = pii.digest(df).collect()
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.digest(df).where("doc_id = 2").first()["text"] not in (got[1]["text"], "a@b.example.com")  # without one, a run's own key
    mail = pii.Surrogates(b"key").of("email", "a@b.example.com", "")
    assert Counter((r["doc_id"], r["text"], r["n_email"]) for r in got if r["n_phone"] == 0) == Counter([(1, f"x {mail} y", 1), (1, f"x {mail} y", 1), (2, mail, 1), (3, None, 0), (4, "", 0)])
    assert pii.collisions(df, b"key") == 0
    same = {(r["doc_id"], r["text"]) for r in pii.replace(docs, b"key").collect()}
    assert same == {(i, t) for i, t, _ in all_rows}


# ---- 10: lines


def brute_lines(rows, chars=20, least=3):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    seen = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= chars:
                seen[strip(line)].add(-1 if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(s := seen[strip(x)]) >= least and max(s) != (-1 if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 19, 64])
def test_lines(docs, all_rows, bits):
    """A filter that is too small only makes more suspects."""
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.digest(docs, bits=bits).collect())
    assert got == brute_lines(all_rows)


def test_lines_keep_other_columns(docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert out.where("doc_id = 130").first()["text"] is None


# ---- empty tables


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for out in (lm_score.score(no_docs), langid.digest(no_docs), decontam.contaminated(no_docs, bench), packing.pack(no_docs), simhash.near_duplicates(no_docs), pii.digest(no_docs), linededup.digest(no_docs), simhash.keep_one(no_docs), langid.keep_identified(no_docs)):
        assert out.count() == 0
