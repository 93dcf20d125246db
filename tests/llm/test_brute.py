"""Operators and the pipeline against plain loops over small tables with awkward rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from sparkwire.llm import ann, common, jaccard, langid, linededup, lm_score, packing, pii, simhash, urlfilter


def spoken(rng, n, stem):
    return " ".join(f"{stem}{rng.choice('aeiou')}{rng.choice('rstln')}{rng.choice('aeiou')}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(k, spoken(rng, rng.randint(30, 60), "w" if k % 2 else "z"), "en" if k % 2 else "xx") for k in range(60)]
    line = "a line that several documents have in common"
    base = spoken(rng, 60, "w").split()
    out += [(100 + k, " ".join([*base[:k], f"other{k}", *base[k + 1 :]]), "en") for k in range(0, 60, 12)]
    out += [(200 + k, f"{spoken(rng, 30, 'w')}\n  {line.upper() if k % 2 else line} \n{spoken(rng, 9, 'w')}", "en") for k in range(5)]
    out += [(None, spoken(rng, 40, "w"), "en"), (None, spoken(rng, 40, "z"), "xx"), (None, f"{line}\n{spoken(rng, 30, 'w')}", None)]
    out += [(7, spoken(rng, 40, "w"), "en"), (7, out[7][1], "en"), (300, None, "en"), (301, "", "en"), (302, "½ ² Ⅷ 12 _", "en"), (303, "हिन्दी", None)]
    return [*out, out[0]]


NAMES = "doc_id long, text string, lang string, __id long, __drop string, __row long, __lang string, __lines long, row long, node long, key string, place long, `a b` int"


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "l", 3, 4, 5, "k", 6, 7) for r in rows], NAMES).repartition(3).cache()


# ---- language


def plain_language(train):
    """text -> (language, posterior) by loops over dicts."""
    words = lambda t: Counter(regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower()))
    langs = sorted(train)
    count, docs, grams = {x: Counter() for x in langs}, Counter(), {x: {n: Counter() for n in (1, 2, 3, 4)} for x in langs}
    for lang, texts in train.items():
        for t in texts:
            for w, c in words(t).items():
                count[lang][w] += c
                docs[w] += 1
                for n in (1, 2, 3, 4):
                    p = f"<{w}>"
                    for i in range(len(p) - n + 1):
                        grams[lang][n][p[i : i + n]] += c
    known = {w for w in docs if docs[w] > 1}
    log = lambda x, of, keys: math.log((of[x] + langid.ADD) / sum(of[k] + langid.ADD for k in keys))
    every = {n: {g for x in langs for g in grams[x][n]} for n in (1, 2, 3, 4)}
    memo = {}

    def word(w, lang):
        if (w, lang) not in memo:
            if w in known:
                memo[w, lang] = log(w, count[lang], known)
            else:
                p, parts = f"<{w}>", []
                for i in range(len(p)):
                    for down, n in enumerate((4, 3, 2, 1)):
                        g = p[i : i + n]
                        if len(g) == n and g in every[n]:
                            parts.append(log(g, grams[lang][n], every[n]) + down * math.log(0.4))
                            break
                memo[w, lang] = sum(parts) / max(1, len(parts))
        return memo[w, lang]

    def predict(text):
        found = words(text)
        if not found or not langs:
            return "und", 0.0
        sums = {x: sum(c * word(w, x) for w, c in found.items()) for x in langs}
        best = max(langs, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())

    return predict


def test_language_is_the_plain_loop(table, rows):
    train = defaultdict(list)
    for i, t, lang in rows:
        if lang is not None and t is not None and not langid.held_out(i):
            train[lang].append(t)
    predict = plain_language(train)
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in langid.digest(table).collect())
    assert got == Counter((i, p, round(s, 6)) for i, t, _ in rows for p, s in [predict(t)])
    assert {p for i, p, _ in got if i in (300, 301, 302)} == {"und"} and {p for i, p, _ in got if i == 303} != {"und"}


def test_every_label_is_learned(spark):
    """As many labels as rows: none is left out, and the sample is bounded by rows and bytes."""
    rng = random.Random(1)
    data = [(4 * k, spoken(rng, 20, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q"), f"l{k:03d}") for k in range(120)]
    data = [(i, t, lang) for i, t, lang in data if not langid.held_out(i)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert {r["lang"] for r in langid.sample(df).collect()} == {lang for _, _, lang in data}
    got = langid.digest(df).collect()
    assert sum(r["lang_pred"] == {i: lang for i, _, lang in data}[r["doc_id"]] for r in got) > 0.9 * len(got)


# ---- lines


def test_lines_of_rows_without_an_id(spark):
    """Many rows share an id or have none: each loses its own lines, and no list has another row's."""
    line = lambda k: f"a line that repeats in documents {k:04d}"
    rows = [(None, line(k)) for k in range(40)] + [(7, f"{line(k)}\nshort") for k in range(40)] + [(7, f"{line(3)}\nshort")] * 2 + [(9, line(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lists = linededup.repeated_lines(df).collect()
    assert len(lists) == 80 and all(len(r["drop"]) == 1 for r in lists)
    out = linededup.dedup_lines(df).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter([(None, "")] * 40 + [(7, "short")] * 42 + [(9, line(k)) for k in range(40)])
    assert sum(r["n_dropped"] for r in out) == 82


def test_lines_of_extreme_ids(spark):
    line = "this line is long enough to be counted"
    df = spark.createDataFrame([(None, line), (None, line + "\nx"), (-(1 << 63), line), (5, f"{line}\nend")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_lines"]): r["n_dropped"] for r in linededup.digest(df).collect()}
    assert got == {(None, 1): 1, (None, 2): 1, (-(1 << 63), 1): 1, (5, 2): 0}


def test_filters_grow_with_the_texts(spark):
    small = spark.createDataFrame([("x",)], "text string")
    assert linededup.bits_for(small) == linededup.LEAST_BITS and linededup.bits_for(small.limit(0)) == linededup.LEAST_BITS
    large = spark.range(4000).selectExpr("repeat('x', 20000) as text")
    assert linededup.LEAST_BITS < linededup.bits_for(large) <= linededup.MOST_BITS


# ---- packing


def plain_pack(tails, length):
    """Sequences by a BM25 written out as loops."""
    n, mean = len(tails), sum(map(len, tails)) / max(1, len(tails))
    df = Counter(t for x in tails for t in set(x.tolist()))
    counts = [Counter(x.tolist()) for x in tails]

    def score(ids, k):
        out = 0.0
        for t in sorted(set(ids.tolist())):
            if df[t] > 1 and counts[k][t]:
                tf = counts[k][t]
                out += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(tails[k]) / max(1.0, mean)))
        return out

    unused, out, rest = list(range(n)), [], None
    while rest or unused:
        seed, start = rest or (unused.pop(0), 0)
        sequence, room, rest = [(seed, start, len(tails[seed]))], length - (len(tails[seed]) - start), None
        ranked = sorted(unused, key=lambda k: (-round(score(tails[seed], k), 9), k)) if room else []
        for k in ranked:
            if not room:
                break
            unused.remove(k)
            take = min(len(tails[k]), room)
            sequence.append((k, 0, take))
            if take < len(tails[k]):
                rest = (k, take)
            room -= take
        out.append(sequence)
    return out


def test_packing_is_the_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 40):
        tails = [rng.zipf(1.5, rng.integers(1, 60)).clip(0, 300).astype(np.uint16) for _ in range(n)]
        assert packing.Shard(tails).pack(64) == plain_pack(tails, 64)


def test_shards_hold_what_is_alike(spark):
    """Tails of one vocabulary lie in one shard, equal rows are split, and no shard is larger than it may be."""
    rng = random.Random(4)
    data = [(k, f"{spoken(rng, 30, 'qw' if k % 2 else 'zx')}") for k in range(200)] + [(k, "the same text again") for k in range(200, 500)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(4), shard=64).collect()
    seqs = defaultdict(set)
    for r in out:
        if r["doc_id"] < 200:
            seqs[r["sequence_id"]].add(r["doc_id"] % 2)
    assert sum(len(s) == 1 for s in seqs.values()) > 0.5 * len(seqs)
    assert Counter(r["doc_id"] for r in out if r["start"] == 0) == Counter(range(500))
    full = Counter()
    for r in out:
        full[r["sequence_id"]] += r["length"]
    assert sum(n < 1024 for n in full.values()) <= 500 // 64 + 5


def test_ids_are_the_tokenizers_over_all_texts():
    """The faster encoder against the tokenizers library: every text of a table, and random strings of the characters it takes."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder()
    rng = random.Random(9)
    plain = [c for c in map(chr, range(9, 0x250)) if packing._PLAIN.fullmatch(c)] + list("–—‘’‚“”„•…€")
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices([" ", "  ", "\n", "\t", "'s", "'LL", "1", "²", "½", "ß", "é", "A", "a", "-", "_", "ǅ"], k=20)) for _ in range(4000)]
    for t in texts:
        assert fast(t)[:-1].tolist() == slow.encode(t or "", add_special_tokens=False).ids, t


# ---- neighbours


def test_neighbours_by_collisions(spark):
    """Blocks large enough for pruning: few vectors are verified, recall holds, and near groups end a search early."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((6000, 32))
    block = ann.Block(np.arange(6000), v)
    hits, seen = [], []
    for q in range(0, 6000, 200):
        d = np.linalg.norm(v - v[q], axis=1)
        d[q] = np.inf
        got = block.search(q, v[q])
        assert all(abs(s - d[i]) < 1e-9 for i, s in got) and [s for _, s in got] == sorted(s for _, s in got)
        hits.append(len({i for i, _ in got} & set(np.argsort(d)[:10].tolist())) / 10)
        seen.append(block.verified / 6000)
    assert np.mean(hits) >= 0.9 and np.mean(seen) < 0.1
    centres = np.repeat(rng.standard_normal((300, 32)) * 10, 20, axis=0)
    block = ann.Block(np.arange(6000), centres + 0.01 * rng.standard_normal((6000, 32)))
    found = block.search(0, block.vectors[0])
    assert {i for i, _ in found} <= set(range(1, 20)) and block.verified < 1000


# ---- URLs


def test_rules_of_a_table_are_those_compiled(spark):
    rng = random.Random(6)
    labels, paths = ["a", "b", "com", "net", "www"], ["", "/", "/x", "/x/y", "/x/y/z", "/q"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
    rules = list({f"{host()}{rng.choice(paths)}": rng.choice(["allow", "block"]) for _ in range(40)}.items())
    pages = spark.createDataFrame([(k, rng.choice([None, "", f"http://{host().upper()}{rng.choice(paths)}?q=1"])) for k in range(300)], "page_id long, url string")
    listed = spark.createDataFrame([("a.com",)], "canonical string")
    own = lambda r: Counter(map(tuple, urlfilter.judge(pages, listed, r).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert own(rules) == own(spark.createDataFrame(rules, "rule string, verdict string"))
    many = spark.createDataFrame([(f"h{k}.com/", "block") for k in range(2000)], "rule string, verdict string")
    assert urlfilter.judge(pages, listed, many).count() == 300


# ---- the pipeline


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


def plain_lines(rows):
    seen = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    place = lambda i: -math.inf if i is None else i
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                seen[key(x)].add(place(i))
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if len(seen[key(x)]) < 3 or max(seen[key(x)]) == place(i)), *r) for i, t, *r in rows]


def test_pipeline_is_the_plain_loops(spark, table, rows, tmp_path):
    import corpus_pipeline

    item = next(t for i, t, _ in rows if i == 31).split()[3:23]
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: common.checkpoint(stages[name](spark, df, str(tmp_path)))
    own = lambda df: [tuple(r[c] for c in ("doc_id", "text", "lang")) for r in df.collect()]

    train = defaultdict(list)
    for i, t, lang in rows:
        if lang is not None and t is not None and not langid.held_out(i):
            train[lang].append(t)
    predict = plain_language(train)
    told = run("language id", table)
    assert told.columns == table.columns
    assert Counter(own(told)) == Counter(r for r in rows if (p := predict(r[1]))[0] != "und" and p[1] >= langid.LEAST_SCORE)

    lines = run("line dedup", told)
    assert lines.columns == table.columns and Counter(own(lines)) == Counter(plain_lines(own(told)))

    kept = run("simhash near-dedup", lines)
    before, after = own(lines), own(kept)
    classes = near_classes([t for _, t, _ in before])
    of = {r: c for r, c in zip(before, classes, strict=True)}
    assert kept.columns == table.columns and Counter(of[r] for r in after) == Counter(set(classes))
    for r in after:  # the least id of its class, no id last
        ids = [i for (i, *_), c in zip(before, classes, strict=True) if c == of[r]]
        assert r[0] == min((i for i in ids if i is not None), default=None)

    clean = run("decontamination", kept)
    has = lambda t: any((t or "").split()[k : k + 20] == item for k in range(len((t or "").split())))
    assert Counter(own(clean)) == Counter(r for r in after if not has(r[1])) and len(after) > clean.count()

    packed = run("packing", clean)
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == Counter(i for i, *_ in own(clean))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in whole if r["start"] == 0) == Counter(i for i, *_ in own(clean))


def test_pipeline_of_empty_tables(spark, table, tmp_path):
    import corpus_pipeline

    table.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    full = tmp_path / "full"
    table.write.parquet(f"{full}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{full}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(full)).select("doc_id").distinct().count() > 40


def test_pipeline_meets_fingerprints_in_balls(spark, tmp_path, monkeypatch):
    """The stage compares what SimHash balls link: equal fingerprints, and those at two bits or fewer, of all distinct sets."""
    import corpus_pipeline
    from sparkwire.llm import decontam, jaccard

    rng = random.Random(6)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[:-1])]
    texts += [texts[0], "", None]
    sets = np.split(*(lambda s, at: (s, at[1:-1]))(*jaccard.sets_of([(t or "").encode() for t in texts])))
    prints = {decontam.simhash(s) for s in sets}
    met, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: (met.append([r["fp"] & (1 << 64) - 1 for r in fps.collect()]), links(fps))[1])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, str(tmp_path))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*range(0, 24, 3), 25])
    assert len(met) == 1 and sorted(met[0]) == sorted(prints)
    nodes = {jaccard.node_of(s): decontam.simhash(s) for s in sets}
    rows = spark.createDataFrame([(n, int(np.uint64(f).view(np.int64))) for n, f in nodes.items()] * 2 + [(n, None) for n in nodes], "node long, fp long")
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in jaccard.balls(rows, links).collect():
        assert (nodes[a] ^ nodes[b]).bit_count() <= 2
        parent[find(a)] = find(b)
    close = [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 2]
    assert len(close) >= 4 and all(find(a) == find(b) for a, b in close)


def test_pipeline_takes_small_batches(spark, table, tmp_path):
    """The stages take batches of bounded rows, a smaller setting stays, and run() sets back what it found."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, stage = spark.conf.get(key), dict(corpus_pipeline.STAGES)["packing"]
    try:
        for now, then in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(key, now)
            stage(spark, table.limit(1), "")
            assert spark.conf.get(key) == then
        spark.conf.set(key, "10000")
        table.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)


def test_clashing_names_pass(table, spark):
    n = table.count()
    assert linededup.dedup_lines(table).count() == langid.identify(table).count() == n
    assert pii.replace(table, b"k").count() == n and pii.replace(table, b"k").columns[: len(table.columns)] == table.columns
    assert simhash.keep_one(table).columns == simhash.keep_one(table, 0.8).columns == table.columns
    assert lm_score.score(table).count() == n and packing.pack(table).where("start = 0").count() == n


def test_commons_are_counted():
    rng = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (60, 40), (60, 4000), (300, 900)):
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 40))).astype(np.uint64) for _ in range(n)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
        common = jaccard._commons(np.concatenate(sets) if n else np.zeros(0, np.uint64), at)
        for a in range(0, n, 25):
            got, want = common(a, a + 25), np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets[a : a + 25]])
            others = np.arange(a, min(a + 25, n))[:, None] != np.arange(n)
            assert (got[others] == want[others]).all()


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_crowds_of_near_copies(spark, monkeypatch, block):
    """A large group around one text that is not there itself: blocks find the components of brute force."""
    monkeypatch.setattr(jaccard, "CROWD", 4)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(90):
        w = base[:]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.choice([80, 80, 50])]))
    df = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, row long, text string").repartition(4)
    got = defaultdict(set)
    for r in jaccard.near_copies(df).collect():
        got[r["root"]].add(r["id"])
    want = defaultdict(set)
    for k, c in enumerate(near_classes(texts)):
        want[c].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 3
