"""The prefix trie, byte-level BPE and the divergence audit against plain loops and public libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwire.llm import bpe, divergence, trie

# ---- prefix trie

TALK = "conv_id long, turn long, role string, text string, node long, depth long, digest string, left long, `a b` int"


def talk(rng):
    """Conversations that share beginnings, one long one, repeated ones, ties, nulls; rows in any order."""
    out = []
    for c in [*range(0, 130), 200, 201, 299, 350, 1000, -5, -120]:
        for t in range(rng.randint(1, 7)):
            out.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yo", "x" * 40, ""])))
    for c in range(400, 430):  # the same for many turns
        out += [(c, t, "user", f"say {t}") for t in range(4)]
    out += [(500 + k % 2, t, "user", f"long {t}") for k in range(2) for t in range(12)]
    out += [(600, None, "user", "first"), (600, 0, None, "é€"), (600, 1, "user", None), (600, 1, "user", None), (None, 3, "user", "nobody")]
    rng.shuffle(out)
    return out


def plain_trie(rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = [k for k in members if len(k) == len(node) + 1 and k[: len(node)] == node]
        kids = [out[k] for k in below]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        ends = ",".join(str(c) for c in members[node] if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (len(node), min(members[node]), parent, len(members[node]), len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


@pytest.mark.parametrize("small_rows", [20, None])
def test_prefix_trie_equals_loops(spark, small_rows):
    rows = talk(random.Random(5))
    df = spark.createDataFrame([(*r, 1, 2, "d", 3, 4) for r in rows], TALK).repartition(3)
    got = trie.prefix_trie(df, small_rows).select([f.split()[0] for f in trie.NODE.split(", ")]).collect()
    assert sorted(map(tuple, got)) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], TALK)
    assert trie.prefix_trie(none).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, 2, "d", 3, 4)], TALK)).collect() == []


def test_places_of_a_long_conversation(spark):
    """Places run through the ranges that a conversation is dealt to."""
    df = spark.range(5000).selectExpr("7L conv_id", "5000 - id turn", "'u' role", "cast(id as string) text")
    got = {bytes(r["digest"]): r["place"] for r in trie.numbered_turns(df).collect()}
    assert all(got[hashlib.sha256(f"1:u{5000 - k}".encode()).digest()] == k for k in range(1, 5001))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse(bpe.read_vocabulary(None))


@pytest.fixture(scope="module")
def own(ranks):
    return bpe.Vocabulary(ranks)


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CLASSES = bpe.library_classes()


def by_replay(own, texts):
    words_of = bpe.splitter(public_tokenizers.PATTERN, CLASSES)
    cut = [[w.encode() for found in words_of(t) for w in found] for t in texts]
    words = list(dict.fromkeys(w for c in cut for w in c))
    ids, counts = own.replay(words)
    parts = dict(zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if words else {}
    return [[int(i) for w in c for i in parts[w]] for c in cut]


def test_replay_equals_the_library(own, ranks):
    rng = random.Random(2)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    texts = ["", " ", "aaaaaaa", "\x00\x1c\x1d\x85 x", "don't  we'll \n\n x", "a" * 3000, "ab" * 3000, " " * 999, "é" * 999]
    texts += [f"a{c}1 {c}{c} b" for c in every[::37]]
    texts += ["".join(rng.choice(every) for _ in range(30)) for _ in range(500)]
    texts += ["".join(rng.choice(tokens).strip() for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    encode = library(ranks).encode_ordinary
    assert by_replay(own, texts) == [encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_replay_of_any_text(own, ranks, texts):
    encode = library(ranks).encode_ordinary
    got = by_replay(own, texts)
    assert got == [encode(t) for t in texts]
    assert [own.decode(ids).decode() for ids in got] == texts


def test_a_rank_that_turns_up_late():
    """Merges out of order: (b, c) has a higher rank than the pair that its result makes, as no trained vocabulary has it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xabc": 256, b"xa": 258, b"bc": 259, b"cx": 257}
    ranks |= {b"bcbc": 260, b"abc": 257 + 4}
    own, encode = bpe.Vocabulary(ranks), library(ranks).encode_ordinary
    rng = random.Random(4)
    words = list({"".join(rng.choice("abcx") for _ in range(rng.randint(1, 14))) for _ in range(3000)})
    assert by_replay(own, words) == [encode(w) for w in words]
    assert all(own.alone(w.encode()) == encode(w) for w in words if w.encode() not in ranks)


def test_digest_equals_the_library(docs, all_rows, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_BUCKETS", 3)
    encode = library(ranks).encode_ordinary
    want = Counter()
    for i, text, _ in all_rows:
        ids = encode(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(docs).collect()) == want


def test_encode_and_decode(spark, docs, all_rows, no_docs):
    back = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r["doc_id"], bytes(r["data"]).decode()) for r in back) == Counter((i, t or "") for i, t, _ in all_rows)
    assert bpe.encode(no_docs).collect() == [] and bpe.digest(no_docs).collect() == []


def test_long_texts_go_word_by_word(monkeypatch):
    words_of = bpe.Splitter(public_tokenizers.PATTERN, CLASSES)
    for text in ("one two  three\n\nfour " * 50, "one \U0003f7da閭 two  three\n " * 50):
        (whole,) = words_of(text)
        with monkeypatch.context() as m:
            m.setattr(bpe, "LONG", 64)
            parts = list(words_of(text))
        assert len(parts) > 2 and [w for p in parts for w in p] == whole


def test_classes_are_the_library_s(own, ranks):
    """Characters that the regex module and the library class differently, each beside one of every class."""
    words_of = bpe.Splitter(public_tokenizers.PATTERN, CLASSES)
    assert words_of.fast.findall("a b's 1\u00a0é  ") == words_of.exact.findall("a b's 1\u00a0é  ")
    odd = words_of.differs.findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if words_of.differs else []
    texts = [f"{x}{y}" for y in odd[::17] for x in "閭渥é€²"] + [f"{y}{x}" for y in odd[::17] for x in "閭渥é€²\u3000"]
    encode = library(ranks).encode_ordinary
    assert by_replay(own, texts) == [encode(t) for t in texts]
    with pytest.raises(ValueError):
        bpe.explicit(r"[\S]", CLASSES)


# ---- divergence


def plain_audit(rows, min_docs, top):
    occur, in_docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        occur[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        both = lambda s: {t: occur[lang, s][t] for t in kept}

        def p(counts):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (c + 2) // (total + 2 * len(counts)) for t, c in counts.items()}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine = p(both(source))
        pairs = [(s, sum(f(mine[t], q) for t, q in p(both(s)).items())) for g, s in groups if g == lang and s != source]
        whole = Counter()
        for g, s in groups:
            if g == lang:
                whole.update(both(s))
        q = p({t: whole[t] for t in kept})
        terms = [(t, f(mine[t], q[t])) for t in kept if occur[lang, source][t] and mine[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def test_audit_equals_loops(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("th", "Wh", "é", "日本", "z") for b in ("e", "at", "ing", "ß", "Ä", "1")]
    rows = [(" ".join(rng.choice(words[: 6 + 4 * (k % 7)]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ß", "c", None, ""])) for k in range(120)]
    rows += [(None, "en", "empty"), ("", "xx", "only"), ("rare words here", "xx", "other"), ("word " * 30_000, "en", "a"), ("1 2 ? [", "yy", "alone")]
    rows += [rows[0]] * 3
    df = spark.createDataFrame([(1, *r, 5, "t", 1.0, "i") for r in rows], "doc_id long, text string, lang string, source string, n int, term string, p double, item string").repartition(4)
    for held in (divergence.HELD, 5):
        monkeypatch.setattr(divergence, "HELD", held)
        got = divergence.audit(df, 4, 3).collect()
        assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == plain_audit(rows, 4, 3)
    assert sorted(map(tuple, divergence.audit(df, 4, 3, cells=64).select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, 4, 3)  # a full sketch
    assert divergence.audit(df.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300), st.integers(1, 30), st.sampled_from([64, 1024]))
def test_sketch_never_underestimates(keys, most, cells):
    true = Counter(keys)
    parts = [Counter(keys[::2]), Counter(keys[1::2])]
    sketch = np.zeros((divergence.ROWS, cells), np.uint8)
    for part in parts:
        divergence.add(sketch, divergence._hashes("en", [str(k).encode() for k in part]), np.fromiter(part.values(), np.int64, len(part)), most)
    names = [str(k).encode() for k in true]
    for name, ok in zip(names, divergence.possible(sketch, divergence._hashes("en", names), most), strict=True):
        assert ok or true[int(name)] < most


def test_sketch_spares_the_shuffle(spark):
    """Terms in too few documents do not leave their tasks."""
    df = spark.range(400).selectExpr("'en' lang", "'s' source", "concat('common ', translate(cast(id as string), '0123456789', 'abcdefghij'), 'q') text").repartition(4)
    got = {r["term"]: (r["n"], r["df"]) for r in divergence.counted(df, 10, 1 << 16).collect()}
    assert got == {"common": (400, 400)}
