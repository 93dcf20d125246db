"""Operators on embeddings and pages, the queries, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwire.llm import ann, queries, urlfilter, warc

DATA = "/root/testdata/sf0.001"


# ---- 3: nearest neighbours


def brute(rows, k, each):
    out = {}
    for q, v in rows:
        if q % each == 0:
            far = sorted({(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q})
            out[q] = far[:k]
    return out


def test_neighbours_are_exact_where_all_is_verified(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(8))]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties at distance zero and beyond
    odd = [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [1.0, None] + [1.0] * 6), (800, [float("inf")] + [1.0] * 7), (900, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame(rows + odd + [rows[0], rows[100]], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("score", F.lit(2)).withColumn("b", F.lit(3))
    got = {}
    for r in ann.search(df, vectors=100, queries=2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute(rows, 10, 100)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(a[0] == pytest.approx(b[0]) for q in want for a, b in zip(got[q], want[q], strict=True))


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert sorted(r["vec_id"] for r in ann.search(df).collect()) == [1, 2]
    assert ann.search(df.limit(0)).count() == 0


def test_recall_without_full_verification():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((6000, 64))
    block = ann.Block(np.arange(6000), vectors)
    hits = 0
    for q in range(0, 6000, 300):
        far = ((vectors - vectors[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len({i for i, _ in block.search(q, vectors[q])} & set(np.argsort(far)[:10].tolist()))
    assert hits / 200 >= 0.9


# ---- 5: URLs


URLS = [
    None, "", "no scheme.com/en/", "http://Example.COM/en/1?x#y", "https://www.example.com/en/2", "https://a.www.example.com/en/", "http://example.com/en", "http://example.com", "http://myexample.com/en/1",
    "https://x.net/fr/1", "https://x.net/de/1", "http://NET/es/", "ftp://spam-farm.example.org/en/1.html", "http://m.spam-farm.example.org/en/1/", "http://spam-farm.example.org/en/1?utm=1", "http://org.example.org/en/1", "a://b://c.com/x", "http://example.com:80/en/1", "http://user@net/es/1",
]


def plain_verdict(url, listed):
    rules = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].encode().lower().decode(), rest[cut:].split("?")[0].split("#")[0]
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            return host, path, h + p, v
    return host, path, None, "block" if canonical(host, path) in listed else "allow"


def canonical(host, path):
    for p in ("www.", "m."):
        if host.startswith(p):
            host = host[len(p) :]
            break
    for tail in ("/",):
        path = path[: -len(tail)] if path.endswith(tail) else path
    path = path.removesuffix(".html").removesuffix("/index")
    return host + path


@pytest.mark.parametrize("blocks", [1, 1 << 12])
def test_url_filter(spark, blocks):
    """One block makes every URL a possible hit; the exact join decides all the same."""
    pages = spark.createDataFrame([(i, u, "c", True, 1, 2) for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, canonical string, hit boolean, block int, key int")
    listed = spark.createDataFrame([("spam-farm.example.org/en/1",), ("spam-farm.example.org/en/1",), ("",), ("other.example.org/x",)], "canonical string")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, listed, blocks=blocks).collect())
    want = Counter((i, *plain_verdict(u, {"spam-farm.example.org/en/1"})) for i, u in enumerate(URLS + URLS[:3]))
    assert got == want
    assert urlfilter.judge(pages, listed.limit(0), blocks=blocks).where("listed").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, blocks=blocks).count() == 0


def test_url_filter_is_native(spark):
    plan = urlfilter.query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# ---- 6: WARC


def test_warc_round_trip(spark):
    big, other = "é" * 600, "x" * 1200
    rows = [(1, "http://a/1", big), (2, None, big), (3, "u\r\nX: y", other), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "", ""), (None, "http://a/n", big), (9, "http://a/9", big), (9, "http://a/9", big), (-8, "x", "WARC/1.1\r\n\r\n" * 100)]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], "page_id long, url string, html string, sha1 string, largest int").repartition(2)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, t in rows:
        n = len((t or "").encode())
        same = [k for k, _, x in rows if (x or "") == (t or "") and n >= 1000]
        top = max((k for k in same if k is not None), default=None)
        revisit = len(same) > 1 and i != top
        want[i, n, sha(t), "revisit" if revisit else "response", top if revisit else None] += 1
    assert got == want
    assert warc.digest(df.limit(0)).count() == 0


def test_warc_index_seeks(spark):
    rng = random.Random(0)
    bundle, records = warc.Bundle(frame_bytes=4096), {}
    for k in range(60):
        payload = rng.randbytes(rng.randint(0, 2000))
        data = warc.record(k, f"http://x/{k}", payload, hashlib.sha1(payload).hexdigest(), None)
        records[warc.record_id(k)] = data
        bundle.add(warc.record_id(k), data)
    data, index = bundle.close()
    assert len(warc.seek_table(data)) > 5
    for key, n, offset, length in index:
        assert warc.fetch(data, n, offset, length) == records[key]
    import zstandard

    whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + s], max_output_size=r) for a, s, r in warc.seek_table(data))
    assert whole == b"".join(records.values())
    assert [warc.page_of(warc.record_id(k)) for k in (0, 1, -1, 2**62, None)] == [0, 1, -1, 2**62, None]


def test_warc_export(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k}") for k in range(20)], "page_id long, url string, html string")
    bundles = warc.archive(df)
    warc.export(bundles, str(tmp_path))
    names = [p for p in tmp_path.iterdir() if p.name.endswith(".warc.zst")]
    places = {r["id"]: r for r in warc.index_of(bundles).collect()}
    files = {hashlib.sha1(p.read_bytes()).hexdigest(): p.read_bytes() for p in names}
    for k in range(20):
        r = places[warc.record_id(k)]
        (head, block), = warc.parse(warc.fetch(files[r["bundle"]], r["frame"], r["offset"], r["length"]))
        assert warc.payload_of(block)[0] == f"page {k}".encode() and head["WARC-Type"] == "response"


# ---- queries and pipeline


def test_queries_of_every_operator():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    text = docs.where("doc_id = 7").first()["text"]
    spark.createDataFrame([(1, " ".join(text.split()[:20]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        out.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        at = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        if name != "packing":
            assert at.columns == docs.columns, name
            kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    assert {130, 131, 132, 133} & set(kept["language id"]) == set()
    assert "very line" not in kept["line dedup"][120] and "This very line" in kept["line dedup"][142]
    assert {100, 101, 102, 103, 104} & set(kept["simhash near-dedup"]) == set() and 5 in kept["simhash near-dedup"]
    assert 7 not in kept["decontamination"] and len(kept["decontamination"]) == len(kept["simhash near-dedup"]) - 1
    assert {r["doc_id"] for r in at.collect()} == set(kept["decontamination"])
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, at.select("doc_id", "start", "length", "ids_crc32").collect()))
