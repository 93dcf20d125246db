"""Byte-level BPE by replaying the merges once over the distinct words of the corpus, and decoding.

1. Tasks cut texts into words by the vocabulary's pattern, with the library's own classes of characters. Blocks of about BLOCK characters become rows of
   word numbers, by falling frequency in the block, and lists of their distinct words, dealt to buckets by
   hash. That table is written once, bucketed by block.
2. A bucket's words of all blocks, each distinct word once, are laid end to end. An inverted index from
   token pair (by the rank of its merge) to positions is filled from their bytes; every merge is applied in
   rank order at all its positions, and only the pairs with the merged token's neighbours enter the index.
3. Each block gets its words' ids back and writes its documents' ids; the table's rows stay where they are.

A word that is itself a token is that token, as in the usual library. Should a merge make a pair of a lower
rank, which the order by rank has passed, the word is encoded again alone, lowest rank and leftmost first.
Defined cases: null text is empty and has no ids; bytes that are not UTF-8 count as U+FFFD; rows that
repeat a doc_id, or have none, are each encoded; a text of any length is read in whole, and so is a word
(12 bytes of links a byte); an empty table gives none; other columns are not read. The vocabulary's file is
read by the driver and broadcast (under a MB). The written table stays in the shared folder, for the result
reads it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, pieces, shared_folder, tidily

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a block; words of the documents in one of its rows; characters of a text from which on words are taken one by one.
BLOCK, SHEAF, LONG = 1 << 24, 1 << 19, 1 << 20
#: Bytes of text for each bucket of words, and the least number of buckets; the most that a bucketed table may have.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 28, 16, 100_000


def parse(data: bytes) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        #: The merge of two tokens, by both their ids.
        self.merges = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = rank
        self.bytes = np.fromiter((ranks[bytes([b])] for b in range(256)), np.int32, 256)
        pairs = np.full((256, 256), -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                pairs[token[0], token[1]] = rank
        self.pairs = pairs

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        ids = self.bytes[flat]
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        before, after = np.arange(-1, len(flat) - 1, dtype=np.int32), np.arange(1, len(flat) + 1, dtype=np.int32)
        before[first[lengths > 0]] = -1
        after[(first + lengths - 1)[lengths > 0]] = -1
        pair = np.where(after[:-1] >= 0, self.pairs[flat[:-1], flat[1:]], -1) if len(flat) else np.zeros(0, np.int32)
        at = np.flatnonzero((pair >= 0) & np.repeat(whole < 0, lengths)[:-1]) if len(flat) else np.zeros(0, np.int64)
        order = at[np.argsort(pair[at], kind="stable")]
        ranks, starts = np.unique(pair[order], return_index=True)
        index = {r: array("i", part.astype(np.int32).tobytes()) for r, part in zip(ranks.tolist(), np.split(order, starts[1:]), strict=True)} if len(order) else {}
        odd = self._merge(index, tok := array("i", ids.astype(np.int32).tobytes()), array("i", before.tobytes()), array("i", after.tobytes()))
        tok = np.frombuffer(tok, np.int32).copy()
        alive = tok >= 0
        counts = np.add.reduceat(np.append(alive, False).astype(np.int64), first) * (lengths > 0) if len(words) else np.zeros(0, np.int64)
        settled = {int(k): [int(whole[k])] for k in np.flatnonzero(whole >= 0)}
        settled |= {int(k): self.alone(words[k]) for k in np.unique(np.searchsorted(first, odd, side="right") - 1)} if odd else {}
        if not settled:
            return tok[alive], counts
        for k, own in settled.items():  # their ids stand at the first of their bytes, which suffice
            a = int(first[k])
            tok[a : a + int(lengths[k])] = -1
            tok[a : a + len(own)] = own
            counts[k] = len(own)
        return tok[tok >= 0], counts

    def _merge(self, index: dict, tok: array, before: array, after: array) -> list[int]:
        """Applies every merge in rank order; positions in whose word a lower rank turned up too late."""
        merges, odd = self.merges.get, []
        heapify(ranks := list(index))
        while ranks:
            rank = heappop(ranks)
            for p in sorted(index.pop(rank)):
                left_id, q = tok[p], after[p]
                if left_id < 0 or q < 0 or merges(left_id << 32 | tok[q]) != rank:
                    continue  # a neighbour has been merged since
                tok[p], tok[q] = rank, -1
                after[p] = r = after[q]
                if r >= 0:
                    before[r] = p
                    if (new := merges(rank << 32 | tok[r])) is not None:
                        if new < rank:
                            odd.append(p)
                        elif new in index:
                            index[new].append(p)
                        else:
                            index[new] = array("i", (p,))
                            heappush(ranks, new)
                if (o := before[p]) >= 0 and (new := merges(tok[o] << 32 | rank)) is not None:
                    if new < rank:
                        odd.append(p)
                    elif new in index:
                        index[new].append(o)
                    else:
                        index[new] = array("i", (o,))
                        heappush(ranks, new)
        return odd

    def alone(self, word: bytes) -> list[int]:
        """One word's ids: always the lowest rank, and of equal ones the leftmost."""
        tok, n = [int(self.bytes[b]) for b in word], len(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, p) for p in range(n - 1) if (r := self.merges.get(tok[p] << 32 | tok[p + 1])) is not None]
        heapify(heap)
        while heap:
            rank, p = heappop(heap)
            if tok[p] < 0 or (q := after[p]) < 0 or self.merges.get(tok[p] << 32 | tok[q]) != rank:
                continue
            tok[p], tok[q], after[p] = rank, -1, after[q]
            if after[p] >= 0:
                before[after[p]] = p
            for a in (before[p], p):
                if a >= 0 and after[a] >= 0 and (new := self.merges.get(tok[a] << 32 | tok[after[a]])) is not None:
                    heappush(heap, (new, a))
        return [t for t in tok if t >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_known: dict[bytes, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """One for each worker."""
    key = hashlib.sha256(data).digest()
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(parse(data))
    return _known[key]


def read_vocabulary(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def library_classes() -> dict[str, str]:
    """The characters of L, N and white space by the library's Unicode tables, as ranges of a character class.

    It keeps only what its pattern matches, so that each class is asked for with all characters at once.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        encoding = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[name] = _ranges(map(ord, bytes(encoding.encode_ordinary(every)).decode()))
    return out


def _ranges(codes: Iterable[int]) -> str:
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def explicit(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with the classes written out."""
    out, within, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in (*classes, r"\S") if pattern.startswith(n, at)), None)
        if name == r"\S" and within:
            raise ValueError(f"\\S within a class: {pattern}")
        if name:
            out.append(f"[^{classes[chr(92) + 's']}]" if name == r"\S" else classes[name] if within else f"[{classes[name]}]")
            at += len(name)
        else:
            width = 2 if pattern[at] == "\\" else 1
            within = pattern[at] == "[" or within and pattern[at] != "]"
            out.append(pattern[at : at + width])
            at += width
    return "".join(out)


class Splitter:
    """Words as the library's pattern cuts them.

    The regex module is several times faster than a pattern with classes written out, but knows another
    version of Unicode: texts with a character of another class there take the written-out pattern.
    """

    def __init__(self, pattern: str, classes: dict[str, str]):
        self.fast, self.exact = regex.compile(pattern), re.compile(explicit(pattern, classes))
        differs: set[str] = set()
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for name, ranges in classes.items():
            differs ^= set(regex.findall(name, every)) ^ set(re.findall(f"[{ranges}]", every))
        self.differs = re.compile(f"[{_ranges(sorted(map(ord, differs)))}]") if differs else None

    def __call__(self, text: str) -> Iterator[list[str]]:
        pattern = self.fast if text.isascii() or not self.differs or not self.differs.search(text) else self.exact
        if len(text) < LONG:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, LONG)):
            yield part


SPLIT = "block long, bucket int, ids array<long>, sizes array<long>, data binary, lengths binary, numbers binary"


_splitters: dict[tuple, Splitter] = {}


def splitter(pattern: str, classes: dict[str, str]) -> Splitter:
    """One for each worker."""
    key = (pattern, *classes.values())
    if key not in _splitters:
        _splitters.clear()
        _splitters[key] = Splitter(pattern, classes)
    return _splitters[key]


def split(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Rows of a block: documents (ids, sizes: how many words each has; data: word numbers), and for each bucket its words (data, lengths) and their numbers."""

    classes = library_classes()

    def run(it):
        words_of, part = splitter(pattern, classes), TaskContext.get().partitionId()
        blocks = 0
        known: dict[str, int] = {}
        sheaves: list[tuple[list, list, array]] = []
        chars = 0

        def flush():
            nonlocal blocks, chars
            words, seen = list(known), np.zeros(len(known), np.int64)
            for _, _, seq in sheaves:
                seen += np.bincount(np.frombuffer(seq, np.uint32), minlength=len(known))
            number = np.empty(len(words), np.uint32)
            number[np.argsort(-seen, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            block = part << 32 | blocks
            rows = [(block, None, ids, sizes, _pack(number[np.frombuffer(seq, np.uint32)]), None, None) for ids, sizes, seq in sheaves]
            encoded = [w.encode() for w in words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int64, len(words))
            order = np.lexsort((number, bucket))
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    listed = [encoded[k] for k in own]
                    lengths = np.fromiter(map(len, listed), np.int64, len(own))
                    rows.append((block, int(bucket[own[0]]), None, None, zstandard.compress(b"".join(listed), 1), _pack(lengths), _pack(number[own])))
            known.clear()
            sheaves.clear()
            blocks, chars = blocks + 1, 0
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            for a in range(0, len(rows), 64):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[a : a + 64], strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SPLIT.split(", ")])

        for batch in pieces(it):
            for doc, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                text = (text or b"").decode("utf-8", "replace")
                if not sheaves or len(sheaves[-1][2]) > SHEAF:
                    sheaves.append(([], [], array("I")))
                ids, sizes, seq = sheaves[-1]
                had = len(seq)
                for found in words_of(text):
                    seq.extend([known.setdefault(w, len(known)) for w in found])
                ids.append(doc)
                sizes.append(len(seq) - had)
                chars += len(text)
                if chars >= BLOCK:
                    yield from flush()
        if sheaves:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidily(run), SPLIT)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of every text, a list of int."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, size // BUCKET)
    sent = spark.sparkContext.broadcast(read_vocabulary(path))
    name = f"bpe_{uuid.uuid4().hex}"
    tables = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * (size // BLOCK)))
    cut = split(docs, pattern, buckets).write.format("parquet").option("compression", "none").option("path", f"{shared_folder(spark)}/{name}")
    cut.bucketBy(tables, "block").saveAsTable(name)
    table = spark.table(name)

    def replay(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        uses = []
        for data, lengths in zip(rows["data"].to_pylist(), rows["lengths"].to_pylist(), strict=True):
            blob, ends = zstandard.decompress(data), np.cumsum(_unpack(lengths).astype(np.int64)).tolist()
            uses.append(np.fromiter((known.setdefault(blob[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
        ids, counts = vocabulary(sent.value).replay(list(known))
        starts = np.cumsum(counts) - counts
        replies = [(_pack(_gather(ids, starts, counts, use)), _pack(counts[use])) for use in uses]
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "data": pa.array([d for d, _ in replies], pa.binary()), "lengths": pa.array([n for _, n in replies], pa.binary())})

    asked = table.where(F.col("bucket").isNotNull()).select("block", "bucket", "data", "lengths")
    asked = asked.repartition(buckets, "bucket")  # little data, much work: not to be coalesced
    replies = asked.groupBy("bucket").applyInArrow(replay, "block long, bucket int, data binary, lengths binary")

    def assemble(rows: pa.Table, replies: pa.Table) -> pa.Table:
        of = {b: k for k, b in enumerate(replies["bucket"].to_pylist())}
        data, lengths = replies["data"].to_pylist(), replies["lengths"].to_pylist()
        rows = rows.to_pylist()
        listed = [(_unpack(r["numbers"]), of[r["bucket"]]) for r in rows if r["bucket"] is not None]
        total = sum(len(n) for n, _ in listed)
        starts, counts, flat, at = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0
        for numbers, k in listed:
            own, many = _unpack(data[k]), _unpack(lengths[k]).astype(np.int64)
            counts[numbers] = many
            starts[numbers] = at + np.cumsum(many) - many
            flat.append(own)
            at += len(own)
        flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
        doc_ids, ids, ends = [], [], []
        at = 0
        for r in rows:
            if r["bucket"] is None:
                seq = _unpack(r["data"])
                ids.append(_gather(flat, starts, counts, seq))
                words = np.concatenate(([0], np.cumsum(np.array(r["sizes"], np.int64))))
                tokens = np.concatenate(([0], np.cumsum(counts[seq])))[words]
                doc_ids += r["ids"]
                ends.append(tokens[1:] + at)
                at += int(tokens[-1])
        offsets = np.concatenate([[0], *ends])
        values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": lists})

    return table.drop("lengths").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, use: np.ndarray) -> np.ndarray:
    """flat's pieces that `use` names, end to end."""
    n = counts[use]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[use] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


def _lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch.column("ids")
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    yield from (values[a:b] for a, b in zip(offsets, offsets[1:], strict=False))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) as (doc_id, data): the bytes of the ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(it):
        for batch in it:
            data = [vocabulary(sent.value).decode(ids.tolist()) for ids in _lists(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(it):
        for batch in it:
            own = vocabulary(sent.value)
            lists = list(_lists(batch))
            sums = [[hashlib.sha256(x).hexdigest() for x in data] for data in ((ids.astype("<u4").tobytes() for ids in lists), (own.decode(ids.tolist()) for ids in lists))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, lists), pa.int64()), *map(pa.array, sums)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, path).mapInArrow(tidily(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
