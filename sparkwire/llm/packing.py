"""Lexical retrieval packing of tokenised documents into sequences of at most 1024 tokens.

A document's ids are cut into full sequences from its start; what remains, its tail, is packed. Tails
are put in order by content, the least hashes of their distinct ids, so that tails of the same words lie
together; ranges of that order are partitions, and each SHARD rows of a partition a shard with a BM25
inverted index over its tails. A seed asks its shard's index with all of its terms; unused neighbours,
best first, fill the seed's window, and the one that does not fit is cut: its rest seeds the next
sequence. When a shard has no scored neighbour left, unused tails follow in order. So every sequence is
full but the last of each shard. Rows of equal content are split among ranges by a hash of the row, and
a shard never has more than SHARD rows.

Ids are those of the tokenizers library. Plain Latin text is encoded by the same vocabulary in its
faster implementation; text with any other character, or with a special token's string, goes to
the tokenizers library itself, whose pre-tokeniser may differ there.

Defined cases: null text is empty; an empty document is the one id 0; every row is a document, rows
that repeat a doc_id or have none included; other columns are not read. Rows that are equal in all that
is read are in any order among themselves.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, mix, pieces, tidily

LENGTH, END = 1024, 0
SHARD = 2048
#: Shards of a range, and least hashes of a tail that make its place in the order.
RANGE, MINS = 8, 3
K1, B = 1.2, 0.75
TOKENIZER = "byte_bpe_50k"

_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ–—‘-„•…€]*")
_SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts; `folder` has the tokenizer's files, by default those installed."""

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        with open(self.path(f"{TOKENIZER}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _SPECIAL in text or not _PLAIN.fullmatch(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path(f"{TOKENIZER}.json"))
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        out = np.empty(len(ids) + 1, np.uint32)
        out[:-1] = ids
        out[-1] = END
        return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Places:
    """Places of tails in the order by content: bits of the least of a tail's ids, its end left out, under MINS hashes."""

    def __init__(self, ids: int = 1 << 16):
        own = np.arange(ids, dtype=np.uint64)
        self.hashes = [mix(own + np.uint64((k + 1) << 32)) for k in range(MINS)]
        for h in self.hashes:
            h[END] = ~np.uint64(0)

    def __call__(self, tails: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(tails), np.int64)
        some = [k for k, t in enumerate(tails) if len(t)]
        if some:
            every = np.concatenate([tails[k] for k in some])
            starts = np.concatenate(([0], np.cumsum([len(tails[k]) for k in some])))[:-1]
            for h in self.hashes:
                least = mix(np.minimum.reduceat(h[every], starts)) >> np.uint64(43)
                out[some] = out[some] << 21 | least.astype(np.int64)
        return out


class Shard:
    """A BM25 index of tails."""

    def __init__(self, tails: list[np.ndarray]):
        self.tails = tails
        n = len(tails)
        lengths = np.fromiter(map(len, tails), np.int64, n)
        owner = np.repeat(np.arange(n), lengths)
        terms = np.concatenate(tails).astype(np.int64) if n else np.zeros(0, np.int64)
        key, tf = np.unique(terms * max(1, n) + owner, return_counts=True)
        self.term, self.doc = key // max(1, n), key % max(1, n)
        self.terms, self.first, df = np.unique(self.term, return_index=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        self.df, self.sizes, self.active = df, df, n

    def shrink(self, unused: np.ndarray) -> None:
        """Leaves the postings of unused tails only; no score of theirs changes."""
        keep = unused[self.doc]
        self.term, self.doc, self.weight = self.term[keep], self.doc[keep], self.weight[keep]
        self.first = np.searchsorted(self.term, self.terms)
        self.sizes = np.searchsorted(self.term, self.terms, side="right") - self.first
        self.active = int(unused.sum())

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 scores of all tails for the distinct terms of ids; a term that one tail has is the seed's own."""
        at = np.searchsorted(self.terms, np.unique(ids))
        at = at[self.df[at] > 1]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[places], self.weight[places], minlength=len(self.tails))

    def pack(self, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
        """Sequences of (tail, from, to), which cover every id of every tail once."""
        unused, out = np.ones(len(self.tails), bool), []
        rest: tuple[int, int] | None = None
        turn = 0
        while True:
            if rest is None:
                while turn < len(unused) and not unused[turn]:
                    turn += 1
                if turn == len(unused):
                    return out
                rest = (turn, 0)
                unused[turn] = False
            seed, start = rest
            ids = self.tails[seed]
            sequence, room, rest = [(seed, start, len(ids))], length - (len(ids) - start), None
            if room:
                if 4 * int(unused.sum()) < 3 * self.active:
                    self.shrink(unused)
                scores = np.where(unused, self.scores(ids), -1)
                while room and unused.any():
                    best = int(scores.argmax())
                    size = len(self.tails[best])
                    unused[best], scores[best] = False, -1
                    sequence.append((best, 0, min(size, room)))
                    if size > room:
                        rest = (best, room)
                    room -= min(size, room)
            out.append(sequence)


def pack(docs: DataFrame, folder: str | None = None, shard: int = SHARD, length: int = LENGTH) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ranges = max(1, -(-docs.count() // (RANGE * shard)))

    def encode(it):
        encoder, places = Encoder(folder), Places()
        for batch in pieces(it):
            tails = []
            rows = {"place": None, "row": batch.column(2), "doc_id": batch.column(0), "n": [], "crcs": [], "tail": []}
            for text in batch.column(1).to_pylist():
                ids = encoder(text)
                full = len(ids) // length * length
                tails.append(ids[full:])
                rows["n"].append(len(ids))
                rows["crcs"].append([crc(ids[k : k + length]) for k in range(0, full, length)])
                rows["tail"].append(ids[full:].astype("<u2").tobytes())
            rows["place"] = places(tails)
            kinds = {"place": pa.int64(), "n": pa.int64(), "crcs": pa.list_(pa.int64()), "tail": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) if k in kinds else v for k, v in rows.items()], list(rows))

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(table: pa.Table, seq: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of one shard, and the next sequence's number."""
        docs, ns = table["doc_id"].to_pylist(), table["n"].to_pylist()
        out = []
        for doc, n, crcs in zip(docs, ns, table["crcs"].to_pylist(), strict=True):
            for k, c in enumerate(crcs):
                out.append((doc, k * length, length, c, n, seq, 0))
                seq += 1
        tails = [np.frombuffer(t, "<u2") for t in table["tail"].to_pylist()]
        with_tail = [k for k, t in enumerate(tails) if len(t)]
        for sequence in Shard([tails[k] for k in with_tail]).pack(length):
            at = 0
            for t, a, b in sequence:
                k = with_tail[t]
                out.append((docs[k], ns[k] // length * length + a, b - a, crc(tails[k][a:b]), ns[k], seq, at))
                at += b - a
            seq += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names), seq

    def shards(it):
        from pyspark import TaskContext

        rows, seq = None, TaskContext.get().partitionId() << 40
        for batch in it:
            batch = pa.Table.from_batches([batch])
            rows = batch if rows is None else pa.concat_tables([rows, batch])
            while len(rows) >= shard:
                out, seq = fill(rows.slice(0, shard), seq)
                yield out
                rows = rows.slice(shard)
        if rows is not None and len(rows):
            yield fill(rows, seq)[0]

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    encoded = rows.mapInArrow(tidily(encode), "place long, row long, doc_id long, n long, crcs array<long>, tail binary")
    encoded = checkpoint(encoded)  # texts are encoded once; the ranges are found by a sample of what comes out
    dealt = encoded.repartitionByRange(ranges, "place", "row").sortWithinPartitions("place", "row", "n", "doc_id")
    return dealt.mapInArrow(tidily(shards), ", ".join(f"`{n}` long" for n in names))
