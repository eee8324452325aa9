"""Exact deduplication by Patricia tries.

Each input task inserts its texts into a compressed radix trie and passes on one row for each different text
(so a text with very many copies reaches its owner once per task). Rows are then dealt by length and content
hash, and the owner of a partition inserts the full byte strings of all its rows into one trie: texts
are equal only if they end at the same terminal node, whatever the hash. Both tries are bounded: beyond that the
largest subtree is passed on. The owner's rows come in the order of length and hash, so what its subtrees hold of
earlier ones is final.

Defined results: null text counts as empty; a null doc_id loses to any other; rows that repeat both id and text
are copies of which one stays; extra columns travel untouched in ``representatives`` and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, batches

#: Bytes of text that one task's trie may hold before its largest subtree is passed on.
TRIE_BYTES = 24 << 20


class Trie:
    """Compressed radix trie over bytes. A node is [label, children by first byte, value or None]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held: dict[int, int] = {}  # bytes under each child of the root; -1: the empty string

    def node(self, key: bytes) -> list:
        """The terminal node of ``key``, made if it is new."""
        node, pos, end = self.root, 0, len(key)
        while pos < end:
            child = node[1].get(key[pos])
            if child is None:
                node[1][key[pos]] = leaf = [key[pos:], {}, None]
                return leaf
            label = child[0]
            if not key.startswith(label, pos):
                n = _shared(label, key, pos)
                upper = [label[:n], {label[n]: child}, None]
                child[0] = label[n:]
                node[1][key[pos]] = upper
                child = upper
            pos += len(child[0])
            node = child
        return node

    def count(self, key: bytes) -> None:
        first = key[0] if key else -1
        self.held[first] = self.held.get(first, 0) + len(key)

    def spill(self) -> list:
        """Cut off the largest subtree of the root and return its values."""
        first = max(self.held, key=self.held.get)
        self.held.pop(first)
        if first == -1:
            value, self.root[2] = self.root[2], None
            return [value]
        return list(values(self.root[1].pop(first)))


def _shared(label: bytes, key: bytes, pos: int) -> int:
    """Length of the common prefix of ``label`` and ``key[pos:]``, found by halving."""
    low, high = 0, min(len(label), len(key) - pos)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[pos + low : pos + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def values(node: list) -> Iterator:
    todo = [node]
    while todo:
        x = todo.pop()
        if x[2] is not None:
            yield x[2]
        todo.extend(x[1].values())


def content_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _better(a: dict, b: dict, largest: bool) -> bool:
    """Whether row a stays rather than row b."""
    x, y = a["doc_id"], b["doc_id"]
    return y is None and x is not None if x is None or y is None else (x > y if largest else x < y)


def _local(rows: pa.DataType, schema: pa.Schema, largest: bool, hashed: Callable[[bytes], int], budget: int):
    def emit(found: list) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([x[k] for x in found], t) for k, t in (("len", pa.int64()), ("hash", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("key", pa.binary()), ("row", rows))], schema=schema
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size = Trie(), 0
        for batch in batches(it):
            taken = batch.column("row").to_pylist()
            for row in taken:
                key = (row["text"] or "").encode().lower()
                node = trie.node(key)
                if node[2] is None:
                    node[2] = {"len": len(key), "hash": hashed(key), "sha": hashlib.sha256(key).hexdigest(), "n": 1, "key": key, "row": row}
                    trie.count(key)
                    size += len(key) + 200
                else:
                    node[2]["n"] += 1
                    if _better(row, node[2]["row"], largest):
                        node[2]["row"] = row
            while size > budget:
                out = trie.spill()
                size -= sum(x["len"] + 200 for x in out)
                yield emit(out)
        found = list(values(trie.root))
        for i in range(0, len(found), 500):
            yield emit(found[i : i + 500])

    return run


def _owners(schema: pa.Schema, largest: bool, budget: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, at, digests = Trie(), 0, None, set()

        def emit(found: list) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found), 500):
                part = found[i : i + 500]
                yield pa.record_batch([pa.array([x[f.name] for x in part], f.type) for f in schema], schema=schema)

        for batch in batches(it):
            for x in batch.to_pylist():
                if at != (x["len"], x["hash"]):
                    at, digests = (x["len"], x["hash"]), set()
                node = trie.node(x["key"])
                if node[2] is None:
                    if x["sha"] in digests:
                        raise ValueError("two different texts of one length share a SHA-256 digest")
                    digests.add(x["sha"])
                    node[2] = x
                    trie.count(x["key"])
                    size += x["len"] + 200
                else:
                    node[2]["n"] += x["n"]
                    if _better(x["row"], node[2]["row"], largest):
                        node[2]["row"] = x["row"]
            while size > budget:
                out = trie.spill()
                stay = [x for x in out if (x["len"], x["hash"]) == at]  # more of these may come
                done = [x for x in out if (x["len"], x["hash"]) != at]
                for x in stay:
                    trie.node(x["key"])[2] = x
                    trie.count(x["key"])
                size -= sum(x["len"] + 200 for x in done)
                yield from emit(done)
                if not done:
                    break
        yield from emit(list(values(trie.root)))

    return run


def _entries(docs: DataFrame, keep: str, hashed: Callable[[bytes], int], budget: int) -> DataFrame:
    """One row for each different text: len, sha, n, row (the document that stays)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    largest, schema = keep == "largest", docs.schema
    full = T.StructType([T.StructField("len", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("row", schema)])
    short = T.StructType([f for f in full if f.name not in ("hash", "key")])
    from pyspark.sql.pandas.types import to_arrow_schema

    a, b = to_arrow_schema(full), to_arrow_schema(short)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    local = rows.mapInArrow(_local(a.field("row").type, a, largest, hashed, budget), full)
    dealt = local.repartition("len", "hash").sortWithinPartitions("len", "hash")
    return dealt.mapInArrow(_owners(b, largest, budget), short)


def representatives(docs: DataFrame, keep: str = "smallest", hashed: Callable[[bytes], int] = content_hash, budget: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts (after lower-casing A-Z) the one with the smallest or largest doc_id."""
    return _entries(docs, keep, hashed, budget).select("row.*")


def exact_groups(docs: DataFrame, keep: str = "smallest", hashed: Callable[[bytes], int] = content_hash, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    groups = _entries(docs, keep, hashed, budget).select("len", "sha", F.col("n").alias("group_size"), F.col("row.doc_id").alias("keep_id"))
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", F.octet_length(low).cast("long").alias("len"), F.sha2(low, 256).alias("sha"))
    # the hot side of this join (one text's copies) is one that adaptive execution can split
    joined = rows.join(groups, ["len", "sha"])
    again = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("len"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
