"""Encoding of a corpus by a public byte-level BPE vocabulary, and decoding (problem 8).

A text of up to chunk_chars is one chunk and is encoded where it is read. A longer one is cut into chunks that overlap;
the chunks are pre-tokenised in parallel, each from its own start. In the overlap of two chunks the later one's
boundaries, which begin at an arbitrary cut, fall in with the earlier one's: from a boundary common to both on they are
the same for ever, as each pre-token depends only on the text after its start. The text is cut anew at those common
boundaries, the pieces are encoded in parallel, and their ids put together. Chunks whose overlap holds no common boundary
(a pre-token longer than it) become one chunk, which is pre-tokenised again; the others of the document stay as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.tables import written

#: Fixed value: the pattern that splits text before the merges of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters before the end of a chunk within which a boundary may be due to the cut.
MARGIN = 8
_SPLIT = regex.compile(PATTERN)
_BLANK = regex.compile(r"\s")


@cache
def vocabulary(path: str):
    """The encoding of a file of ranks (base64 bytes and rank a line), loaded once in each process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> list[int]:
    """Ids of a text; strings of special tokens are ordinary text."""
    coder = vocabulary(path)
    try:
        return coder.encode_ordinary(text)
    except BaseException as e:  # the matcher's stack is too small for a run of blanks of this length; it says so by a panic
        if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
            raise
        return [i for piece in _SPLIT.findall(text) for i in coder._encode_single_piece(piece.encode())]


def _chunks(chunk: int, overlap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)  # what an overlap holds is no chunk of its own
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(starts), pa.int64()),
                        pa.array([mark] * len(starts), pa.int64()),
                        pa.array(list(starts), pa.int64()),
                        pa.array([chunk] * len(starts), pa.int64()),
                        pa.array([text[s : s + chunk + overlap] for s in starts], pa.large_string()).cast(pa.string()),
                    ],
                    ["id", "mark", "start", "size", "text"],
                )

    return rows


def boundaries(text: str, start: int, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts of the pre-tokens of a chunk that lie in the overlap with the chunk before and with the one after, which
    begins `size` characters on. A blank that something else follows is looked at together with it, so no cut lies
    between the two."""
    sure = len(text) - (MARGIN if len(text) > size else 0)
    found = [m.start() for m in _SPLIT.finditer(text)]
    cut = lambda b: not _BLANK.match(text, b - 1) or _BLANK.match(text, b)
    head = [start + b for b in found if 0 < b < overlap and b < sure and cut(b)]
    tail = [start + b for b in found if size < b < sure and cut(b)]
    return head, tail


def _pretokenised(overlap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [boundaries(t, s, n, overlap) for s, n, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            spots = pa.list_(pa.int64())
            arrays = [*batch.columns, pa.array([h for h, _ in both], spots), pa.array([t for _, t in both], spots)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "head", "tail"])

    return rows


def _encoded(path: str, rows_at_once: int = 512):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids = [encode(path, t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
                arrays = [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "ids"])

    return rows


def _same(columns: list[str]):
    return F.expr(" and ".join(f"c.{k} <=> s.{k}" for k in columns))


def encoded(documents: DataFrame, id: str, text: str, path: str, chunk_chars: int = 16_384, overlap: int = 512) -> DataFrame:
    """(id, ids): the token ids of each document's whole text, without special tokens.

    documents: a bigint `id` and a string `text`; other columns are ignored, whatever their names. Null and empty texts
    have an empty list. Rows that repeat an id, with the same text or another, have a row each. An empty table gives an
    empty one. path: a file of ranks that every executor has. Only texts above chunk_chars characters are shuffled, as
    chunks by (id, hash of the text, start), equal ones once, and then as pieces of ids. Their chunks are written to the
    shared folder, once and once more for each time that some had to be joined.
    """
    if overlap >= chunk_chars or overlap <= MARGIN:
        raise ValueError("overlap must lie between MARGIN and chunk_chars")
    docs = documents.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_encoded(path), "id long, ids array<int>")
    long = docs.where(is_long).select("id", F.xxhash64("text").alias("mark"), "text")
    key = ["id", "mark"]
    parts = long.mapInArrow(_chunks(chunk_chars, overlap), "id long, mark long, start long, size long, text string")
    apart = parts.groupBy(*key, "start").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    schema = "id long, mark long, start long, size long, copies long, text string"
    cut = written(apart.mapInArrow(_pretokenised(overlap), f"{schema}, head array<long>, tail array<long>"), "chunks")
    by_start = Window.partitionBy(*key).orderBy("start")
    while True:
        joints = cut.select(*key, "start", "head", "tail").withColumn("common", F.array_intersect(F.lag("tail").over(by_start), "head"))
        begin = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.try_element_at("common", F.lit(1)))
        joints = joints.select(*key, "start", begin.alias("begin"))
        if joints.where("begin is null").isEmpty():
            break
        # Each chunk that doesn't join on becomes part of the one before.
        runs = joints.select(*key, "start", F.count("begin").over(by_start).alias("run")).withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*key, "run")) == 1)
        marked = cut.alias("c").join(runs.alias("s"), _same([*key, "start"])).select("c.*", "run", "alone")
        pieces = F.array_sort(F.collect_list(F.struct("start", "size", "text")))
        merged = marked.where("not alone").groupBy(*key, "run").agg(F.max("copies").alias("copies"), pieces.alias("p"))
        whole = F.array_join(F.transform("p", lambda x, i: F.when(i == F.size("p") - 1, x["text"]).otherwise(F.substring(x["text"], F.lit(1), x["size"].cast("int")))), "")
        size = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + x["size"])
        anew = merged.select(*key, F.get("p", F.lit(0))["start"].alias("start"), size.alias("size"), "copies", whole.alias("text"))
        again = anew.mapInArrow(_pretokenised(overlap), f"{schema}, head array<long>, tail array<long>")
        cut = written(marked.where("alone").drop("run", "alone").unionByName(again), "chunks")
    ends = joints.withColumns({"end": F.lead("begin").over(by_start), "final": F.lead("start").over(by_start).isNull()})
    length = F.when(F.col("final"), F.lit(2**31 - 1)).otherwise(F.col("end") - F.col("begin")).cast("int")
    pieces = cut.select(*key, "start", "copies", "text").alias("c").join(ends.alias("s"), _same([*key, "start"])).select(
        *[f"c.{k}" for k in key], "c.start", "copies", F.substring(F.col("text"), (F.col("begin") - F.col("c.start") + 1).cast("int"), length).alias("piece")
    )
    coded = pieces.mapInArrow(_encoded(path), "id long, mark long, start long, copies long, ids array<int>")
    joined = coded.groupBy(*key).agg(F.max("copies").alias("copies"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda p: p["ids"])).alias("ids"))
    stitched = joined.select("id", F.explode(F.array_repeat("ids", F.col("copies").cast("int"))).alias("ids"))
    return short.unionByName(stitched).withColumnRenamed("id", id)


def decoded(tokens: DataFrame, id: str, ids: str, path: str) -> DataFrame:
    """(id, text): the texts of lists of ids, their raw bytes put together; a null list gives a null text. Bytes that
    aren't UTF-8 (a list cut inside a character) become U+FFFD."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else coder.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id, "text"])

    return tokens.select(F.col(f"`{id}`").cast("bigint"), F.col(f"`{ids}`").cast("array<int>")).mapInArrow(rows, f"`{id}` long, text string")
