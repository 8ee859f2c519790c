"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but 16- or 32-bit little-endian identifiers, document after document, each followed
by the end-of-document identifier.  Files are scanned in blocks that know nothing of each other: a vectorised
search finds the separators of a block.  A prefix scan over the blocks' few numbers (how many
separators, where the last) then gives every separator its rank in the file and its predecessor, also across
block boundaries, so a document's length is the distance of two separators.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import common

#: Identifiers in a block, and roughly the most in a file.
BLOCK, FILE = 4_000_000, 64_000_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with fs.FileSystem.from_uri(path)[0].open_input_stream(fs.FileSystem.from_uri(path)[1]) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str) -> list[int]:
    """Identifiers of a text; what looks like a special token is ordinary text."""
    return _encoding(vocabulary).encode_ordinary(text) if text else []


def write_tokens(docs: DataFrame, path: str, vocabulary: str, eod: int = 50256, dtype: str = "<u2", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files under path; returns the order (file, ordinal, doc_id, tokens) of their documents.

    A file's name is new in every attempt of a task, and only files of attempts that ended are in the result, so a lost
    executor leaves at most a file that nothing reads.  `tokens` is the file's size.  A null text counts as empty.  The vocabulary is
    a path or address on the driver; the file goes to the executors with the job.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    shipped = vocabulary.rstrip("/").rsplit("/", 1)[-1]
    two = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        ranks = SparkFiles.get(shipped)
        for group in _files(batches):
            name = f"{root}/{uuid.uuid4().hex}.bin"
            total, ids = 0, []
            with system.open_output_stream(name) as out:
                for col, texts in group:
                    ids.append(col)
                    for t in texts:
                        x = np.array([*encode(t.as_py(), ranks), eod], dtype)
                        total += len(x)
                        out.write(x.tobytes())
            n = sum(map(len, ids))
            order = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n)), order, pa.array(np.full(n, total))], names=["file", "ordinal", "doc_id", "tokens"]
            )

    return common.materialise(two.mapInArrow(run, f"file string, ordinal long, doc_id {two.schema['doc_id'].dataType.simpleString()}, tokens long"), "token-order")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[pa.Array, pa.Array]]]:
    """Groups of slices of about FILE bytes of text, taken one after the other."""
    stream = ((b.column(0).slice(i, 512), b.column(1).slice(i, 512)) for b in batches for i in range(0, b.num_rows, 512))
    first = next(stream, None)
    while first is not None:
        rest: list = []

        def group(head=first, left=FILE):
            yield head
            left -= head[1].nbytes
            for x in stream:
                if left <= 0:
                    rest.append(x)
                    return
                left -= x[1].nbytes
                yield x

        yield group()
        first = rest[0] if rest else next(stream, None)


def separators(files: DataFrame, uri: str, eod: int = 50256, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, end, length) of every document in files (file, tokens): end is its separator's place.

    uri says which file system the names belong to.  Identifiers after the last separator belong to no document.
    """
    parts = files.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("tokens", F.lit(1)) - 1) / block).cast("long"))).alias("block"))
    parts = parts.repartition("file", "block")
    wide = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for name, tokens, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with system.open_input_file(name) as f:
                    x = np.frombuffer(f.read_at(min(block, tokens - b * block) * wide, b * block * wide), dtype)
                at = np.flatnonzero(x == eod) + b * block
                if n := len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.full(n, b)), pa.array(np.arange(n)), pa.array(at), pa.array(np.append(-1, at[:-1]), mask=np.arange(n) == 0)],
                        names=["file", "block", "k", "end", "previous"],
                    )

    found = common.materialise(parts.mapInArrow(run, "file string, block long, k long, end long, previous long"), "token-ends")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    ahead = ahead.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(order), F.lit(-1)).alias("reached"))
    out = found.join(ahead, ["file", "block"])
    return out.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "end", (F.col("end") - F.coalesce("previous", "reached") - 1).alias("length"))


def token_counts(docs: DataFrame, vocabulary: str, eod: int = 50256, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens), one row per row of docs: encodes to flat files in the shared folder and counts there.

    Null and empty texts have 0 tokens.  A null doc_id is a row like others.  The vocabulary must not use `eod`.
    """
    uri = common.scratch_path(docs.sparkSession, "tokens")
    order = write_tokens(docs, uri, vocabulary, eod, dtype)
    files = order.groupBy("file").agg(F.max("tokens").alias("tokens"))
    found = separators(files, uri, eod, dtype, block)
    return order.join(found, ["file", "ordinal"]).select("doc_id", F.col("length").alias("n_tokens"))
