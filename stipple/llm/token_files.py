"""Flat files of token ids with 64-bit document offsets, written in ascending id order and read back by memory map.

Layout of a folder: for each partition ``part-NNNNN.bin`` (unsigned ids, little
endian, documents one behind the other), ``.off`` (int64: the first id of each
document within the file, then the number of ids), ``.doc`` (int64 document
ids, 0 where null) and ``.nul`` (one byte a document, 1 where its id is null).
``index.json`` holds the id width and each partition's document and id counts
with their prefix sums, so a document starts at its partition's base plus its
own offset. Documents with a null id come first; ties are in the order of their
texts.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, parts, table
from .tokens import encoder


#: Characters of a text that ranges are cut by; samples of them go to the driver.
BRIEF = 64


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, width: int = 2, mode: str = "word") -> dict:
    """Encode every whole text, append ``end_id``, write the files; returns the index.

    ``folder`` is a URI that all executors reach. Each file is written under the
    attempt's own name and then moved, so a repeated task leaves whole files only.
    Null and empty texts become the end id alone; repeated rows are documents each; an
    empty table gives an index without documents; other columns are not read. The
    driver gets one row for each partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = TaskContext.get()
        enc, end = encoder(tokenizer, mode, width), end_id.to_bytes(width, "little")
        files, root = _place(folder)
        name = f"{root}/part-{where.partitionId():05d}"
        temp = f"{root}/.{where.partitionId():05d}-{where.taskAttemptId()}"
        offsets, ids, nulls = array("q", [0]), array("q"), bytearray()
        with files.open_output_stream(f"{temp}.bin") as out:
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                    body = enc.encode(text) + end
                    out.write(body)
                    offsets.append(offsets[-1] + len(body) // width)
                    nulls.append(doc is pd.NA)
                    ids.append(0 if doc is pd.NA else doc)
        for kind, data in (("off", np.array(offsets, "<i8")), ("doc", np.array(ids, "<i8")), ("nul", np.frombuffer(nulls, "u1"))):
            with files.open_output_stream(f"{temp}.{kind}") as out:
                out.write(data.tobytes())
        for kind in ("off", "doc", "nul", "bin"):
            files.move(f"{temp}.{kind}", f"{name}.{kind}")
        yield pd.DataFrame({"part": [where.partitionId()], "docs": [len(ids)], "ids": [offsets[-1]]})

    files, root = _place(folder)
    files.create_dir(root, recursive=True)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # rows that share an id, or have none, are dealt on by the beginnings of their texts, which do not grow with them
    ranges = [order[0], F.substring("text", 1, BRIEF).asc_nulls_first()]
    dealt = narrow.repartitionByRange(parts(docs.sparkSession), *ranges).sortWithinPartitions(*order)
    done = sorted(map(tuple, dealt.mapInPandas(run, "part int, docs long, ids long").collect()))
    docs_before = [0, *accumulate(n for _, n, _ in done)]
    ids_before = [0, *accumulate(n for _, _, n in done)]
    index = {"width": width, "parts": [{"part": p, "docs": d, "ids": n, "docs_before": a, "ids_before": b} for (p, d, n), a, b in zip(done, docs_before, ids_before, strict=False)]}
    with files.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _map(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if not files.get_file_info(path).size:
        return np.empty(0, dtype)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document from the files; start counts the ids of all documents before it.

    Files of a local folder are memory-mapped; of another store a task reads one partition's at a time.
    """
    files, root = _place(folder)
    with files.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.read())
    width, bases = index["width"], {p["part"]: p["ids_before"] for p in index["parts"]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _place(folder)
        for pdf in batches:
            for part in pdf["id"]:
                name = f"{root}/part-{part:05d}"
                flat = _map(files, f"{name}.bin", f"<u{width}")
                off, doc, nul = _map(files, f"{name}.off", "<i8"), _map(files, f"{name}.doc", "<i8"), _map(files, f"{name}.nul", "u1")
                for at in range(0, len(doc), 2000):
                    upto = min(len(doc), at + 2000)
                    yield pd.DataFrame({
                        "doc_id": pd.Series(doc[at:upto], dtype="Int64").mask(nul[at:upto] == 1),
                        "start": bases[part] + off[at:upto],
                        "n_tokens": off[at + 1 : upto + 1] - off[at:upto],
                        "ids": [flat[a:b].astype("<u4").tobytes() for a, b in zip(off[at:upto], off[at + 1 : upto + 1], strict=True)],
                    })

    which = sorted(bases)
    tasks = spark.range(0, which[-1] + 1 if which else 0, 1, max(1, len(which))).where(F.col("id").isin(which) if len(which) <= (which or [0])[-1] else F.lit(True))
    return tasks.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` written as unsigned 16-bit ids in ascending doc_id order and read back from the files."""
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
