"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A corpus is a folder of shards. Shard ``i`` holds the documents of the i-th
range of ids, in ascending order:

* ``ids-<i>-<attempt>.bin``: the ids of all its documents one after another,
  little-endian, 16 bits wide if the vocabulary allows it, else 32;
* ``idx-<i>-<attempt>.bin``: two little-endian int64 arrays of equal length,
  document ids and the offset *after* each document, counted in the shard.

``manifest`` is a Parquet table with one row for each shard: its file names,
its sizes and its base, which is the number of ids in all shards before it (a
prefix sum over shards). A document's place in the corpus is its shard's base
plus its local offset, so all files can be memory-mapped and read by position.

A retried task writes under another attempt number; the manifest names only
what the job's result named, so a lost executor leaves at most unused files.

Cases: null and empty texts hold the end id alone; null ids come first;
repeated ids stand side by side in the order of their texts; an empty table
gives a manifest of no rows. Other columns are not read. Special tokens that
stand in a text get their own ids, as the tokenizer does by itself. Where a
tokenizer is not known to allow cutting texts into parts, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, shared_dir, small_batches

#: Text up to a change from other characters to white space. In this vocabulary's
#: pre-tokenizer no piece goes on from a character into the white space after it
#: and none looks behind, so these parts encode alone as they do in their text.
PART = re.compile(r"\s*\S+|\s+")
#: What texts must not have for their parts to be cut at single spaces and line
#: ends: white space that is neither, or next to other white space, or outermost.
UNEVEN = r"[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A[ \n]|[ \n]\z"
#: Parts that the pre-tokenizer cuts as these groups are: letters, then marks.
PLAIN = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+)([.,;:!?]*)")
#: Parts whose ids a worker keeps, in each of two generations.
KEPT_PARTS = 300_000
#: Bytes of text whose parts are looked up together.
GATHERED = 4 << 20

SHARD = "shard int, ids_file string, idx_file string, n_docs long, n_tokens long"


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def _cuts_at_spaces(tokenizer: dict) -> bool:
    """Whether texts may be cut into parts: that is known of byte-level pair encoding with its own pattern,
    without a normalizer, and with special tokens that have no white space and take none in."""
    before, model = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    model_plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    marked = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in tokenizer.get("added_tokens", []))
    return bool(plain and model_plain and marked and not tokenizer.get("normalizer"))


class Encoder(dict):
    """Ids of texts, each followed by the end id. As a dict it holds the ids of parts met lately.

    Most parts of a text were met before. So texts are cut into parts, equal
    parts are found by Arrow, the ids of each different part are looked up, or
    else encoded, and numpy lays out the ids of all texts.
    """

    def __init__(self, path: str, end_id: int, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parted = _cuts_at_spaces(json.loads(self.tokenizer.to_str()))
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.end, self.dtype = end_id, np.dtype(dtype)
        self.code = self.dtype.char
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _encode(self, part: str) -> list[int]:
        plain = PLAIN.fullmatch(part)
        if not plain:
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        lead, word, marks = plain.groups()
        found = self._piece(lead) + self._piece(word) if lead == "\n" else self._piece(lead + word)
        return found + self._piece(marks) if marks else found

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = array(self.code, self._encode(part)).tobytes()
        self[part] = ids
        return ids

    def _age(self) -> None:
        if len(self) > KEPT_PARTS:
            self.older = dict(self)
            self.clear()

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that have nothing :data:`UNEVEN`, by their parts.

        A line end is put before each text and becomes the last id of the text
        before it; line ends get a space before them, at which all is cut.
        """
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", texts, "\n"), "\n", " \n"), " ")
        parts = cut.flatten()
        first = np.asarray(cut.offsets)
        coded = parts.dictionary_encode()
        # a text begins with the empty part before its first line end
        known = [self[p if p[:1] == "\n" else " " + p] if p else b"" for p in coded.dictionary.to_pylist()]
        self._age()
        which = np.asarray(coded.indices)
        ids = np.frombuffer(b"".join(known), self.dtype)
        sizes = np.array([len(k) for k in known], np.int64) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        many = sizes[which]
        ends = np.cumsum(many)
        out = ids[np.repeat(starts[which] - ends + many, many) + np.arange(ends[-1])]
        at = np.concatenate([[0], ends])[first]
        out = np.append(out[1:], self.dtype.type(self.end))
        out[at[1:-1] - 1] = self.end
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not self.parted:
            return [np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end], self.dtype) for t in texts.to_pylist()]
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        out: list[np.ndarray] = [None] * len(texts)
        places = np.flatnonzero(np.asarray(even))
        if len(places):
            for k, ids in zip(places, self._even(texts.filter(even)), strict=True):
                out[k] = ids
        for k in np.flatnonzero(~np.asarray(even)):
            found = b"".join(map(self.__getitem__, PART.findall(texts[k].as_py())))
            out[k] = np.append(np.frombuffer(found, self.dtype), self.dtype.type(self.end))
            self._age()
        return out


#: A worker process serves many tasks, one after another.
_encoders: dict[tuple, Encoder] = {}


def _encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, in tables of about :data:`GATHERED` bytes."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def id_width(tokenizer_path: str) -> str:
    """``<u2`` where each id of the vocabulary fits in 16 bits, else ``<u4``."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as a corpus under ``out_dir``; return its manifest.

    The one shuffle deals texts by ranges of ids. Each task streams its range
    into its shard; only a row for each shard reaches the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dtype = id_width(tokenizer_path)
    fs, root = _filesystem(out_dir)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        fs, root = _filesystem(out_dir)
        encoder, out, ids, ends, total = None, None, [], [], 0
        for some in _gathered(batches):
            if encoder is None:
                encoder, out = _encoder(tokenizer_path, end_id, dtype), fs.open_output_stream(f"{root}/ids-{name}")
            coded = encoder.texts(some.column(1).combine_chunks())
            lengths = np.array([len(x) for x in coded], np.int64)
            ids.append(some.column(0).fill_null(np.iinfo(np.int64).min).to_numpy().astype("<i8"))
            ends.append(total + np.cumsum(lengths))
            total += int(lengths.sum())
            out.write(np.concatenate(coded).tobytes())
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/idx-{name}") as f:
                f.write(np.concatenate(ids).tobytes())
                f.write(np.concatenate(ends).astype("<i8").tobytes())
            encoder.older = {}
            give_back()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "ids_file": [f"ids-{name}"], "idx_file": [f"idx-{name}"], "n_docs": [sum(map(len, ids))], "n_tokens": [total]})

    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    shards = sorted(ranged.mapInArrow(write, SHARD).collect())
    bases = np.concatenate([[0], np.cumsum([s.n_tokens for s in shards], dtype=np.int64)])
    rows = [(s.shard, s.ids_file, s.idx_file, s.n_docs, s.n_tokens, int(b), dtype) for s, b in zip(shards, bases, strict=False)]
    spark.createDataFrame(rows, f"{SHARD}, base long, dtype string").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def open_shard(out_dir: str, ids_file: str, idx_file: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's document ids, its n+1 offsets and its ids; mapped, not read, where the store has local paths."""
    fs, root = _filesystem(out_dir)

    def array(name: str, kind: str) -> np.ndarray:
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(f"{root}/{name}", kind, "r")
        with fs.open_input_file(f"{root}/{name}") as f:
            return np.frombuffer(f.read(), kind)

    idx = array(idx_file, "<i8")
    n = len(idx) // 2
    return idx[:n], np.concatenate([[0], idx[n:]]), array(ids_file, dtype)


def read_tokens(spark: SparkSession, out_dir: str) -> DataFrame:
    """What a corpus holds, from its files: ``doc_id, start, n_tokens, ids_crc32``, one row for each document.

    ``start`` counts the ids of all documents before it; the checksum is
    CRC-32 over the document's ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = open_shard(out_dir, row["ids_file"], row["idx_file"], row["dtype"])
                for a in range(0, len(docs), 10_000):
                    at = offsets[a : a + 10_001]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
                    own = docs[a : a + 10_000]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, mask=own == np.iinfo(np.int64).min), "start": row["base"] + at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    shards = spark.read.parquet(f"{out_dir}/manifest")
    return shards.repartition(max(1, spark.sparkContext.defaultParallelism * 4)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as a corpus (in the shared folder unless told where) and return what reads back."""
    where = out_dir or shared_dir(docs.sparkSession)
    write_tokens(docs, where, tokenizer_path, **options)
    return read_tokens(docs.sparkSession, where)
