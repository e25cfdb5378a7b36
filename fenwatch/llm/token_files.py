"""Token-ID output: Arrow files of fixed-size-list batches, with zero-copy random access to equal-length sequences and masks.

A shard is an Arrow file (the stream format with a footer) of record batches with the columns input_ids and mask, both
fixed-size lists of seq_len; only the last sequence of a shard is padded, and its mask is false there. Beside it lies
an index file with the documents of the shard: doc_id, start (in the shard) and n_tokens. Shards cover ranges of
doc_id in ascending order, so that a position in the whole corpus is the shard's base plus a position in the shard.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import open_store, shared_dir, tidied, written

SEQ_LEN = 2048
#: Sequences in a record batch.
BATCH = 512
#: A worker keeps the ids of so many text pieces before it starts anew.
KEPT_PIECES = 700_000


#: The pre-tokenizer's contractions, and characters whose classes are alike in all Unicode versions: visible ASCII, and Latin letters.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


class Pieces(dict):
    """Ids of text pieces, as little-endian bytes, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.make(piece)
        return ids


class Encoder:
    """Encodes texts with a tokenizers file whose pre-tokenizer is byte-level, keeping the ids of text pieces.

    A byte-level pre-token holds a space or line feed only in front, so a text may be cut before every space or line
    feed that follows a character other than white space without changing its ids. Pieces repeat far more often than
    texts, so most need no encoding. New pieces of plain characters are cut into pre-tokens here and go to the
    tokenizer's model alone; all others, and texts with white space of other kinds or in a row, go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError("the pieces of a text are only independent with a byte-level pre-tokenizer without prefix space")
        n = max(self.tok.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.line_feed = self.ids("\n")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(n)]
        self.spaced, self.bare, self.tokens = Pieces(partial(self._piece, " ")), Pieces(partial(self._piece, "")), Pieces(self._token)
        self.tokenize = self.tok.model.tokenize
        self.cut = re.compile(r"(?<=\S)(?=[ \n])").split
        self.plain = re.compile(f"[!-~{LETTERS}]+").fullmatch
        self.pretokens = re.compile(f"{'|'.join(CONTRACTIONS)}| ?[{LETTERS}]+| ?[0-9]+| ?[^ 0-9{LETTERS}]+").findall
        # a byte as the visible character that stands for it in the vocabulary
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.shown = {b: chr(256 + k) for k, b in enumerate(hidden)}
        # strings that the tokenizer takes out before it cuts a text
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.whole = spec["normalizer"] is not None or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE"

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _token(self, pre: str) -> bytes:
        """Ids of a pre-token."""
        shown = pre.replace(" ", self.shown[32]) if pre.isascii() and pre.isprintable() else pre.encode().decode("latin-1").translate(self.shown)
        packed, found = self.packed, self.tokenize(shown)
        return packed[found[0].id] if len(found) == 1 else b"".join([packed[t.id] for t in found])

    def _piece(self, before: str, piece: str) -> bytes:
        """Ids of a piece without white space, after a space or nothing."""
        if self.whole:
            return self.ids(before + piece)
        if piece.isascii():
            if piece.isalpha():
                return self._token(before + piece)
            if piece[:-1].isalpha():  # a word and a mark or digit, which are pre-tokens of their own
                return (self.spaced if before else self.bare)[piece[:-1]] + self.tokens[piece[-1]]
        elif not self.plain(piece):
            return self.ids(before + piece)
        return b"".join(map(self.tokens.__getitem__, self.pretokens(before + piece)))

    def encode(self, texts: list[str], kept: int = KEPT_PIECES) -> list[bytes]:
        """The ids of each text, as little-endian bytes."""
        if len(self.spaced) + len(self.bare) + len(self.tokens) > kept:
            for pieces in (self.spaced, self.bare, self.tokens):
                pieces.clear()
        spaced, bare, out = self.spaced.__getitem__, self.bare.__getitem__, []
        for text in texts:
            lines = text.split("\n")
            if any(a in text for a in self.added):
                out.append(self.ids(text))
            elif "" in lines or not all(map(str.isprintable, lines)) or "  " in text or text[:1] == " " or text[-1:] == " " or " \n" in text or "\n " in text:
                out.append(b"".join(map(self.ids, self.cut(text))) if text else b"")
            else:
                parts = [x.split(" ") for x in lines]
                out.append(self.line_feed.join([bare(p[0]) + b"".join(map(spaced, p[1:])) for p in parts]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    """Packs documents' ids into sequences and writes them, with the index beside them."""

    def __init__(self, path: str, dtype: np.dtype, key: pa.DataType, seq_len: int) -> None:
        store, at = open_store(path)
        store.create_dir(at.rpartition("/")[0])
        self.seq_len, self.dtype, self.kind = seq_len, dtype, pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = store.open_output_stream(at)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.index_sink = store.open_output_stream(f"{at}.index")
        self.index_schema = pa.schema([("doc_id", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.buffer: list[bytes] = []
        self.held = self.total = self.docs = 0

    def add(self, keys: list, ids: list[bytes]) -> None:
        width = self.dtype.itemsize
        sizes = np.array([len(x) // width for x in ids], dtype=np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys, type=self.index_schema.field(0).type), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.buffer += ids
        self.held += int(sizes.sum())
        self.total += int(sizes.sum())
        self.docs += len(keys)
        if self.held >= BATCH * self.seq_len:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.buffer), dtype=self.dtype)
        n = -(-len(ids) // self.seq_len) if last else len(ids) // self.seq_len
        full, rest = ids[: n * self.seq_len], ids[n * self.seq_len :]
        for k in range(0, n, BATCH):
            part = full[k * self.seq_len : (k + BATCH) * self.seq_len]
            size = min(BATCH, n - k) * self.seq_len
            padded = np.concatenate([part, np.zeros(size - len(part), dtype=self.dtype)]) if len(part) < size else part
            mask = np.arange(size) < len(part)
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)], schema=self.schema))
        self.buffer, self.held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.index.close()
        self.sink.close()
        self.index_sink.close()


class Shard:
    """Random access to the sequences of a shard. On a local disk the file is mapped, and sequences are views of it."""

    def __init__(self, path: str) -> None:
        store, at = open_store(path)
        self.source = pa.memory_map(at) if isinstance(store, pa.fs.LocalFileSystem) else store.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.index_file = pa.ipc.open_file(store.open_input_file(f"{at}.index"))
        self.seq_len = self.file.schema.field("input_ids").type.list_size

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * BATCH + self.file.get_batch(n - 1).num_rows if n else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The ids of sequence i (without a copy) and its mask."""
        batch = self.file.get_batch(i // BATCH)
        k = i % BATCH
        return batch.column(0)[k].values.to_numpy(zero_copy_only=True), batch.column(1)[k].values

    def blocks(self) -> Iterator[np.ndarray]:
        """All ids in order, without padding, a record batch at a time."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            last = k == self.file.num_record_batches - 1
            yield ids[: batch.column(1).flatten().to_numpy(zero_copy_only=False).sum()] if last else ids

    def documents(self) -> Iterator[tuple[list, list[int], list[int]]]:
        for k in range(self.index_file.num_record_batches):
            batch = self.index_file.get_batch(k)
            yield tuple(batch.column(x).to_pylist() for x in range(3))

    def close(self) -> None:
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int = SEQ_LEN, key: str = "doc_id", text: str = "text", kept_pieces: int = KEPT_PIECES) -> DataFrame:
    """Writes all documents' ids, each followed by end_id, in ascending key order; returns the manifest.

    The manifest (path, base, n_tokens, n_docs) is a small DataFrame in the order of shards. Null keys come first;
    equal keys go by their text's hash, and rows that repeat are documents of their own. Null texts are empty: their
    only id is end_id. Other columns are ignored. An empty table gives an empty manifest. The tokenizer's file must be
    readable on every worker. A worker keeps the ids of kept_pieces pieces of text at most, about 200 bytes each.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, path, first = None, f"{folder}/{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            if not batch.num_rows:
                continue
            enc = encoder(tokenizer)
            end = np.array([end_id], dtype=enc.dtype).tobytes()
            if made is None:
                made = ShardWriter(path, enc.dtype, batch.schema.field("key").type, seq_len)
                first = batch.slice(0, 1)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made.add(part.column("key").to_pylist(), [x + end for x in enc.encode(part.column("text").to_pylist(), kept_pieces)])
        if made is not None:
            made.close()
            yield pa.RecordBatch.from_arrays([first.column("key"), first.column("tie"), pa.array([path]), pa.array([made.total], pa.int64()), pa.array([made.docs], pa.int64())], names=["key", "tie", "path", "n_tokens", "n_docs"])

    from pyspark.sql import types as T

    schema = T.StructType().add("key", kind).add("tie", "long").add("path", "string").add("n_tokens", "long").add("n_docs", "long")
    shards = written(ranged.mapInArrow(tidied(write), schema), "token-shards").orderBy("key", "tie").collect()  # a row per partition
    base, out = 0, []
    for s in shards:
        out.append((s["path"], base, s["n_tokens"], s["n_docs"]))
        base += s["n_tokens"]
    return spark.createDataFrame(out, "path string, base long, n_tokens long, n_docs long")


def read_tokens(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """Per document, from the files: doc_id, start in the whole corpus, n_tokens, and the unsigned crc32 of its ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                blocks, block, at = shard.blocks(), np.zeros(0), 0
                for keys, starts, sizes in shard.documents():
                    crcs = []
                    for n in sizes:
                        crc = 0
                        while n:
                            if at == len(block):
                                block, at = next(blocks), 0
                            part = block[at : at + n]
                            crc = zlib.crc32(part.astype("<u4").data, crc)
                            at += len(part)
                            n -= len(part)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, type=shard.index_file.schema.field(0).type), pa.array(np.array(starts, dtype=np.int64) + base), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n).mapInArrow(tidied(read), f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


#: The tokenizer of the query, and the id that ends a document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path(TOKENIZER), END_ID))
