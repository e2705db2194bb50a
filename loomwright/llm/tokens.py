"""Token ids in Arrow stream files of equal-length sequences with masks.

Documents are dealt out by ranges of doc_id and sorted; each range becomes one shard: an Arrow stream whose
batches hold two fixed-size lists, ``ids`` (uint16 where the vocabulary allows, else uint32) and ``mask`` (uint8, 1 for real ids), beside an Arrow stream
with doc_id and length of each document and one with the place of each batch. All batches but the last have CHUNK
sequences, so that sequence i is found without a scan. Sequences run across documents; a shard's last one is padded with 0 under
mask 0. Sequences maps a local shard and gives its values without copying them; read_documents goes through a shard in
order and copies. Files are written under a
name of the attempt and then moved, so that a task that runs again replaces its own file.

Where the tokenizer treats words alone (words_stand_alone), a task encodes each distinct word once and keeps the ids of up to
CACHED words; texts are put together from them. A word is known by its 64-bit hash.

A null or empty text has only the end id. Repeated doc_ids are separate rows, in the order of the text's hash; null ids come first. Other columns are ignored. An
empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import hashed_words, pieces
from .common import fresh_path, stash, table

SEQUENCE, END_ID, CHUNK = 2048, 2, 512
#: Distinct words whose ids a task keeps; when they are more, it begins anew.
CACHED = 1_000_000
#: Characters of text in one shard, on average.
SHARD_CHARS = 64_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(path: str, schema: pa.Schema, batches) -> list[tuple[int, int]]:
    """Write under a name of this attempt, then move into place; returns place and rows of each batch."""
    store, to = _open(path)
    context = TaskContext.get()
    part = f"{to}.{context.taskAttemptId() if context else 0}.part"
    with store.open_output_stream(part) as out, pa.ipc.new_stream(out, schema) as writer:
        places = []
        for b in batches:
            places.append((out.tell(), len(b)))
            writer.write_batch(b)
    store.move(part, to)
    return places


def _schema(length: int, kind: str = "uint32") -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.type_for_alias(kind), length)), ("mask", pa.list_(pa.uint8(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
PLACES = pa.schema([("at", pa.int64()), ("n", pa.int64())])


def pack(ids: np.ndarray, length: int, pad: bool = False) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch of whole sequences and the ids left over; with pad all ids go into the batch."""
    n = -(-len(ids) // length) if pad else len(ids) // length
    full = np.zeros(n * length, dtype=ids.dtype)
    mask = np.zeros(n * length, dtype=np.uint8)
    used = min(len(ids), n * length)
    full[:used], mask[:used] = ids[:used], 1
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (full, mask)]
    return pa.RecordBatch.from_arrays(columns, schema=_schema(length, ids.dtype.name)), ids[used:]


def words_stand_alone(tok) -> bool:
    """Whether a text's ids are those of its words in turn: nothing the tokenizer does spans a gap or depends on one."""
    spec = json.loads(tok.to_str())
    norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    first = pre.get("pretokenizers", [pre])[0]
    ok = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in norms)
    # The kept pieces are matches that hold no white space; everything else is removed.
    kept = [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
    ok &= first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in kept
    return bool(ok and spec["truncation"] is None and spec["padding"] is None and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"]))


def plain_pieces(word: str) -> int:
    """1 for letters only, 2 for letters and a stop after them, 0 for all else: the pieces that such a tokenizer makes of a word."""
    letters = word[:-1] if word[-1] in ".,;:!?" else word
    if letters.isalpha() and (word.isascii() or (letters.lower().isalpha() and unicodedata.is_normalized("NFC", letters))):
        return 1 + (letters is not word)
    return 0


class Encoder:
    """Ids of whole texts; words that were seen are not encoded again where they stand alone."""

    def __init__(self, tok, end_id: int):
        self.tok, self.end_id, self.alone = tok, end_id, words_stand_alone(tok)
        last = json.loads(tok.to_str())["model"].get("end_of_word_suffix") if self.alone else None
        #: Whether an id ends a piece, where the vocabulary tells.
        self.ends = np.array([t.endswith(last) for t, _ in sorted(tok.get_vocab().items(), key=lambda x: x[1])]) if last else None
        self.kind = np.uint16 if max(tok.get_vocab_size() - 1, end_id) < 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.slot = np.zeros(0, dtype=np.int64)  # of each hash in begin
        self.begin = np.zeros(1, dtype=np.int64)
        self.ids = np.full(1, self.end_id, dtype=self.kind)  # the end is word -1

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode sorted new words; plain ones many at a time, as the ends of their pieces tell them apart."""
        count = np.array([plain_pieces(w) for w in words], dtype=np.int64) if self.ends is not None else np.zeros(len(words), np.int64)
        plain, other = np.flatnonzero(count), np.flatnonzero(count == 0)
        texts = [" ".join([words[i] for i in plain[k : k + 64]]) for k in range(0, len(plain), 64)] + [words[i] for i in other]
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), dtype=self.kind, count=sum(map(len, got)))
        alone = np.fromiter(map(len, got[len(got) - len(other) :]), dtype=np.int64, count=len(other))
        joined = flat[: len(flat) - int(alone.sum())]
        stop = np.flatnonzero(self.ends[joined])[np.cumsum(count[plain]) - 1] + 1 if len(plain) else np.zeros(0, np.int64)
        sizes = np.concatenate([np.diff(stop, prepend=0), alone])
        which = np.concatenate([plain, other])
        hashes = hashes[which]
        order = np.argsort(hashes)
        old = len(self.begin) - 1
        self.ids = np.concatenate([self.ids[:-1], flat, self.ids[-1:]])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slot = np.insert(self.hashes, at, hashes[order]), np.insert(self.slot, at, old + order)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with an end after each, and how many each has."""
        if not self.alone:
            got = [e.ids for e in self.tok.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            parts = [np.array([*x, self.end_id], dtype=self.kind) for x in got]
            return np.concatenate(parts) if parts else np.zeros(0, self.kind), np.array([len(p) for p in parts], dtype=np.int64)
        bounds, h, (data, first, end) = hashed_words(texts)
        distinct, where, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHED:
            self.forget()
        slot = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[slot] != distinct
        if new.any():
            raw, at = data.tobytes(), where[new]
            self.learn([raw[i:j].decode("utf-8", "replace") for i, j in zip(first[at].tolist(), end[at].tolist(), strict=True)], distinct[new])
        # Words of all texts in turn, and the end, -1, after each text.
        n_words = np.diff(bounds)
        words = np.full(len(h) + len(n_words), -1, dtype=np.int64)
        inner = np.ones(len(words), dtype=bool)
        inner[bounds[1:] + np.arange(len(n_words))] = False
        words[inner] = self.slot[np.searchsorted(self.hashes, distinct)][of] if len(distinct) else 0
        size = np.append(np.diff(self.begin), 1)[words]
        begin = np.append(self.begin[:-1], len(self.ids) - 1)[words]
        out_at = np.cumsum(size) - size
        ids = self.ids[np.repeat(begin - out_at, size) + np.arange(size.sum())]
        last = np.cumsum(size)[~inner]
        return ids, np.diff(last, prepend=0)


@lru_cache(maxsize=1)
def encoder_of(file: str, end_id: int) -> Encoder:
    """One for all tasks of a worker, as a tokenizer takes much memory to load and the words seen serve the next task too."""
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(file), end_id)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write the shards, as many as the text needs or as given; returns shard, path, n_docs, n_tokens."""
    file = tokenizer or default_tokenizer()
    store, at = _open(folder)
    store.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(file, end_id), TaskContext.get().partitionId()
        path, index = f"{folder}/shard-{shard:06d}", []

        def sequences():
            held, n = [], 0
            for batch in batches:
                for b in pieces(batch, size=1 << 20):
                    ids, sizes = encoder.encode(b.column("text"))
                    index.append(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes)], schema=INDEX))
                    held.append(ids)
                    n += len(ids)
                    if n >= CHUNK * length:
                        left = np.concatenate(held)
                        while len(left) >= CHUNK * length:
                            out, _ = pack(left[: CHUNK * length], length)
                            left = left[CHUNK * length :]
                            yield out
                        held, n = [left], len(left)
            if n:
                yield pack(np.concatenate(held), length, pad=True)[0]

        places = _write(f"{path}.arrow", _schema(length, np.dtype(encoder.kind).name), sequences())
        n_docs = sum(len(x) for x in index)
        if n_docs:
            _write(f"{path}.index", INDEX, index)
            _write(f"{path}.places", PLACES, [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*places, strict=True)], schema=PLACES)])
            n_tokens = sum(int(x.column(1).to_numpy().sum()) for x in index)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if shards is None:
        shards = (rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // SHARD_CHARS + 1
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(max(shards, docs.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    return stash(rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Adds the ids before each shard; there is one row for each shard."""
    # One window over a row per shard file, not over documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_documents(path: str) -> Iterator[tuple[int, np.ndarray]]:
    """doc_id and ids of each document of a shard, in order, with a bounded part of the shard in memory."""
    store, at = _open(path)
    with store.open_input_file(f"{at}.index") as f:
        index = pa.ipc.open_stream(f).read_all()
    with store.open_input_file(f"{at}.arrow") as f:
        reader = pa.ipc.open_stream(f)
        have = np.zeros(0, dtype=reader.schema.field("ids").type.value_type.to_pandas_dtype())
        for doc_id, n in zip(index.column(0).to_pylist(), index.column(1).to_pylist(), strict=True):
            parts, size = [have], len(have)
            while size < n:
                b = reader.read_next_batch()
                ids, mask = (b.column(k).flatten().to_numpy(zero_copy_only=True) for k in (0, 1))
                parts.append(ids[mask == 1])
                size += len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]


class Sequences:
    """The sequences of a shard by number; a local file is mapped, and one elsewhere is read batch by batch."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, at = _open(path)
        with store.open_input_file(f"{at}.places") as f:
            places = pa.ipc.open_stream(f).read_all()
        self.places, self.n = places.column("at").to_numpy(), int(places.column("n").to_numpy().sum())
        self.file = pa.memory_map(f"{at}.arrow") if isinstance(store, fs.LocalFileSystem) else store.open_input_file(f"{at}.arrow")
        self.schema = pa.ipc.open_stream(self.file).schema

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        self.file.seek(int(self.places[i // CHUNK]))
        message = pa.ipc.read_message(self.file)
        if message.type == "schema":  # stands before the first batch
            message = pa.ipc.read_message(self.file)
        batch = pa.ipc.read_record_batch(message, self.schema)
        k, length = i % CHUNK, self.schema.field("ids").type.list_size
        ids, mask = (batch.column(c).flatten()[k * length : (k + 1) * length].to_numpy(zero_copy_only=True) for c in (0, 1))
        return ids, mask


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files."""
    spec = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in read_documents(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shard_starts(shards).select("path", "start").repartition(max(shards.count(), 1))
    return spread.mapInArrow(read, spec)


def encode_to_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    shards = write_shards(docs, folder or fresh_path(docs.sparkSession, "tokens"), tokenizer)
    return read_shards(shards)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_files(table(spark, sf_dir, "documents"))
