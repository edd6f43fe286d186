"""Token ids in Arrow files of equal-length sequences, and their reading by place.

A table of texts becomes a folder of Arrow IPC files. Texts are put in ascending id
order; each partition writes one file whose record batches hold fixed-size lists:
``ids`` (the smallest unsigned type that holds the vocabulary) and ``mask`` (true
where an id is real; only a file's last sequence has padding). The stream of a file
is the ids of its documents end to end, each closed by the end id. A second file
beside it, ``.docs.arrow``, has each document's id, start and length. Buffers are
not compressed, so a memory-mapped sequence is a view of the file.

Files have names of their own for each attempt of a task, and only those that the
manifest lists count: a lost executor or a second attempt leaves at most files that
nothing refers to.

Cases: a null text is an empty one and becomes the end id alone; rows with the same
id are ordered by text; null ids come first; an empty table makes no files; other
columns of the input are left out of the files and do not matter.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .scratch import save

#: Sequences in a record batch.
BATCH = 1024
#: Texts encoded at once.
ROWS = 128
#: Distinct words whose ids a worker keeps; beyond that it starts afresh.
KNOWN_WORDS = 1_000_000


#: A word of Latin-1 letters, perhaps with points after it: two pieces at most, as letters end where points begin.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")

_PLAIN_ASCII = re.compile(rb"([a-z]+)([.,;:!?]*)").fullmatch


class WordEncoder:
    """Ids of whole texts, each distinct word between ASCII spaces encoded once.

    It serves tokenizers whose pieces never hold white space: those drop it, so a
    text's ids are its words' ids end to end. Where the tokenizer lowers its text and
    splits off letters, words of Latin-1 letters need neither step from the library:
    they go to its merges at once, in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        self._full = Tokenizer.from_str(json.dumps(whole))
        suffix = whole["model"].get("end_of_word_suffix")
        self._ends = np.zeros(self._full.get_vocab_size(), bool)
        for token, number in whole["model"]["vocab"].items():
            self._ends[number] = bool(suffix) and token.endswith(suffix)
        self._lowers = bool(suffix) and "Lowercase" in json.dumps(whole["normalizer"]) and "[\\\\p{L}]+|" in json.dumps(whole["pre_tokenizer"])
        self._merges = Tokenizer.from_str(json.dumps(whole | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.kind = np.dtype("<u2") if self._full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._known: dict[bytes, bytes] = {}
        char = byte_characters()
        self._shown = {c: "".join(char[b] for b in chr(c).encode()) for c in range(256)}

    def _encode(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of each word, from one call for them all."""
        size = self.kind.itemsize
        if tokenizer is self._merges:  # one piece a word, so its last id is one that ends pieces
            made = tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(made.ids, self.kind)
            ends = (np.flatnonzero(self._ends[ids]) + 1) * size
        else:
            made = tokenizer.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(made.ids, self.kind)
            ends = np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(words)), "right") * size
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _learn(self, words: set[bytes]) -> None:
        known, other, parts, cores = self._known, set(), [], {}
        for w in words:
            match = _PLAIN_ASCII(w) if self._lowers else None
            if match:
                key, tail = match.groups()
                parts.append((w, key, tail))
                if key not in known:
                    cores[key] = key.decode()
                if tail and tail not in known:
                    other.add(tail.decode())
                continue
            match = _PLAIN.fullmatch(w.decode()) if self._lowers else None
            if match:
                core, tail = match[1].lower(), match[2].encode()
                key = core.encode()
                parts.append((w, key, tail))
                if key not in known:
                    cores[key] = core.translate(self._shown)
                if tail and tail not in known:
                    other.add(match[2])
            elif b"<|" in w:  # special tokens belong to no word of the library's count
                known[w] = np.array(self._full.encode(w.decode(), add_special_tokens=False).ids, self.kind).tobytes()
            else:
                other.add(w.decode())
        for tokenizer, keys, shown in ((self._merges, list(cores), list(cores.values())), (self._full, [w.encode() for w in other], list(other))):
            for at in range(0, len(keys), 4096):
                known.update(zip(keys[at : at + 4096], self._encode(tokenizer, shown[at : at + 4096]), strict=True))
        for w, key, tail in parts:
            known[w] = known[key] + known[tail] if tail else known[key]

    def _lowered(self, text: bytes) -> bytes:
        """ASCII in lower case, as the tokenizer would make it, unless that could make a special token of something else."""
        return text.lower() if self._lowers and b"<|" not in text else text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``kind``."""
        listed = [self._lowered((t or "").encode()).split() for t in texts]
        if len(self._known) > KNOWN_WORDS:
            self._known = {}
        new = {w for words in listed for w in words if w not in self._known}
        if new:
            self._learn(new)
        return [b"".join(map(self._known.__getitem__, words)) for words in listed]


@lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def sequence_schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """One file of sequences; holds at most a record batch of ids."""

    def __init__(self, fs, path: str, kind: np.dtype, length: int):
        self._kind, self._length, self._held, self._bytes = kind, length, [], 0
        self._schema = sequence_schema(kind, length)
        self._sink = fs.open_output_stream(path)
        self._file = pa.ipc.new_file(self._sink, self._schema)

    def add(self, ids: bytes) -> None:
        self._held.append(ids)
        self._bytes += len(ids)
        whole = self._length * self._kind.itemsize * BATCH
        if self._bytes >= whole:
            data = b"".join(self._held)
            cut = len(data) // whole * whole
            for at in range(0, cut, whole):
                self._write(np.frombuffer(data, self._kind, whole // self._kind.itemsize, at))
            self._held, self._bytes = [data[cut:]], len(data) - cut

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self._length)
        padded = ids if len(ids) == rows * self._length else np.concatenate([ids, np.zeros(rows * self._length - len(ids), self._kind)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self._length) for x in (padded, np.arange(len(padded)) < len(ids))]
        self._file.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self._schema, strict=True)], schema=self._schema))

    def close(self) -> None:
        if self._bytes:
            self._write(np.frombuffer(b"".join(self._held), self._kind))
        self._file.close()
        self._sink.close()


MANIFEST = "part int, path string, documents long, tokens long"


def write(df: DataFrame, folder: str, vocabulary: str, end_id: int, id: str = "doc_id", text: str = "text", length: int = 2048) -> list[dict]:
    """Write ``df``'s texts under ``folder`` (a URI that pyarrow opens); return the files in order, with each one's first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.kind).tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        writer, ids, counts, path = None, [], [], ""
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(root, recursive=True)
                path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
                writer = _Writer(fs, f"{root}/{path}", enc.kind, length)
            ids.append(batch.column(0))
            for at in range(0, batch.num_rows, ROWS):
                for tokens in enc.encode(batch.column(1).slice(at, ROWS).to_pylist()):
                    counts.append(len(tokens) // enc.kind.itemsize + 1)
                    writer.add(tokens + end)
        if writer is not None:
            writer.close()
            n = np.array(counts, np.int64)
            index = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
            with fs.open_output_stream(f"{root}/{path}.docs.arrow") as sink, pa.ipc.new_file(sink, index.schema) as file:
                file.write_table(index)
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "documents": [len(n)], "tokens": [int(n.sum())]})

    ordered = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest, _ = save(ordered.mapInArrow(run, MANIFEST), "token-manifest")
    files, at = [], 0
    for r in sorted(manifest.collect()):  # a row for each file, not for each document
        files.append({"path": r.path, "documents": r.documents, "tokens": r.tokens, "base": at})
        at += r.tokens
    return files


@dataclass
class TokenFile:
    """One written file, opened without reading it: sequences and masks are views of the mapped pages."""

    folder: str
    path: str

    def __post_init__(self):
        fs, root = pafs.FileSystem.from_uri(self.folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        self._open = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self._root = root
        self._file = pa.ipc.open_file(self._open(f"{root}/{self.path}"))

    def __len__(self) -> int:
        last = self._file.num_record_batches - 1
        return 0 if last < 0 else last * BATCH + self._file.get_batch(last).num_rows

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence ``k``: its ids, a view, and its mask."""
        batch = self._file.get_batch(k // BATCH)
        ids, mask = (batch.column(c).slice(k % BATCH, 1).flatten() for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def documents(self) -> pa.Table:
        return pa.ipc.open_file(self._open(f"{self._root}/{self.path}.docs.arrow")).read_all()

    def streams(self) -> Iterator[np.ndarray]:
        """The ids of the file in order, a record batch at a time."""
        for k in range(self._file.num_record_batches):
            batch = self._file.get_batch(k)
            ids = batch.column(0).flatten().to_numpy()
            yield ids if k < self._file.num_record_batches - 1 else ids[: batch.column(1).flatten().to_numpy(zero_copy_only=False).sum()]

    def document_checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian unsigned 32-bit integers."""
        index = self.documents()
        left = index["n_tokens"].to_numpy().copy()
        out, doc = np.zeros(len(left), np.int64), 0
        for ids in self.streams():
            at = 0
            while at < len(ids):
                take = min(int(left[doc]), len(ids) - at)
                out[doc] = zlib.crc32(ids[at : at + take].astype("<u4").tobytes(), int(out[doc]))
                left[doc] -= take
                at += take
                doc += left[doc] == 0
        return out


def read_documents(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                file = TokenFile(folder, f["path"])
                index = file.documents()
                table = pa.table({"doc_id": index["doc_id"], "start": index["start"].to_numpy() + f["base"], "n_tokens": index["n_tokens"], "ids_crc32": file.document_checksums()})
                yield from table.combine_chunks().to_batches(max_chunksize=65536)

    rows = spark.createDataFrame([(f["path"], f["base"]) for f in files], "path string, base long")
    return rows.repartition(max(1, len(files))).mapInArrow(run, schema)
