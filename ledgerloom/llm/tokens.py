"""Token ids in Arrow stream files of fixed-size lists: equal-length sequences and masks that are read at random without a copy.

Documents are sorted by doc_id (ranges of it, then inside each), encoded in that order, each with an end id behind it, and laid into rows of LENGTH
ids. A file is an Arrow stream: a schema, then batches of ROWS rows with three columns of fixed-size lists without nulls: ``ids``, and as
bits ``mask`` (an id stands here) and ``first`` (it is the first of a document). So every batch but a file's last has the same number
of bytes, and row k starts at a place that arithmetic gives: a reader maps the file and gets views.
The index, a written table, has a row per document and a row per file; files of lost or repeated attempts are named by no row of it.

Encoding: texts are cut where a byte-level pre-tokenizer can't but cut (behind a letter or sign that white space
or a sign of another class follows), and a piece that a worker has encoded before isn't encoded again. Tokenizers of another make get whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, shared_folder, table
from .mixing import running

#: The id behind each document; ids of a row; rows of a batch; ids of a file, from which a new one is begun.
END, LENGTH, ROWS, FILE = 2, 2048, 64, 1 << 26
#: Characters of text that are encoded at once, or so; pieces, and characters of pieces, that a worker remembers at most: both bound memory and change no result.
RUN, REMEMBERED, REMEMBERED_CHARS = 1_000_000, 1_000_000, 32_000_000
INDEX = "part long, nth long, file string, doc_id long, at long, n long, rows long, head long, stride long"

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏА-яЁё"
#: Pieces: white space, then letters before an ASCII sign, or ASCII signs (no apostrophe) before letters, or all up to the next white space.
_FINE = re.compile(rf"[\t-\r ]*+(?:[{_LETTERS}]++(?=[\x00-\x7f]|\Z)|[!-&(-@\[-`{{-~]++(?=[{_LETTERS}\t-\r ]|\Z)|[^\t-\r ]++)|[\t-\r ]++")
_COARSE = re.compile(r"[\t-\r ]*+[^\t-\r ]++|[\t-\r ]++")
#: Characters that may or may not be white space, by the version of Unicode: a text with any is cut at sure places only.
_ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 8), (14, 31), (127, 160), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))) + "]")
_SURE = re.compile(r"(?<=[!-~])(?=[ \n])")


class Numbers(dict):
    """A number for each piece; new ones are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k


class Encoder:
    """Ids of texts, as the tokenizer at ``path`` gives them without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        make = json.loads(self.tokenizer.to_str())
        before = make["pre_tokenizer"] or {}
        self.added = [x["content"] for x in make["added_tokens"]]
        plain = all(make[k] is None for k in ("normalizer", "truncation", "padding")) and make["model"]["type"] == "BPE" and not make["model"]["dropout"]
        self.cuts = plain and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not any(re.search(r"\s", a) for a in self.added) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in make["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.numbers, self.chars, self.used = Numbers(), 0, 0
        self.start, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def sections(self, text: str) -> Iterator[str]:
        """The text, in sections of about RUN characters where it can be cut."""
        at = 0
        while self.cuts and len(text) - at > RUN and (cut := _SURE.search(text, at + RUN)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def pieces(self, text: str) -> list[str]:
        if not self.cuts or _ODD.search(text):
            return [text] if text else []
        return (_COARSE if any(a in text for a in self.added) else _FINE).findall(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        parts = [self.pieces(t) for t in texts]
        bounds = np.cumsum([0, *map(len, parts)])
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(bounds[-1]))
        self._learn()
        size = self.size[at]
        ends = np.cumsum(size)
        out = self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        return np.split(out, np.append(0, ends)[bounds[1:-1]])

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        total, k = int(size.sum()), len(self.numbers)
        self.start, self.size, self.pool = _room(self.start, k), _room(self.size, k), _room(self.pool, self.used + total)
        self.size[k - len(new) : k] = size
        self.start[k - len(new) : k] = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
        self.used += total
        self.chars += sum(map(len, new))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def encoder(path: str) -> Encoder:
    """The worker's encoder: a Python worker serves many tasks, and what it has encoded stays with it."""
    held = sys.modules.setdefault("ledgerloom_encoders", types.ModuleType("ledgerloom_encoders"))
    if path not in held.__dict__:
        setattr(held, path, Encoder(path))
    return held.__dict__[path]


class Packer:
    """One file: ids are laid into rows, rows go out in batches."""

    def __init__(self, store: fs.FileSystem, path: str, kind: pa.DataType, length: int, rows: int):
        lists = {"ids": kind, "mask": pa.bool_(), "first": pa.bool_()}
        self.schema = pa.schema([pa.field(name, pa.list_(pa.field("item", x, False), length), False) for name, x in lists.items()], {"length": str(length), "rows": str(rows)})
        self.sink = store.open_output_stream(path, compression=None)
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.ids, self.first = np.zeros(length * rows, kind.to_pandas_dtype()), np.zeros(length * rows, bool)
        self.length, self.held, self.n, self.rows = length, 0, 0, 0
        self.head, self.stride = self.schema.serialize().size, 0

    def add(self, ids: np.ndarray, first: bool) -> None:
        """Ids of a document; ``first`` says whether they are its first ones."""
        if first and len(ids):
            self.first[self.held] = True
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.ids) - self.held)
            self.ids[self.held : self.held + n] = ids[at : at + n]
            self.held, self.n, at = self.held + n, self.n + n, at + n
            if self.held == len(self.ids):
                self._out()

    def _out(self) -> None:
        n = -(-self.held // self.length) * self.length
        self.ids[self.held : n] = 0
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[:n]), type=self.schema.field(k).type) for k, x in enumerate((self.ids, np.arange(n) < self.held, self.first))]
        before = max(self.sink.tell(), self.head)
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        size = self.sink.tell() - before
        self.stride = self.stride or size
        if self.held == len(self.ids) and size != self.stride:
            raise ValueError(f"a batch of {size} bytes among batches of {self.stride}")
        self.rows, self.held = self.rows + n // self.length, 0
        self.first[:] = False

    def close(self) -> None:
        if self.held:
            self._out()
        self.out.close()
        self.sink.close()


class Sequences:
    """The rows of a file by number: ids as views of the mapped file, or of the batch read for them; mask and first, a bit each there, as booleans.

    ``place`` is a path of this machine, or an open Arrow file.
    """

    def __init__(self, place: str | pa.NativeFile):
        self.file = pa.memory_map(place) if isinstance(place, str) else place
        self.file.seek(0)
        self.schema = pa.ipc.read_schema(self.file)
        self.head = self.file.tell()
        self.length, self.per = (int(self.schema.metadata[k]) for k in (b"length", b"rows"))
        end, self.stride, self.number, self.held = self.file.size() - 8, 0, -1, None  # eight bytes end a stream
        if end > self.head:
            pa.ipc.read_message(self.file)
            self.stride = self.file.tell() - self.head
        batches = -(-(end - self.head) // self.stride) if self.stride else 0
        self.rows = (batches - 1) * self.per + len(self.batch(batches - 1)[0]) if batches else 0

    def __len__(self) -> int:
        return self.rows

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Of batch ``k``: ids, a row each, and its mask and first as Arrow's bits, all without a copy; the one that was read last is at hand."""
        if k != self.number:
            self.file.seek(self.head + k * self.stride)
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.file.read_buffer(self.stride)), self.schema)
            self.number, self.held = k, (batch.column(0).values.to_numpy(zero_copy_only=True).reshape(-1, self.length), batch.column(1).values, batch.column(2).values)
        return self.held

    def __getitem__(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, *bits = self.batch(row // self.per)
        at = row % self.per
        return ids[at], *[x.slice(at * self.length, self.length).to_numpy(zero_copy_only=False) for x in bits]

    def span(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``n`` ids of the file from the one numbered ``at``, their mask, and which are first ones."""
        size, parts = self.per * self.length, []
        for k in range(at // size, (at + n - 1) // size + 1):
            ids, *bits = self.batch(k)
            low, high = max(at - k * size, 0), min(at + n - k * size, ids.size)
            parts.append([ids.ravel()[low:high], *[x.slice(low, high - low).to_numpy(zero_copy_only=False) for x in bits]])
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sections(texts: Iterator[pa.RecordBatch], enc: Encoder) -> Iterator[tuple[list[int | None], list[str], list[bool]]]:
    """Sections of texts, about RUN characters together: whose each is, the section, whether it is the text's last."""
    docs, own, last, held = [], [], [], 0
    for batch in texts:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            sections = enc.sections(text.as_py() or "")
            section = next(sections)
            while section is not None:
                after = next(sections, None)
                docs.append(doc)
                own.append(section)
                last.append(after is None)
                held += len(section)
                if held >= RUN:
                    yield docs, own, last
                    docs, own, last, held = [], [], [], 0
                section = after
    if docs:
        yield docs, own, last


def _write(texts: Iterator[pa.RecordBatch], folder: str, path: str, end: int, length: int, rows: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    enc, part, nth, out, name, first, at = encoder(path), TaskContext.get().partitionId(), -1, None, "", True, 0
    types_ = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6]
    names = ["part", "nth", "file", "doc_id", "at", "n", "rows", "head", "stride"]
    behind = np.array([end], np.uint32)
    for docs, own, last in _sections(texts, enc):
        found: list[tuple] = []
        for doc, ids, done in zip(docs, enc.ids(own), last, strict=True):
            if out is None or (first and out.n >= FILE):
                if out is not None:
                    out.close()
                    found.append((part, nth, name, None, None, out.n, out.rows, out.head, out.stride))
                nth, name = nth + 1, f"ids-{part:06d}-{nth + 1:04d}-{uuid.uuid4().hex}.arrows"
                out = Packer(store, f"{base}/{name}", kind, length, rows)
            at = out.n if first else at
            out.add(ids, first)
            first = first and not len(ids)
            if done:
                out.add(behind, first)
                found.append((part, nth, name, doc, at, out.n - at, None, None, None))
                first = True
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types_, strict=True)] if found else [pa.array([], t) for t in types_], names)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, nth, name, None, None, out.n, out.rows, out.head, out.stride), types_, strict=True)], names)


def write(docs: DataFrame, folder: str, path: str, end: int = END, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Files of the ids of all texts, in ascending doc_id order, and their index, as a written table.

    Null ids come last; documents of one id stand in any order, and however many they are, they spread over tasks. Null
    texts are empty: their only id is ``end``. Ids take two bytes where the vocabulary allows, else four.
    """
    from tokenizers import Tokenizer

    kind = pa.uint16() if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("tied", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("tied").asc()]
    laid = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return kept(laid.mapInArrow(partial(_write, folder=folder, path=path, end=end, length=length, rows=rows, kind=kind), INDEX))


def files(index: DataFrame) -> DataFrame:
    """part, nth, file, n (ids), rows, head, stride, base (ids of all files before) of every file."""
    return running(index.filter("rows IS NOT NULL").select("part", "nth", "file", "n", "rows", "head", "stride"), [F.col("part").asc(), F.col("nth").asc()], base=F.col("n"))


def _documents(rows: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    name, own = None, None
    for batch in rows:
        sums, got = [], []
        for x in batch.to_pylist():
            if x["file"] != name:
                name, own = x["file"], Sequences(store.open_input_file(f"{base}/{x['file']}"))
            ids, mask, first = own.span(x["at"], x["n"])
            if len(ids) != x["n"] or not mask.all() or not first[0] or first[1:].any():
                raise ValueError(f"{name} at {x['at']}: not the {x['n']} ids of one document")
            ids = ids.astype("<u4")
            sums.append(zlib.crc32(ids))
            got.append(ids if with_ids else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n"), pa.array(sums, pa.int64()), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids, of every document of the index, read from the files.

    Documents are dealt to tasks by their place, so that a task reads few files, forward.
    """
    every = kept(files(index))
    asked = index.filter("rows IS NULL").select("file", "doc_id", "at", "n")
    own = kept(asked.join(every.select("file", "part", "nth", "base"), "file").withColumn("start", F.col("base") + F.col("at")))
    tasks = max(1, every.count())
    laid = own.repartitionByRange(int(tasks), "start").sortWithinPartitions("start")
    return laid.mapInArrow(partial(_documents, folder=folder, with_ids=ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def _rows(names: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(folder)
    for batch in names:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
            own = Sequences(store.open_input_file(f"{base}/{name}"))
            for k in range(-(-own.rows // own.per)):
                ids, mask, first = own.batch(k)
                columns = [pa.array([name] * len(ids)), pa.array(np.arange(len(ids)) + k * own.per), pa.array(start + (np.arange(len(ids)) + k * own.per) * own.length)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(ids.astype(np.int64)), pa.list_(pa.int64())), *[pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * own.length, x) for x in (mask, first)]], ["file", "row", "start", "ids", "mask", "first"])


def sequences(index: DataFrame, folder: str) -> DataFrame:
    """file, row, start (ids before it), ids, mask, first of every sequence of the files that the index names."""
    every = kept(files(index))
    dealt = every.select("file", "base").repartitionByRange(max(1, every.count()), "base")
    return dealt.mapInArrow(partial(_rows, folder=folder), "file string, row long, start long, ids array<long>, mask array<boolean>, first array<boolean>")


def op12_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files. Nulls, repeats, empties: see ``write``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark)
    return read(write(table(spark, sf_dir, "documents"), folder, str(path)), folder, ids=False).drop("ids")
