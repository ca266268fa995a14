"""Token ids as Arrow streams of equal-length sequences.

A file is one Arrow IPC stream. Its batches have `ids`, a fixed-size list of SEQUENCE ids, and `mask`, a
fixed-size list of as many booleans (false: padding), and all but the last hold ROWS sequences, so sequence
i is row i % ROWS of batch i // ROWS and a memory-mapped file is read without copies. The schema's metadata
tells where each document stands: an Arrow stream of (doc_id, start, n_tokens), starts counted in the file.
Documents are packed one after another; only a file's last sequence is padded.

Files are written by Spark's text writer, one value a file, so that they are committed like any other
output and lie on any file system; the line end that it adds follows the stream's end mark and is not read.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import shared_dir, written
from plenum.llm.words import WordTable, cut, distinct, hashes

SEQUENCE, ROWS = 2048, 64
#: Ids in a file, before the document that passes it.
FILE_IDS = 4 << 20
#: Words kept with their ids and the longest that are, texts, bytes and words encoded at a time, and pieces kept.
CACHED_WORDS, CACHED_BYTES, TEXTS, BYTES, WORDS, PIECES = 1_000_000, 48, 1024, 1 << 20, 1000, 60_000
#: Stands between words that are encoded together; a text that has it is encoded whole.
MARK = "\x01"
SPACE = re.compile(rb"[ \t-\r]")

#: A byte as the letter that stands for it in byte-level vocabularies: itself where printable, else one from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_encoders: dict = {}


class Encoder:
    """Ids of whole texts as bytes.

    Where the tokenizer drops white space before it looks at words, as `by_word` allows and a probe
    confirms, words between ASCII white space are remembered with their ids, up to CACHED_WORDS of them, in
    the second half only those that are met again, found by a hash and compared by bytes. Unknown ones are encoded many
    at a time, a mark between, or, where the vocabulary cuts words by one pattern, piece by piece by its
    model. A text that holds a special token's string or the mark is encoded whole. When memory is full and
    over a fifth of the words are unknown, it starts anew.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        probe = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.mark = probe(MARK)
        self.by_word = by_word and len(self.mark) == 1 and probe(f" a\n\tb {MARK} c\r ") == probe("a") + probe("b") + self.mark + probe("c")
        self.lower = probe("AZ") == probe("az")
        self.pattern = self._cuts()
        self._forget()
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()] + [MARK.encode()]

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> Encoder:
        """One for the process, so that later tasks find the words of earlier ones."""
        if (path, by_word) not in _encoders:
            _encoders[path, by_word] = cls(path, by_word)
        return _encoders[path, by_word]

    def _forget(self) -> None:
        self.known, self.pieces, self.met = WordTable((4 * CACHED_WORDS).bit_length() - 1, CACHED_WORDS), {}, np.zeros(1 << 23, bool)
        self.ids, self.used = np.empty(1 << 20, self.dtype), 0
        self.start, self.size = np.zeros(CACHED_WORDS, np.int64), np.zeros(CACHED_WORDS, np.int32)

    def _remember(self, own: np.ndarray, words: list[bytes], found: list[np.ndarray]) -> None:
        """Keep the ids of words."""
        if not len(own):
            return
        sizes, at = np.fromiter(map(len, found), np.int64, len(found)), self.known.size
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + total] = np.concatenate(found)
        self.start[at : at + len(own)], self.size[at : at + len(own)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.known.add(own, words)
        self.used += total

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.dtype) for x in found]

    def _cuts(self):
        """The pattern that cuts words into pieces if pieces are then bytes written as letters, else None.

        Normalising may do no more than compose letters (NFC), lower them and turn white space into blanks.
        """
        about = json.loads(self.tokenizer.to_str())
        normal = about["normalizer"] or {"type": "Sequence", "normalizers": []}
        normal = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
        blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        if any(x["type"] not in ("NFC", "Lowercase") and x != blanks for x in normal) or about["model"]["type"] != "BPE":
            return None
        steps = about["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or "Regex" not in steps[0]["pattern"]:
            return None
        if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            return None
        return regex.compile(steps[0]["pattern"]["Regex"])

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.dtype).tobytes()

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words: those that normalising leaves as they are by pieces, the others between marks."""
        if self.pattern is None or not self.lower:
            return dict(zip(words, self._words(words)))
        out, rest, get, cut = {}, [], self.pieces.get, self.pattern.findall
        for word in words:
            text = word.decode("utf-8", "replace")
            if not text.isprintable() or not text.isascii() and (text != text.lower() or not is_normalized("NFC", text)):
                rest.append(word)
                continue
            ids = []
            for piece in (text,) if text.isascii() and text.isalpha() else cut(text):
                found = get(piece)
                if found is None:
                    found = self._piece(piece)
                    if len(self.pieces) < PIECES and len(piece) < CACHED_BYTES:
                        self.pieces[piece] = found
                ids.append(found)
            out[word] = ids[0] if len(ids) == 1 else b"".join(ids)
        out.update(zip(rest, self._words(rest)))
        return out

    def _words(self, words: list[bytes]) -> Iterator[bytes]:
        between = f" {MARK} ".encode()
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids = self._whole([between.join(part)])[0]
            ends = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(ends) != len(part) - 1:
                raise ValueError("the tokenizer does not keep words apart; use by_word=False")
            for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)]):
                yield ids[a:b].tobytes()

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return [x.tobytes() for x in self._whole(bodies)]
        out, held, start = [], 0, 0
        for k, body in enumerate(bodies):
            if held and held + len(body) > BYTES:
                out += self._some(bodies[start:k])
                held, start = 0, k
            held += len(body)
        return out + (self._some(bodies[start:]) if start < len(bodies) else [])

    def _some(self, bodies: list[bytes]) -> list[bytes]:
        if len(bodies) == 1 and len(bodies[0]) > 2 * BYTES and not self._special(bodies[0].lower()) and len(pieces := list(parts(bodies[0], BYTES))) > 1:
            return [b"".join(x for part in pieces for x in self._some([part]))]
        whole = [k for k, x in enumerate(bodies) if self._special(x.lower())] if self._special(b"\n".join(bodies).lower()) else []
        low, starts, sizes, counts = cut([b"" if k in whole else x for k, x in enumerate(bodies)] if whole else bodies, self.lower)
        text, own = low.tobytes(), hashes(low, starts, sizes)
        number = self.known.find(own, low, starts, sizes)
        gaps = np.flatnonzero(number < 0)
        first, place = distinct(low, starts[gaps], sizes[gaps], own[gaps])
        new = own[gaps[first]]
        words = [text[a : a + n] for a, n in zip(starts[gaps[first]].tolist(), sizes[gaps[first]].tolist())]
        encoded = self._new(words)
        found = [np.frombuffer(encoded[w], self.dtype) for w in words]
        more = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.concatenate([self.ids[: self.used], *found])
        at, length = self.start[number], self.size[number]
        at[gaps], length[gaps] = (self.used + np.cumsum(more) - more)[place], more[place]
        edges = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(at - edges[:-1], length) + np.arange(edges[-1])]
        ends = edges[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        for k, x in zip(whole, self._whole([bodies[k] for k in whole])):
            out[k] = x.tobytes()
        if len(new) * 5 > len(own) and self.known.size >= CACHED_WORDS // 2:
            self._forget()
        keep = sizes[gaps[first]] <= CACHED_BYTES
        keep[np.setdiff1d(np.arange(len(new)), np.unique(new, return_index=True)[1])] = False
        keep &= ~self.known.holds(new)
        if self.known.size > CACHED_WORDS // 2:
            slot = (new & np.uint64(len(self.met) - 1)).astype(np.int64)
            keep &= self.met[slot]
            self.met[slot] = True
        keep[np.cumsum(keep) > CACHED_WORDS - self.known.size] = False
        kept = np.flatnonzero(keep).tolist()
        self._remember(new[keep], [words[k] for k in kept], [found[k] for k in kept])
        return out

    def _special(self, text: bytes) -> bool:
        return any(t in text for t in self.special)


def parts(body: bytes, most: int) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut at ASCII white space."""
    at = 0
    while at < len(body):
        end = SPACE.search(body, at + most)
        yield body[at : end.start() if end else len(body)]
        at = end.start() if end else len(body)


def _fixed(values: np.ndarray, width: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), width)


def stream(docs: list[tuple], ids: np.ndarray, shard: tuple[int, int], key: pa.DataType, sequence: int = SEQUENCE, rows: int = ROWS) -> pa.Buffer:
    """One file: docs is (doc_id, start, n_tokens) of each document, ids all their ids."""
    n = -(-len(ids) // sequence) * sequence
    padded, mask = np.zeros(n, ids.dtype), np.zeros(n, bool)
    padded[: len(ids)], mask[: len(ids)] = ids, True
    index = pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs], t) for k, t in enumerate((key, pa.int64(), pa.int64()))], ["doc_id", "start", "n_tokens"])
    inner = io.BytesIO()
    with pa.ipc.new_stream(inner, index.schema) as w:
        w.write_batch(index)
    kind = pa.from_numpy_dtype(ids.dtype)
    about = {"docs": inner.getvalue(), "n_ids": str(len(ids)), "part": str(shard[0]), "file": str(shard[1]), "sequence": str(sequence), "rows": str(rows)}
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))], metadata=about)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as w:
        for at in range(0, n, sequence * rows):
            w.write_batch(pa.RecordBatch.from_arrays([_fixed(x[at : at + sequence * rows], sequence) for x in (padded, mask)], schema=schema))
    return out.getvalue()


class SequenceFile:
    """Random access to a file's sequences; `source` is its bytes or a local path, which is memory-mapped."""

    def __init__(self, source: bytes | str | pa.Buffer):
        if isinstance(source, str):
            source = pa.memory_map(unquote(urlparse(source).path) if source.startswith("file:") else source)
        else:
            source = pa.BufferReader(source)
        reader = pa.ipc.open_stream(source)
        self.about = {k.decode(): v for k, v in reader.schema.metadata.items()}
        self.batches = list(reader)
        self.sequence, self.rows, self.n_ids = (int(self.about[k]) for k in ("sequence", "rows", "n_ids"))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def ids(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the file's memory."""
        return self.batches[i // self.rows].column("ids").flatten().to_numpy()[i % self.rows * self.sequence :][: self.sequence]

    def mask(self, i: int) -> pa.Array:
        """Which of them are no padding, a view of the file's memory."""
        return self.batches[i // self.rows].column("mask").flatten().slice(i % self.rows * self.sequence, self.sequence)

    def documents(self) -> pa.RecordBatch:
        """(doc_id, start, n_tokens) of the file's documents."""
        return pa.ipc.open_stream(pa.BufferReader(self.about["docs"])).read_all().combine_chunks().to_batches()[0]

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids from start to start + n; a copy only where they lie in several batches."""
        size, parts = self.rows * self.sequence, []
        while n:
            part = self.batches[start // size].column("ids").flatten().to_numpy()[start % size :][:n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end: int = 2, by_word: bool = True, sequence: int = SEQUENCE, rows: int = ROWS, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text, append `end` to each, and write the files below out in ascending order of doc_id.

    A null text is empty; null doc_ids come first; equal doc_ids are ordered by text and all kept. Texts are
    dealt by ranges of (doc_id, hash of the text), so neither many equal ids nor a hot source meet in a task.
    A document is never split over files, so its ids must fit one value of Spark's, 2 GB.
    """
    kind = docs.schema["doc_id"].dataType
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    ranged = docs.select("doc_id", body.alias("body")).withColumn("tie", F.xxhash64("body")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "body").select("doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer, by_word), TaskContext.get().partitionId()
        last = np.array([end], encoder.dtype).tobytes()
        size = encoder.dtype.itemsize
        held, index, n, file = [], [], 0, 0

        def flush():
            ids = np.frombuffer(b"".join(held), encoder.dtype)
            held.clear()
            one = stream(index, ids, (part, file), key, sequence, rows)
            if len(one) >= 1 << 31:
                raise ValueError(f"document {index[-1][0]} has more ids than fit a file")
            value = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(one)], np.int32)), one])
            return pa.RecordBatch.from_arrays([value], ["value"])

        for batch in batches:
            key = batch.schema.field("doc_id").type
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("body")
            for at in range(0, len(keys), TEXTS):
                for doc, ids in zip(keys[at : at + TEXTS], encoder.encode(texts.slice(at, TEXTS).to_pylist())):
                    held.append(ids + last)
                    index.append((doc, n, len(held[-1]) // size))
                    n += index[-1][2]
                    if n >= file_ids:
                        yield flush()
                        held, index, n, file = [], [], 0, file + 1
                        pa.default_memory_pool().release_unused()
        if index:
            yield flush()
        pa.default_memory_pool().release_unused()

    ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)


def bases(files: DataFrame, group: int = 1024) -> DataFrame:
    """files(part, file, n_ids), one row a file -> (part, file, base): the ids in all files before it.

    Files are summed within their part, parts within their group, and only the groups' sums in one place.
    """
    part, parts_group = Window.partitionBy("part"), Window.partitionBy("group")
    files = files.withColumn("in_part", F.sum("n_ids").over(part.orderBy("file")) - F.col("n_ids")).withColumn("all", F.sum("n_ids").over(part))
    files = written(files.withColumn("group", F.floor(F.col("part") / group)), "files", compact=True)
    parts = files.where("file = 0").select("part", "group", (F.sum("all").over(parts_group.orderBy("part")) - F.col("all")).alias("in_group"))
    groups = files.groupBy("group").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    places = parts.join(groups, "group").select("part", (F.col("before") + F.col("in_group")).alias("before"))
    return files.join(places, "part").select("part", "file", (F.col("before") + F.col("in_part")).alias("base"))


def read_documents(spark: SparkSession, out: str, key: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below out.

    The files are read twice: for the number of ids of each, and for their documents.
    """

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.ipc.open_stream(pa.BufferReader(x.as_buffer())).schema.metadata for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (b"part", b"file", b"n_ids")], ["part", "file", "n_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                file = SequenceFile(content.as_buffer())
                docs = file.documents()
                crc = [zlib.crc32(file.span(s, n).astype("<u4").tobytes()) for s, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist())]
                about = [pa.array([int(file.about[k])] * len(crc), pa.int64()) for k in ("part", "file")]
                yield pa.RecordBatch.from_arrays([*docs.columns, pa.array(crc, pa.int64()), *about], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "file"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")
    before = bases(files.mapInArrow(sizes, "part long, file long, n_ids long"))
    rows = files.mapInArrow(run, f"doc_id {key}, start long, n_tokens long, ids_crc32 long, part long, file long")
    return rows.join(before, ["part", "file"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    """The vocabulary file of the public tokenizers that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_rows(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """docs written to token files in the shared folder, and the documents read back from them."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark, lasting=True)}/token_files"
    write_tokens(docs.select("doc_id", "text"), tokenizer or default_tokenizer(), out, end)
    return read_documents(spark, out, docs.schema["doc_id"].dataType.simpleString())


def op6_token_stream(spark, sf_dir: str) -> DataFrame:
    """Every document as it stands in the token files: its place, length and checksum."""
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
