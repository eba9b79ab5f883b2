"""Byte-level BPE encoding and decoding.

A piece is encoded from its longest matches: an Aho-Corasick automaton over the vocabulary, bytes mapped to Latin-1
characters, finds the longest token at a byte. The walk takes the longest token, steps back to a shorter one
when two neighbours would not stand beside each other after merging, and never enters a position twice that proved
a dead end; every prefix has one valid last token, so the walk is linear in the piece. Whether two tokens may be
neighbours is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from byline.llm.staging import text_or_empty
from byline.llm.worker import kept

#: Entries a worker remembers at most, of pieces and of neighbours; of pieces the half longest not asked for goes first, neighbours go
#: at once. Pieces longer than this many characters are not kept.
MEMORY, MEMORY_CHARS = 200_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], int]:
    """The tokens of a short piece by plain merging, lowest rank first, and where the last merge joined its halves."""
    parts, joint = [piece[i:i + 1] for i in range(len(piece))], 0
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        joint = len(parts[best[1]])
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts, joint


def latin_pattern(pattern: str) -> bytes | None:
    """``pattern`` for texts in Latin-1 bytes, its character classes spelled out; None if it holds other escapes."""
    def members(escape: str) -> bytes:
        fits = regex.compile(escape).match
        return b"".join(re.escape(bytes([i])) for i in range(256) if fits(chr(i)))

    out, inside = [], False
    for m in re.finditer(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        part = m[0]
        if part.startswith("\\"):
            if not re.fullmatch(r"\\p\{[LN]\}|\\[sS]", part) or (inside and part == "\\S"):
                return None
            out.append(members(part) if inside else b"[" + members(part) + b"]")
        elif ord(part) > 127:
            return None
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part.encode())
    return b"".join(out)


class Encoder:
    """Encodes and decodes texts with one vocabulary; ``pattern`` cuts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_pieces = re.compile(latin).findall if latin else None
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        #: ids of pieces, newer and older ones; those of Latin-1 texts are bytes
        self.known: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():  # a token that merging never makes can only be a whole piece
            parts, joint = merged(token, ranks)
            if len(parts) == 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
                if joint:
                    self.halves[rank] = ranks[token[:joint]], ranks[token[joint:]]
        self.automaton.make_automaton()
        made = self.made = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.halves}
        self.size, self.longest = {i: len(t) for t, i in made.items()}, max(map(len, made), default=0)
        #: the next shorter token with which a token begins
        self.shorter = {i: next((made[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in made), -1) for t, i in made.items()}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when their joined bytes are merged (memoised).

        They do not if, while they are built, the parts that meet at the seam make a token that comes before the
        merges still due on either side. So the later built of the two is opened at the seam, again and again.
        """
        key = a << 32 | b
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= MEMORY:
                self.fits.clear()
            fit = self.fits[key] = self._apart(a, b)
        return fit

    def _apart(self, a: int, b: int) -> bool:
        bytes_of, ranks, halves = self.bytes_of, self.ranks, self.halves
        due = 1 << 60  # the earliest merge that must already have happened
        while True:
            seam = ranks.get(bytes_of[a] + bytes_of[b], 1 << 60)
            if seam < due:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                due, a = a, left[1]
            else:
                due, b = b + 1, right[0]  # at the same rank the left place merges first

    def walk(self, piece: bytes) -> list[int]:
        """The tokens of a piece that is no token itself."""
        n, latin = len(piece), piece.decode("latin-1")
        size, shorter, fits, neighbours, token_at = self.size, self.shorter, self.fits, self.neighbours, self.made.get
        most, prefix = self.longest, self.automaton.longest_prefix
        dead, path, at, last = bytearray(n + 1), [], 0, -1
        while at < n:
            # As far as the automaton follows; the longest token ends there or before.
            ahead, token = prefix(latin[at:at + most]), None
            while ahead and token is None:
                token = token_at(piece[at:at + ahead])
                ahead -= 1
            token = -1 if token is None else token
            while True:
                while token >= 0:
                    if not dead[at + size[token]]:
                        fit = last < 0 or fits.get(last << 32 | token)
                        if fit or (fit is None and neighbours(last, token)):
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if not path:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                last = path[-1] if path else -1
            path.append(token)
            at += size[token]
            last = token
        return path

    def _ids(self, raw: bytes) -> bytes:
        whole = self.ranks.get(raw)
        return array("I", [whole] if whole is not None else self.walk(raw)).tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        try:
            pieces = self.latin_pieces(text.encode("latin-1"))
        except (UnicodeEncodeError, TypeError):
            pieces = self.pieces(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for i, got in enumerate(ids):
                if got is None:
                    ids[i] = self._piece(pieces[i])
        return b"".join(ids)

    def _piece(self, piece: str | bytes) -> bytes:
        """The ids of a piece; what is asked for again moves up before the older half is forgotten."""
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            ids = self._ids((piece.decode("latin-1") if isinstance(piece, bytes) else piece).encode())
        if len(piece) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY // 2:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


def _worker_encoder(name: str, ranks, pattern: str) -> Encoder:
    """One encoder per Python worker, kept over its tasks until another operator's work comes."""
    return kept(("bpe", name, pattern), lambda: Encoder(ranks.value, pattern))


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for x in batch.column(name):
        yield x.as_py() or ""


def _broadcast(spark: SparkSession, path: str):
    """The vocabulary for all workers and a name for it: its size is that of the file, whatever the input."""
    ranks = read_ranks(path)
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids", verify: bool = False) -> DataFrame:
    """``docs`` with ``ids_col``, the token ids (array of int) of each whole text; null texts count as empty.

    ``vocabulary`` is the path of a rank file on the driver. Empty texts have no ids, empty tables no rows; long
    texts are encoded whole. An existing column ``ids_col`` is replaced. With ``verify`` the ids of every text are decoded again
    and the job fails if they do not give the text back.
    """
    name, ranks = _broadcast(docs.sparkSession, vocabulary)
    rows, source = docs.drop(ids_col), text_col
    if rows.schema[text_col].dataType != StringType():  # a string goes to the workers once, as it is
        rows, source = rows.withColumn("_text", text_or_empty(F.col(text_col))), "_text"
    schema = docs.drop(ids_col).withColumn(ids_col, F.array(F.lit(0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_encoder(name, ranks, pattern)
        for batch in batches:
            for part in _slices(batch):
                made = []
                for text in _texts(part, source):
                    got = coder.encode(text)
                    if verify and coder.decode(got) != text.encode():
                        raise ValueError("ids do not decode to the text they were made from")
                    made.append(np.frombuffer(got, "<u4").astype(np.int32))
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.concatenate([*made, np.zeros(0, np.int32)]))
                names = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), ids], [*names, ids_col])

    return rows.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch, so that results never pile up."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``, the bytes (binary) of the ids; null ids give null, unknown ids an error."""
    _, ranks = _broadcast(docs.sparkSession, vocabulary)
    schema = docs.drop(bytes_col).withColumn(bytes_col, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            for part in _slices(batch):
                made = [None if x.as_py() is None else b"".join(map(bytes_of.__getitem__, x.as_py())) for x in part.column(ids_col)]
                names = [c for c in part.schema.names if c != bytes_col]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(made, pa.binary())], [*names, bytes_col])

    return docs.mapInArrow(run, schema)


def encoded_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encode and decode in one pass over the text.

    Rows are independent: repeated rows repeat, a null id stays null, a null text counts as empty.
    """
    name, ranks = _broadcast(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_encoder(name, ranks, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for text in _texts(batch, "_text"):
                got = coder.encode(text)
                n.append(len(got) // 4)
                ids.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(coder.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
