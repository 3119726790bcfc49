"""Encoding of whole texts with a public byte-level BPE vocabulary by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be joined by a merge, so
every place between such a pair is a certain cut: the fragments on both sides are encoded by themselves
and their ids concatenated. Because fragments repeat all over a corpus, each distinct one is encoded once
per worker and looked up afterwards.

The vocabulary's pattern looks at the text too. A place between a character that is no white space and white
space is a certain cut by the pattern alone, as no merge crosses its matches. At any other place the pair table
decides, and besides the byte before a cut is never white space (the pattern looks ahead after white space) and
the character after it is not an apostrophe (contractions), so the result equals the encoding of the whole text.

Defined cases: a null or empty text gives an empty array; strings that look like special tokens are
ordinary text; nothing is cut off, whatever a text's length.
"""

from __future__ import annotations

import array
import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("SILTGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: The pre-tokenizing pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space, which the pattern's \s means.
SPACE = "\t-\r \x85\xa0  -     　"

_LINE = re.compile(f"[{SPACE}]*[^\n]*[^{SPACE}]|[{SPACE}]+")
_PART = re.compile(f"[{SPACE}]*[^{SPACE}0-9]*(?:[0-9:]*[0-9])?")
_DIGIT = re.compile("[0-9]")
_LEAD = re.compile(f"[{SPACE}]*")

#: Distinct fragments kept by one worker before it starts afresh; it bounds memory, not what is encoded.
KEPT = 250_000
#: Bytes of a fragment above which the pair table is searched for further certain cuts.
LONG = 2_048
#: Bytes of text handled at a time in a worker.
BLOCK = 8_000_000


class Encoder:
    """The vocabulary, its table of pairs that never occur inside a token, and the fragments met so far."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("siltgrid", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.never = np.ones(65536, bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int32)
                self.never[b[:-1] * 256 + b[1:]] = False
        table = self.never.reshape(256, 256)
        others = [b for b in range(256) if b not in b"0123456789'"]
        #: May every place between a digit and another byte, but for an apostrophe, be cut?
        self.cut_after_number = bool(table[48:58][:, others].all())
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = array.array("i")
        self.start = array.array("q")
        self.size = array.array("i")

    def forced(self, text: str) -> list[str]:
        """text cut at every certain place that the pair table gives; text may only start with white space."""
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8)
        lead = len(_LEAD.match(text)[0].encode())
        after = b[1:]
        cut = self.never[b[:-1].astype(np.int32) * 256 + after] & ((after & 0xC0) != 0x80) & (after != 0x27)
        cut[:lead] = False
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(raw)]
        return [raw[i:j].decode() for i, j in zip(at, at[1:])]

    def parts(self, text: str) -> list[str]:
        """Certain fragments of a stretch of text."""
        found = _PART.findall(text) if self.cut_after_number and "'" not in text else _LINE.findall(text)
        if len(text) > LONG // 4:
            found = [y for x in found for y in (self.forced(x) if len(x) > LONG // 4 and not x.isspace() else (x,))]
        return found

    def _add(self, fragment: str) -> int:
        ids = self.bpe.encode_ordinary(fragment)
        k = self.code[fragment] = len(self.size)
        self.start.append(len(self.ids))
        self.size.append(len(ids))
        self.ids.extend(ids)
        return k

    def codes(self, text: str) -> list[int]:
        """The fragments of a whole text by their places in the table of those met so far."""
        get, out = self.code.get, []
        for line in _LINE.findall(text):
            k = get(line)
            if k is not None:
                out.append(k)
            elif len(line) > 200 or _DIGIT.search(line):
                out += [k if (k := get(x)) is not None else self._add(x) for x in self.parts(line)]
            else:
                out.append(self._add(line))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a list of texts."""
        if len(self.code) > KEPT:
            self.reset()
        each = [self.codes(t) if t else [] for t in texts]
        count = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((k for c in each for k in c), np.int64, int(count.sum()))
        size = np.frombuffer(self.size, np.int32)[flat].astype(np.int64) if len(flat) else flat
        offsets = np.zeros(len(each) + 1, np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        offsets[1:] = ends[np.cumsum(count)]
        if not len(flat):
            return offsets, np.empty(0, np.int32)
        start = np.frombuffer(self.start, np.int64)[flat]
        place = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        return offsets, np.frombuffer(self.ids, np.int32)[place]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Only the number of ids of each text."""
        return np.diff(self.encode(texts)[0])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def _blocks(column: pa.Array):
    """Slices of a text column of about BLOCK bytes, so that long texts don't fill a worker's memory."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // BLOCK
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return [(i, j) for i, j in zip(edges, edges[1:]) if j > i]


def encode_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row of df; there is no shuffle, each partition is encoded where it is read."""
    path = path or vocabulary_path()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in _blocks(texts):
                offsets, values = coder.encode(texts.slice(i, j - i).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists], names=[id_column, "ids"])

    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], text_column: str = "text", path: str | None = None) -> DataFrame:
    """The columns in `keep` and n_tokens (int) of every row of df, without handing ids back to the JVM."""
    path = path or vocabulary_path()

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in _blocks(texts):
                n = coder.lengths(texts.slice(i, j - i).to_pylist()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(n)], names=[*keep, "n_tokens"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.IntegerType())])
    return df.select(*keep, text_column).mapInArrow(run, schema)
