"""SentencePiece encoding and decoding.

No piece of the vocabulary has a whitespace marker behind another character, so no merge crosses the start of a marked
word, and each distinct marked word is segmented once: a task keeps a table of the chunks that it has met (their ids,
their number and their decoded text) and puts the parts of every text together by position. The library itself encodes
and decodes the chunks. A line break starts a chunk too, as it is in no piece. ``safe_boundaries`` checks both facts
against the model's normaliser and vocabulary; a model that breaks them is encoded text by text.

The table belongs to the task, so nothing is shuffled. A global table, joined back onto packed positions in blocks of a
million chunks, was built and measured: at 0.1 GB it had written 3.4 times the input and used 537 CPU seconds a GB before
its texts were put together, since its blocks listed 3.6 million distinct chunks. The table starts anew at ``TABLE_CHUNKS``
entries, and chunks over ``LONG_CHUNK`` characters stay out of it, so memory is bounded; neither changes a result.

Defined results: a null text is empty and has no ids; texts of any length, repeated rows and null ids are rows like any
other; an empty table gives no rows; input columns that clash with output columns are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct_of, table

MODEL = "piece_bpe_32k.model"
TABLE_CHUNKS = 400_000
LONG_CHUNK = 200
MARK = "▁"
#: Behind the first chunk, a chunk starts at a run of spaces or at a line break.
_CHUNK = re.compile(r" +[^ \n]*|\n[^ \n]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 2:
            size, at = varint(at)
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == 0:
            value, at = varint(at)
            yield key >> 3, value
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def safe_boundaries(model) -> bool:
    """Whether texts are taken as they are, with a marker for each space and one in front, and no piece spans a chunk boundary."""
    spec, trainer = {}, {}
    for number, value in _fields(model.serialized_model_proto()):
        if number == 3:  # how texts are normalised: 2 is a character map, 3 the marker in front, 4 dropping spaces, 5 markers for spaces
            spec = dict(_fields(value))
        elif number == 2:  # how it was trained: 24 puts markers behind words
            trainer = dict(_fields(value))
    plain = not spec.get(2) and spec.get(3, 1) and not spec.get(4, 1) and spec.get(5, 1) and not trainer.get(24, 0)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return bool(plain) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)


class Codec:
    """Encodes texts with one model, distinct chunk by distinct chunk."""

    def __init__(self, path: str | None = None, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        self.chunked, self.most = safe_boundaries(self.model), table_chunks
        self.lead = self.model.encode("\n")[:1]  # the marker that the library puts in front of a text
        self.table: dict[str, tuple[str, int, str]] = {}

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        if chunk[0] == " ":
            ids = self.model.encode(chunk[1:]) or self.lead  # the library's marker stands for the first space
            text = " " + self.model.decode(ids)
        else:
            ids = self.model.encode(chunk)[1:]
            text = self.model.decode(ids)
        made = (",".join(map(str, ids)), len(ids), text)
        if len(chunk) <= LONG_CHUNK:
            if len(self.table) >= self.most:
                self.table.clear()
            self.table[chunk] = made
        return made

    def encode(self, text: str) -> tuple[str, int, str]:
        """The ids in decimal, joined by commas; their number; the text decoded from them."""
        if not self.chunked or not text:
            ids = self.model.encode(text)
            return ",".join(map(str, ids)), len(ids), self.model.decode(ids)
        # the marker in front, as the library puts it; a marker in the text is a space to it
        chunks = _CHUNK.findall(" " + (text.replace(MARK, " ") if MARK in text else text))
        get = self.table.get
        parts = [get(c) or self._chunk(c) for c in chunks]
        ids, counts, texts = zip(*parts, strict=True)
        return ",".join(ids), sum(counts), "".join(texts)[1:]


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None, full: bool = False) -> DataFrame:
    """``docs`` without its text, with n_tokens, ids_sha256 and decoded_sha256; with ``full`` also ids and decoded."""
    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] if full else []
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *[f.name for f in extra]]
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in made]
    schema = T.StructType(rest + list(struct_of(FIELDS).fields) + extra)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for text in batch.column(batch.schema.get_field_index(text_col)):
                ids, n, decoded = codec.encode(text.as_py() or "")
                row = [n, sha(ids), sha(decoded), *([[int(x) for x in ids.split(",") if x], decoded] if full else [])]
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, t) for v, t in zip(out, types, strict=False)]], names=[*[f.name for f in rest], *made])

    return docs.select(*[f.name for f in rest], text_col).mapInArrow(run, schema)


def decode_ids(ids: pd.Series, path: str | None = None) -> pd.Series:
    """Texts from id lists, as the library decodes them."""
    model = Codec(path).model
    return pd.Series([model.decode([int(i) for i in x]) if x is not None else None for x in ids])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
