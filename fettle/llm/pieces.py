"""SentencePiece ids by a table of distinct chunks.

Spaces become markers, and a chunk is a run of markers with what follows up to the next marker. No piece of the model
holds a marker after another character, so a merge never crosses a chunk's start and each chunk can be segmented alone.

1. Chunks are counted over all texts, summed inside each task before the shuffle; each distinct one that occurs twice or more is segmented
   once and written with its ids.
2. The most frequent of them, whole steps of frequency up to ``SHARED`` bytes measured from the table, go to the workers, and the ids are joined back
   by position where the text stands: joining every place of every chunk by shuffle would move several times the input.
3. The others, the tail of the table, are segmented by the worker that meets them, which keeps up to ``MEMO`` of them.

``can_cross`` tells whether a model keeps the property; with one that does not, whole texts are encoded.

Defined results: null is encoded as the empty text, which has no ids; repeated rows are encoded one by one; an empty table stays empty; very
long texts are encoded whole, one at a time; own columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm.arrow import kept_fields, map_arrow
from fettle.session import settle

MODEL = "piece_bpe_32k.model"
SHARED = 12 << 20
MEMO = 100_000
#: Distinct chunks that a task counts before it hands them on.
HELD = 1 << 19
LIMIT = 1 << 20
MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def can_cross(model) -> bool:
    """Whether a piece has a marker after another character."""
    return any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))


class ChunkTable:
    """Ids by chunk; keys are chunks as plain text without their first marker, which the library adds.

    ``known`` are the chunks segmented before; of others up to ``size`` are kept at a time.
    """

    def __init__(self, model, size: int = MEMO, known: dict[str, list[int]] | None = None):
        self.model, self.size, self.known = model, size, (known or {}) | {"": [model.piece_to_id(MARK)]}
        self.ids, self.whole = dict(self.known), can_cross(model)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:].replace(MARK, " ") for c in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        if self.whole:
            return self.model.encode(text, num_threads=1)
        parts = self.chunks(text)
        if missing := {c for c in parts if c not in self.ids}:
            if len(self.ids) + len(missing) > len(self.known) + self.size:
                self.ids = dict(self.known)
                missing = {c for c in parts if c not in self.ids}
            new = sorted(missing)
            self.ids.update(zip(new, self.model.encode(new, num_threads=1), strict=True))
        return list(chain.from_iterable(map(self.ids.__getitem__, parts)))


def _count(batches: Iterator[pa.RecordBatch], path: str, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of a task and their numbers; a task with very many hands them on in parts."""
    import sentencepiece

    table, count = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=path)), Counter()
    for batch in batches if not table.whole else ():
        for x in batch[text]:
            count.update(table.chunks(x.as_py() or ""))
            if len(count) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], schema=schema)
                count = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], schema=schema)


def _segment(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=path))
    for batch in batches:
        chunks = batch["chunk"].to_pylist()
        ids = [table.known[""] if not c else own for c, own in zip(chunks, table.model.encode(chunks, num_threads=1), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["chunk"], batch["n"], pa.array(ids, schema.field("ids").type)], schema=schema)


def chunk_table(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(chunk, n, ids): every distinct chunk that the texts hold twice or more, segmented once; a settled table."""
    counted = map_arrow(docs.select(text), _count, [T.StructField("chunk", T.StringType()), T.StructField("n", T.LongType())], path=path or model_path(), text=text)
    several = counted.groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    fields = [T.StructField("chunk", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return settle(map_arrow(several, _segment, fields, path=path or model_path()), "chunks")


def frequent(table: DataFrame, most: int = SHARED) -> pa.Table:
    """The most frequent chunks and their ids: whole steps of frequency, ``most`` bytes of texts and ids in all."""
    size = F.sum(F.octet_length("chunk") + 4 * F.size("ids") + 16).alias("size")
    steps = table.groupBy(F.floor(16 * F.log2("n")).alias("step")).agg(size, F.min("n").alias("n")).collect()
    least, taken = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        taken += r["size"]
        if taken > most:
            break
        least = r["n"]
    return table.where(F.col("n") >= least if least else F.lit(False)).select("chunk", "ids").toArrow()


_KNOWN: list = [None, {}]


def _known(table: pa.Table) -> dict[str, list[int]]:
    """A shared table as a dictionary, made once in a worker; it takes the place of an older one."""
    if _KNOWN[0] is not table:
        _KNOWN[:] = [table, dict(zip(*[c.to_pylist() for c in table.columns], strict=True))]
    return _KNOWN[1]


def _encode(batches: Iterator[pa.RecordBatch], path: str, text: str, kept: list[str], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    table = ChunkTable(sentencepiece.SentencePieceProcessor(model_file=path), known=_known(shared.value))
    for batch in batches:
        first = 0
        texts = batch[text]
        while first < len(texts):
            ids, decoded, size, end = [], [], 0, first
            while end < len(texts) and (size < LIMIT or end == first):
                own = table.encode(texts[end].as_py() or "")
                ids.append(own)
                decoded.append(table.model.decode(own))
                size, end = size + len(decoded[-1]), end + 1
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, count=at[-1])
            own = [pa.ListArray.from_arrays(at, pa.array(flat)).cast(schema.field("ids").type), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([batch[c].slice(first, end - first) for c in kept] + own, schema=schema)
            first = end


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded``; texts are read twice, for the table and to be encoded, and never shuffled.

    ``path`` is where each executor finds the model; by default the installed public one.
    """
    kept = [c for c in docs.columns if c not in ("ids", "decoded") or c == text]
    rows = docs.select(*kept)
    kept = [c for c in kept if c not in ("ids", "decoded")]
    fields = kept_fields(rows, kept) + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    shared = docs.sparkSession.sparkContext.broadcast(frequent(chunk_table(docs, text, path)))
    return map_arrow(rows, _encode, fields, path=path or model_path(), text=text, kept=kept, shared=shared)


def digests(encoded: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` replaced by n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("ids", "decoded")
