"""SentencePiece ids of whole texts, and texts of ids, by a public model file.

The model writes a text as its words, each with a marker for every space before
it, and one more marker before the first. No piece of the model holds a marker
behind another character, so no merge crosses from one marked word (a *chunk*:
markers, then everything up to the next marker) into the next. The ids of a text
are those of its chunks one after another:

1. a slice of texts is cut into chunks on its bytes, by position;
2. equal chunks are put together, and each distinct one is segmented once, by the
   library itself;
3. the ids are joined back by position, and every text ends with the end id.

Segmented chunks are kept for the life of a Python worker, up to ``KEPT`` chunks of
at most ``KEPT_BYTES`` bytes; beyond, a chunk is segmented once a slice. Chunks are told
apart inside a slice by a 64-bit hash, across slices by their bytes.

That a model allows this (markers only in front, texts kept as they are but for
markers, one marker put in front) is checked when it is loaded; texts of any
other model are one chunk each. Decoding gives the library each text's ids.

Edge cases: a null or empty text has the end id alone and decodes to an empty text; null ids
decode to null. A marker character inside a text is a space (the library decodes it as one).
Characters the model lacks become their UTF-8 bytes' pieces. Repeated rows give equal rows; a text
of any length is one row, and one without spaces is one chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .common import bounded_batches, fresh, read

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
KEPT, KEPT_BYTES = 300_000, 48
SLICE_BYTES = 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def chunks(s: B.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chunks of a slice start and end, without their first marker, and the index of
    each text's first chunk (one entry more than texts).

    A space after another character is the first marker of a chunk. A text's own first chunk
    starts at its first byte, as its first marker is not written there; an empty text has none."""
    d, offsets = s.data, s.offsets
    space = d == 0x20
    opens = np.zeros(len(d), bool)
    opens[1:] = space[1:] & ~space[:-1]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    heads = offsets[:-1][full]
    opens[heads] = False
    marks = np.flatnonzero(opens)
    starts = np.concatenate((heads, marks + 1))
    begin = np.concatenate((heads, marks))      # with the marker, where it is written
    order = np.argsort(begin, kind="stable")
    starts, begin = starts[order], begin[order]
    return starts, np.append(begin[1:], len(d))[: len(begin)], np.searchsorted(begin, offsets)


class ChunkIds:
    """One model's processor and its table of segmented chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end, self.marker = p.eos_id(), p.piece_to_id(MARKER)
        pieces = [p.id_to_piece(i) for i in range(p.vocab_size())]
        self.by_chunk = (
            self.marker != p.unk_id() and pieces[self.marker] == MARKER
            and not any(MARKER in piece.lstrip(MARKER) for piece in pieces)
            and p.normalize(" a  ｂ\t é ").replace(" ", MARKER) == f"{MARKER * 2}a{MARKER * 2}ｂ\t{MARKER}é{MARKER}"
            and p.encode("") == [])
        self.kept: dict[bytes, np.ndarray] = {b"": np.array([self.marker], np.int32)}

    def _segment(self, raws: list[bytes]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.processor.encode([r.decode("utf-8", "replace") for r in raws], num_threads=1)]

    def slice(self, s: B.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text's with the end id, and where each
        text's start (one entry more than texts)."""
        raw, texts = s.data.tobytes(), len(s.offsets) - 1
        if self.by_chunk:
            starts, ends, first = chunks(s)
        else:
            full = np.flatnonzero(s.offsets[1:] > s.offsets[:-1])
            starts, ends = s.offsets[:-1][full], s.offsets[1:][full]
            first = np.searchsorted(starts, s.offsets)
        # distinct chunks; the empty one (a marker alone) is number 0
        some = np.flatnonzero(ends > starts)
        inside = np.zeros(len(s.data) + 1, np.int8)
        np.add.at(inside, starts[some], 1)
        np.add.at(inside, ends[some], -1)
        hashes = B.run_hashes(s.data, np.cumsum(inside[:-1], dtype=np.int8).astype(bool), starts[some], ends[some])
        _, at, place = B.distinct(hashes)
        words = [raw[a:z] for a, z in zip(starts[some][at].tolist(), ends[some][at].tolist())]
        got = [self.kept.get(w) for w in words]
        new = [i for i, ids in enumerate(got) if ids is None]
        for i, ids in zip(new, self._segment([words[i] for i in new])):
            got[i] = ids
            if len(self.kept) < KEPT and len(words[i]) <= KEPT_BYTES:
                self.kept[words[i]] = ids
        table = [self.kept[b""], *got]
        sizes = np.fromiter(map(len, table), np.int64, len(table))
        flat, begin = np.concatenate(table), np.cumsum(sizes) - sizes
        number = np.zeros(len(starts), np.int64)
        number[some] = place + 1
        # by position: the ids of every chunk, then room for each text's end id
        each = sizes[number]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[number] - upto[:-1], each)]
        last = upto[first]
        return np.insert(ids, last[1:], self.end).astype(np.int32), last + np.arange(texts + 1)


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The worker's own table of this model."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def encoder(spark: SparkSession, path: str | None = None):
    """UDF of a text: its ids, end id included."""
    bounded_batches(spark)
    path = path or default_path()

    def encode(texts: pa.Array) -> pa.Array:
        if pc.any(pc.match_substring(texts, MARKER)).as_py():
            texts = pc.replace_substring(texts, MARKER, " ")
        parts = [chunk_ids(path).slice(s) for s in B.slices(texts, SLICE_BYTES)]
        if not parts:
            return pa.array([], pa.list_(pa.int32()))
        return pa.chunked_array([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)) for ids, at in parts]).combine_chunks()
    return F.arrow_udf(encode, "array<int>")


def decoder(spark: SparkSession, path: str | None = None):
    """UDF of an array of ids: the library's text of them."""
    bounded_batches(spark)
    path = path or default_path()

    def decode(ids: pa.Array) -> pa.Array:
        processor = chunk_ids(path).processor
        return pa.array([None if row is None else processor.decode(row.values.to_numpy(zero_copy_only=False).tolist()) for row in
                         (r if r.is_valid else None for r in ids)], pa.string())
    return F.arrow_udf(decode, "string")


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the ids of a text column (array of int, end id included)."""
    return df.withColumn(out, encoder(df.sparkSession, path)(text))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that an id column decodes to."""
    return df.withColumn(out, decoder(df.sparkSession, path)(ids))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids, text = fresh(docs, "ids"), fresh(docs, "decoded")
    rows = decode(encode(docs, "text", ids), ids, text)
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(text, 256).alias("decoded_sha256"))
