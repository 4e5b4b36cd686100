"""Offset-preserving SentencePiece encoding and decoding.

``Normaliser`` walks the model's compiled character map (a double-array trie of
source strings, each with its replacement) and takes the longest source string
that the text has at each place; every byte of the normalised text remembers the
source byte that it came from.  ``Encoder`` segments by the sentencepiece
library and projects every piece back to a span of source bytes through that
alignment.  Ids are exactly those of ``SentencePieceProcessor.encode``.

Edges: a null text counts as empty (one end id); extra columns are not looked
at; repeated rows give repeated rows; an empty table gives none.  Texts of any
length are encoded whole.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bioquery.llm import common

SPACE = "▁".encode()


def _fields(message: bytes):
    """(number, value) of the fields of a protobuf message; bytes or int values."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = message[at : at + size]
            at += size
        yield key >> 3, value


class ModelSpec:
    """What is needed of a model file: piece strings and types, and the normaliser's settings."""

    def __init__(self, proto: bytes):
        self.pieces, self.types = [], []
        self.charsmap, self.dummy_prefix, self.remove_spaces, self.escape_spaces = b"", True, True, True
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.types.append(piece.get(3, 1))
            elif number == 3:
                spec = dict(_fields(value))
                self.charsmap = spec.get(2, b"")
                self.dummy_prefix = bool(spec.get(3, 1))
                self.remove_spaces = bool(spec.get(4, 1))
                self.escape_spaces = bool(spec.get(5, 1))

    def piece_bytes(self):
        """Bytes of normalised text that each id covers; -1 for an unknown piece."""
        cover = {1: len, 4: len, 6: lambda _: 1, 2: lambda _: -1}  # normal, user defined, byte, unknown; control pieces cover none
        return np.array([cover.get(kind, lambda _: 0)(piece) for piece, kind in zip(self.pieces, self.types, strict=True)], dtype=np.int64)


class CharacterMap:
    """The compiled map: a size, a double-array trie of 32-bit units, then replacements that end in NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int):
        """(end, replacement) of the longest source string at a place, or None."""
        units = self.units
        if not units:
            return None
        found = None
        node = 0
        node ^= self._offset(units[0])
        for i in range(at, len(text)):
            byte = text[i]
            if byte == 0:
                break
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:  # the label of a leaf has the top bit set and so never matches
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:  # a source string ends here; its value is an offset into the replacements
                found = (i + 1, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end, value = found
        return end, self.replacements[value : self.replacements.index(b"\0", value)]

    @staticmethod
    def _offset(unit):
        return unit >> 10 << ((unit & 512) >> 6)


class Normaliser:
    def __init__(self, spec: ModelSpec):
        self.spec = spec
        self.map = CharacterMap(spec.charsmap)

    def __call__(self, text: bytes):
        """(normalised bytes, source byte of each normalised byte and of its end)."""
        if self.map.units or self.spec.remove_spaces:
            return self._walk(text)
        return self._escape(text)

    def _escape(self, text: bytes):
        """The case of an empty map: only spaces are rewritten, all places at once."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        source = np.frombuffer(text, dtype=np.uint8)
        mark = SPACE if self.spec.escape_spaces else b" "
        align = np.repeat(np.arange(len(source)), np.where(source == 32, len(mark), 1))
        out = text.replace(b" ", mark)
        if self.spec.dummy_prefix:
            out = mark + out
            align = np.concatenate([np.zeros(len(mark), dtype=np.int64), align])
        return out, np.append(align, len(source))

    def _step(self, text: bytes, at: int):
        """(end, replacement) at a place: the longest source string, else one character."""
        found = self.map.longest(text, at)
        if found:
            return found
        lead = text[at]
        end = at + (1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        return end, text[at:end]

    def _walk(self, text: bytes):
        spec = self.spec
        mark = SPACE if spec.escape_spaces else b" "
        at = 0
        if spec.remove_spaces:
            while at < len(text):
                end, new = self._step(text, at)
                if new != b" ":
                    break
                at = end
        if at >= len(text):
            return b"", np.zeros(1, dtype=np.int64)
        out, align = bytearray(), []
        if spec.dummy_prefix:
            out += mark
            align += [at] * len(mark)
        after_space = spec.remove_spaces
        while at < len(text):
            end, new = self._step(text, at)
            if after_space:
                new = new.lstrip(b" ")
            for byte in new:
                piece = mark if byte == 32 else bytes([byte])
                out += piece
                align += [at] * len(piece)
            if new:
                after_space = spec.remove_spaces and new.endswith(b" ")
            at = end
        last = at
        if spec.remove_spaces:
            while out.endswith(mark):
                last = align[len(out) - len(mark)]
                del align[len(out) - len(mark) :], out[len(out) - len(mark) :]
        return bytes(out), np.array([*align, last], dtype=np.int64)


class Encoder:
    """Ids and source spans of texts, and texts of ids."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.spec = ModelSpec(self.library.serialized_model_proto())
        self.normalise = Normaliser(self.spec)
        self.covers = self.spec.piece_bytes()

    def encode(self, texts):
        """Lists of ids; each ends with the end id."""
        return self.library.encode(texts, num_threads=1, add_bos=False, add_eos=True)

    def spans(self, text: str, ids):
        """(starts, ends) in source bytes of every piece but the end id; pieces follow each other without gaps."""
        normalised, align = self.normalise(text.encode())
        size = self.covers[np.asarray(ids, dtype=np.int64)]
        unknown = np.flatnonzero(size < 0)
        if len(unknown):
            size = self._fill(normalised, ids, size)
        ends = np.cumsum(size)
        if len(ends) and ends[-1] != len(normalised):
            raise ValueError("the pieces don't cover the normalised text")
        return align[ends - size][:-1], align[ends][:-1]

    def _fill(self, normalised, ids, size):
        """Sizes with those of unknown pieces, which reach up to where the next known piece is found."""
        at = 0
        size = size.copy()
        for i, covered in enumerate(size):
            if covered < 0:
                known = next((j for j in range(i + 1, len(ids)) if size[j] > 0), None)
                end = len(normalised) if known is None else normalised.index(self.spec.pieces[ids[known]], at + 1)
                size[i] = end - at
            at += size[i]
        return size

    def decode(self, ids):
        return self.library.decode(ids, num_threads=1)


def encode_documents(docs: DataFrame, model_path: str, id_column="doc_id", text_column="text", digests=True) -> DataFrame:
    """One row per document: its ids, source byte spans and decoded text, or their digests.

    digests: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (starts
    and ends as little-endian int64) and covered (the spans tile the text).
    Otherwise: doc_id, ids, starts, ends, decoded.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered boolean" if digests else "ids array<int>, starts array<long>, ends array<long>, decoded string")

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(model_path)
        decimal = [str(i) for i in range(len(encoder.covers))]
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = ["" if x is None else x for x in part.column(1).to_pylist()]
                columns = [[] for _ in names[1:]]
                for text, ids in zip(texts, encoder.encode(texts), strict=True):
                    starts, ends = encoder.spans(text, ids)
                    decoded = encoder.library.decode(ids)
                    if digests:
                        covered = not len(starts) or bool(starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all())
                        row = (len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), hashlib.sha256(np.concatenate([starts, ends]).astype("<i8").tobytes()).hexdigest(), covered)
                    else:
                        row = (ids, starts, ends, decoded)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                if digests:
                    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                else:
                    types = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]], names=names)

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(common.lean(run), schema)
