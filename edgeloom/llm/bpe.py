"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its bytes says so, so equal passages of different documents give equal chunks whatever
stands around them. A chunk is encoded once per worker and its ids are reused. Where two chunks meet, the ids around the cut
may be wrong; the join is repaired by re-encoding a stretch around the cut, which is widened until its ends fall on token
boundaries of what stands left and right of it and on places that the pre-tokenizer always splits.

Such a place is between a character that is no white space and a space: no pre-token of byte-level BPE has a space after its
first character unless it is all white space, and no look-ahead reaches over it. So ids on both sides of it do not depend on
each other, and the result is exactly that of encoding the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import process_cache

#: Fixed value: the pattern by which byte-level BPE of this family splits text before merging.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW, MASK, LEAST, MOST = 16, 0x7FF, 256, 1 << 15
#: Bound of a worker's cache: bytes of chunks with their ids.
CHUNK_BYTES = 48 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str | None = None):
        import tiktoken

        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.bpe, self.known = self.core._core_bpe, set(special)
        size = 1 + max([*ranks.values(), *special.values()])
        self.pieces: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.pieces[i] = token
        self.lengths = [len(x) for x in self.pieces]
        self.chunks: dict[bytes, bytes] = {}
        self.chunk_bytes = 0
        self.gear = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)

    # -- exact encoding of a stretch --------------------------------------------------------------------------------

    def plain(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers, through no cache."""
        return bytes(self.bpe.encode_to_tiktoken_buffer(text, self.known)) if text else b""

    def literal(self, text: str) -> bytes:
        """As plain(), but the strings of special tokens are text like any other, so no id but those of ordinary pieces comes out."""
        return bytes(self.bpe.encode_to_tiktoken_buffer(text, frozenset())) if text else b""

    # -- chunks ------------------------------------------------------------------------------------------------------

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks of a text's bytes, each on a character's first byte."""
        n = len(data)
        if n <= 2 * LEAST:
            return [n]
        h = self.gear[np.frombuffer(data, np.uint8)]
        width = 1
        while width < WINDOW:  # afterwards h[i] depends on the WINDOW bytes that end at i
            h[width:] = (h[width:] << np.uint32(width)) + h[:-width]
            width *= 2
        out, last = [], 0
        for i in (np.flatnonzero((h[WINDOW:] >> np.uint32(13)) & np.uint32(MASK) == 0) + WINDOW + 1).tolist():
            if i - last < LEAST:
                continue
            while i - last > MOST:
                last = self._start(data, last + MOST)
                out.append(last)
            i = self._start(data, i)
            if i < n and i > last:
                out.append(i)
                last = i
        while n - last > MOST:
            last = self._start(data, last + MOST)
            out.append(last)
        if last < n:
            out.append(n)
        return out

    @staticmethod
    def _start(data: bytes, i: int) -> int:
        while i < len(data) and data[i] & 0xC0 == 0x80:
            i += 1
        return i

    def chunk(self, data: bytes) -> bytes:
        ids = self.chunks.get(data)
        if ids is None:
            ids = self.plain(data.decode())
            self.chunk_bytes += len(data) + len(ids)
            if self.chunk_bytes > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = len(data) + len(ids)
            self.chunks[data] = ids
        return ids

    @staticmethod
    def _sure(data: bytes, i: int) -> bool:
        """Whether the pre-tokenizer splits before byte i whatever else the text holds."""
        if i <= 0 or i >= len(data):
            return True
        return data[i] == 0x20 and not data[max(0, i - 4) : i].decode(errors="ignore")[-1:].isspace()

    def _sure_before(self, data: bytes, i: int) -> int:
        while (i := data.rfind(b" ", 0, i)) > 0:
            if self._sure(data, i):
                return i
        return 0

    def _sure_after(self, data: bytes, i: int) -> int:
        while (i := data.find(b" ", i)) >= 0:
            if self._sure(data, i):
                return i
            i += 1
        return len(data)

    def _tokens(self, ids: memoryview, size: int) -> int | None:
        """How many of the first tokens make exactly so many bytes."""
        k = 0
        for i in ids:
            if size <= 0:
                break
            size -= self.lengths[i]
            k += 1
        return k if size == 0 else None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, by chunks; equal to plain(text)."""
        data = text.encode()
        out, done, start = bytearray(), 0, 0
        for end in self.cuts(data):
            if end > done:
                ids = self.chunk(data[start:end])
                if start == done and not self._sure(data, start):
                    done = self._repair(data, out, start)
                skip = 0
                while start < done < end:
                    skip = self._tokens(memoryview(ids).cast("I"), done - start)
                    if skip is not None:
                        break
                    after = self._sure_after(data, done + 1)  # no agreement on the right: widen
                    out += self.plain(data[done:after].decode())
                    done = after
                if done < end:
                    out += ids[4 * (skip or 0) :]
                    done = end
            start = end
        return bytes(out)

    def _repair(self, data: bytes, out: bytearray, cut: int) -> int:
        """Replace the last ids of out by those of a stretch around the cut; return its end."""
        left = cut
        while True:
            left = self._sure_before(data, left)
            size, k = cut - left, 0
            with memoryview(out) as raw, raw.cast("I") as ids:
                while size > 0 and k < len(ids):
                    k += 1
                    size -= self.lengths[ids[-k]]
            if size == 0:
                break
            if left == 0:
                k = len(out) // 4
                break
        if k:
            del out[-4 * k :]
        right = self._sure_after(data, cut)
        out += self.plain(data[left:right].decode())
        return right

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in memoryview(ids).cast("I")]).decode(errors="replace")



def codec(path: str | None = None) -> Codec:
    """The worker's codec for a vocabulary file; loaded once."""
    held = process_cache("codecs")
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): every whole text's ids, packed as little-endian unsigned 32-bit integers in a binary column.

    One row for each input row, in no order; no shuffle. A null text counts as empty, an empty one gives empty ids. Repeated
    rows, null ids and other columns need no care: rows are independent and only the two named columns are read. path: the
    vocabulary file, which every executor must have (default: that of the installed tokenizer package).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                ids = pa.array([c.encode(x) if x else b"" for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the text of packed ids, special tokens included. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                text = pa.array([c.decode(x or b"") for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], [id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` binary, decoded string")


def op1_bpe_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = decode(encode(docs))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
