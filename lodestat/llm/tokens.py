"""Token ids of whole texts by a public tokenizer file, for the packing and the binary output.

The file's path is a parameter and must exist on every machine; nothing is trained and no vocabulary is copied.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestat.llm.common import text_of

#: Distinct chunks a worker remembers before it starts anew; bounds its memory, never its results.
CHUNKS_KEPT = 600_000
TOGETHER = 2_000

_LOADED: dict[str, TextEncoder] = {}


#: Classes of bytes: ASCII letters, digits, other visible ones; first bytes of characters that are never white space; a space; other
#: ASCII white space. 0 are bytes that tell nothing: no cut rests on them.
_LETTER, _DIGIT, _SIGN, _LEAD, _SPACE, _FEED = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0xC3:0xF5] = _LEAD
_CLASS[[0xE1, 0xE2, 0xE3]] = 0      # U+1680, U+2000 and so on, U+3000 are white space
_CLASS[0x09:0x0E] = _FEED
_CLASS[0x20] = _SPACE


def cuts(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes of texts with the given ends: true where the byte-level pre-tokenizer surely starts a new piece, and what stands between two cuts has the same pieces alone.

    That is before a run of white space, before its last character if something visible follows, after it unless it is a space (which
    goes with the next piece), and between ASCII letters, digits and other signs, but not after an apostrophe (``'s`` is a piece)."""
    kind = _CLASS[flat]
    out = np.zeros(len(flat), bool)
    if len(flat) < 2:
        return out
    white, seen = kind >= _SPACE, (kind >= _LETTER) & (kind <= _LEAD)
    out[:-1] = white[:-1] & seen[1:]
    out[ends[ends > 0] - 1] = False     # what follows is another text
    out[1:] |= (kind[:-1] == _FEED) & seen[1:]
    plain = (kind >= _LETTER) & (kind <= _SIGN)
    out[1:] |= plain[:-1] & white[1:]
    out[1:] |= plain[:-1] & plain[1:] & (kind[:-1] != kind[1:]) & (flat[:-1] != 0x27)
    return out


class TextEncoder:
    """Encodes lists of texts; the ids equal those of ``Tokenizer.encode`` of each whole text.

    No merge of a byte-level tokenizer crosses the pieces of its pre-tokenizer. So a text is cut where a piece surely starts
    (``cuts``), each distinct chunk is encoded once by the tokenizer, and the ids are put together again. Texts under other kinds of
    tokenizer are encoded whole. Strings of special tokens within a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer is not None else {}
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not t.special]
        self.by_chunk = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
                         and self.tokenizer.normalizer is None and not added and self.tokenizer.truncation is None)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        apart = self.tokenizer.encode("a\n b", add_special_tokens=False).ids
        self.feed = apart[1] if len(apart) == 3 else None
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(1 << 16, self.kind)
        self.starts, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.filled = 0

    def whole(self, some: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, np.uint32).astype(self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def learn(self, new: pa.Array) -> None:
        """Encodes chunks that were not met before. Those without white space but a space in front go to the tokenizer together, with
        line feeds between them that are tokens of their own."""
        n, m = len(self.known), len(new)
        self.starts, self.sizes = _room(self.starts, n + m), _room(self.sizes, n + m)
        every = new.to_pylist()
        words = [c.split() for c in every]
        together = [i for i, (c, w) in enumerate(zip(every, words, strict=True)) if self.feed is not None and len(w) == 1 and (c == w[0] or c[0] == " " and c[1:] == w[0])]
        for i in range(0, len(together), TOGETHER):
            at = together[i:i + TOGETHER]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["\n".join([every[k] for k in at])], add_special_tokens=False)[0].ids, self.kind)
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != len(at) - 1:
                raise RuntimeError("a line feed is no token of its own under this tokenizer")
            self.remember(n + np.asarray(at), np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1, ids[ids != self.feed])
        alone = sorted(set(range(m)).difference(together))
        for i in range(0, len(alone), TOGETHER):
            at = alone[i:i + TOGETHER]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([every[k] for k in at], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            self.remember(n + np.asarray(at), sizes, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())))
        self.known = pa.concat_arrays([self.known, new])

    def remember(self, at: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.ids = _room(self.ids, self.filled + len(flat))
        self.ids[self.filled:self.filled + len(flat)] = flat
        self.starts[at], self.sizes[at] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.filled += len(flat)

    def encode(self, some: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes."""
        some = (some if isinstance(some, pa.Array) else pa.array(some, pa.string())).cast(pa.string())
        if not self.by_chunk or not len(some):
            return self.whole(some.to_pylist())
        collecting = gc.isenabled()
        gc.disable()        # millions of short strings and no cycles
        try:
            return self.by_chunks(some)
        finally:
            if collecting:
                gc.enable()

    def by_chunks(self, some: pa.StringArray) -> list[bytes]:
        """Cuts texts, makes chunks distinct and looks them up within Arrow; only new ones become Python strings."""
        if len(self.known) > CHUNKS_KEPT:
            self.forget()
        _, offsets, data = some.buffers()
        texts = np.frombuffer(offsets, np.int32)[some.offset:some.offset + len(some) + 1].astype(np.int64)
        flat = np.frombuffer(data, np.uint8)[texts[0]:texts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        texts = texts - texts[0]
        mark = cuts(flat, texts[1:])
        mark[texts[:-1][texts[:-1] < len(flat)]] = True
        first = np.flatnonzero(mark)
        bounds = np.append(first, len(flat)).astype(np.int32)
        every = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))).dictionary_encode()
        place = pc.index_in(every.dictionary, value_set=self.known)
        if place.null_count:
            self.learn(every.dictionary.filter(place.is_null()))
            place = pc.index_in(every.dictionary, value_set=self.known)
        at = np.asarray(place)[np.asarray(every.indices)]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        found = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        of_texts = ends[np.searchsorted(first, texts)].tolist()
        return [found[a:b].tobytes() for a, b in zip(of_texts[:-1], of_texts[1:], strict=True)]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def encoder(path: str) -> TextEncoder:
    if path not in _LOADED:
        _LOADED[path] = TextEncoder(path)
    return _LOADED[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned, of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def token_rows(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text and ``end_id``, as little-endian unsigned integers of two bytes (four for vocabularies
    over 65,536) in a binary column. A null or empty text gives the end id alone; repeated rows are kept."""
    source = text_of(docs, id_column, text=text_column)
    kind = source.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.asarray([end_id], enc.kind).tobytes()
        for batch in batches:
            found = pa.array([x + end for x in enc.encode(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column), found], names=[id_column, "ids"])

    return source.mapInArrow(run, f"`{id_column}` {kind}, ids binary")
