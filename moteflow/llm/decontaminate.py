"""Benchmark decontamination with an FM-index for each shard of the training texts.

Both sides are lower-cased in A-Z and cut into words of letters, digits and non-ASCII characters. A window is ``window``
consecutive words of an item, or the whole item where it has fewer (but not none). Every task cuts its texts into shards
of bounded size. Words that stand in no item can be part of no window: they end a run, as does the end of a text, and
runs shorter than the shortest window are left out, which loses no occurrence. The runs are indexed, all windows are
searched backwards at once, rows are located from sampled suffix positions, and overlapping occurrences merge to spans.

The items are sent out in blocks of at most ``BLOCK_WINDOWS`` windows, and a task holds one block at a time; there may be
any number of blocks. No shuffle is needed: a document's result depends on its own text only.

Null and empty texts have no words and no hits. Repeated rows get the same result each. Items that are null, empty or
without words have no window; items that share an id count once; a null id is listed as ``null``. Columns of the
documents beside ``text`` are carried along untouched; a column of the name ``text_words``, ``text_spans`` or
``text_items`` is replaced by the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from moteflow.llm.common import ALNUM, ALNUM_WORD, Flat, columns_schema, shards, utf8
from moteflow.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_WINDOWS = 200_000
RESULT = "text_words long, text_spans array<struct<first:long,last:long>>, text_items array<string>"
WORD = re.compile(ALNUM_WORD)


class Phrases:
    """A block of windows: right-aligned symbol rows, and the items of each."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        words = sorted({w for key in windows for w in key})
        self.symbol = {w: i + 1 for i, w in enumerate(words)}
        self.lengths = np.array([len(key) for key in windows])
        self.rows = np.zeros((len(windows), int(self.lengths.max())), np.int64)
        for i, key in enumerate(windows):
            self.rows[i, -len(key):] = [self.symbol[w] for w in key]
        self.items = [sorted(x) for x in windows.values()]


def phrase_blocks(spark: SparkSession, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> list[Broadcast]:
    """The windows of all items as broadcast blocks; the driver holds one block at a time."""
    out: list[Broadcast] = []
    found: dict[tuple[bytes, ...], set[str]] = {}

    def close() -> None:
        if found:
            out.append(spark.sparkContext.broadcast(Phrases(found)))
            found.clear()

    for r in items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL").toLocalIterator():
        words = r[1].encode().translate(ALNUM).split()
        name = "null" if r[0] is None else r[0]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(name)
            if len(found) >= block:
                close()
    close()
    return out


def _occurrences(words: list[list[bytes]], flat: Flat, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word position in the shard, window) of every place where a window stands."""
    get = phrases.symbol.get
    symbols = np.fromiter((get(w, 0) for doc in words for w in doc), np.int64, flat.total)
    known = symbols > 0
    begins = known & ~np.concatenate([[False], known[:-1] & (flat.owner[1:] == flat.owner[:-1])])
    begin = np.flatnonzero(begins)
    run = np.cumsum(begins)[known] - 1
    size = np.bincount(run, minlength=len(begin))
    keep = size >= phrases.lengths.min()
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = Flat(size + 1)
    inside = np.arange(runs.total) - runs.starts[runs.owner]
    text = np.where(inside < size[runs.owner], symbols[np.minimum(begin[runs.owner] + inside, flat.total - 1)], 0)
    index = FMIndex(text, len(phrases.symbol))
    which, low, high = index.search(phrases.rows, phrases.lengths)
    hits = Flat(high - low)
    place = index.locate(low[hits.owner] + np.arange(hits.total) - hits.starts[hits.owner])
    return begin[runs.owner[place]] + inside[place], which[hits.owner]


def _kernel(blocks: list[Broadcast], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, "text"):
            texts = utf8(shard["text"])
            words = [[] if t is None else t.translate(ALNUM).split() for t in texts]
            flat = Flat(np.array([len(w) for w in words]))
            cover = np.zeros(flat.total + 1, np.int64)
            items: dict[int, set[str]] = {}
            for block in blocks:
                phrases = block.value
                place, window = _occurrences(words, flat, phrases)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + phrases.lengths[window], -1)
                for pair in np.unique(flat.owner[place] * len(phrases.rows) + window) if len(place) else ():
                    items.setdefault(int(pair) // len(phrases.rows), set()).update(phrases.items[int(pair) % len(phrases.rows)])
                if len(blocks) > 1:  # keep one block in memory
                    del block._value
            hit = np.cumsum(cover)[:-1] > 0
            spans: list[list[dict]] = [[] for _ in words]
            for doc in items:
                a, n = flat.starts[doc], flat.sizes[doc]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a : a + n], [False]]).astype(np.int8)))
                spans[doc] = [{"first": int(s), "last": int(e) - 1} for s, e in edge.reshape(-1, 2)]
            if clean:
                for doc in items:
                    texts[doc] = _without(texts[doc], spans[doc])
                yield shard.set_column(shard.schema.get_field_index("text"), "text", pa.array([None if t is None else t.decode() for t in texts], pa.string()))
                continue
            for name, values in (("text_words", pa.array(flat.sizes, pa.int64())),
                                 ("text_spans", pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))),
                                 ("text_items", pa.array([sorted(items.get(i, ())) for i in range(len(words))], pa.list_(pa.string())))):
                shard = shard.append_column(name, values)
            yield shard.drop_columns(["text"])
    return run


def _without(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(ALNUM))]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]][0]])
        at = places[s["last"]][1]
    return b"".join([*out, text[at:]])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without their text, with the number of words, the merged hit spans (word positions, both ends
    included) and the ids of the items with occurring windows."""
    docs = docs.drop("text_words", "text_spans", "text_items")
    blocks = phrase_blocks(docs.sparkSession, items, window, block)
    return docs.mapInArrow(_kernel(blocks, False), columns_schema(docs.drop("text"), RESULT))


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts; all columns and all rows stay."""
    blocks = phrase_blocks(docs.sparkSession, items, window, block)
    return docs.mapInArrow(_kernel(blocks, True), docs.schema)
