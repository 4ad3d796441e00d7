"""Best-fit packing of documents into token sequences of one length.

Texts are cut into pieces only where they are longer than a sequence. Pieces are placed by bounded-space online best-fit:
each packer keeps a fixed number of bins open, finds the tightest bin by a bitset keyed by free space, and closes the
fullest bin when it needs room for another. Packers run side by side on hash parts of the pieces. The bins that are still
open when a packer ends become items themselves and are packed again, in fewer parts each time, so that the number of
packers hardly adds sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..runtime import durable

SEQUENCE = 4_096
OPEN_BINS = 512
PART_ITEMS = 50_000  # items of one packer, about
CACHE_SIZE = 300_000
LONG_WORD = 64
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, but not to the tokenizer

# The normalizers and the split of the word tokenizer file, and the same split of lower-case PLAIN texts.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xff]*")
PLAIN_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    r"|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


class WordIds(dict):
    """Word -> its token ids as little-endian 32-bit bytes; bounded, filled on demand.

    The tokenizer drops white space before it splits, so no token spans two words. Where its file has the split above,
    plain texts without special strings are cut into pre-tokens, whose variety is far smaller than that of words with their
    punctuation, and those of a text that are not known yet are encoded in one call. All others are read word by word.
    """

    def __init__(self, file: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as source:
            told = json.load(source)
        steps = [step["type"] for step in (told["normalizer"] or {}).get("normalizers", ())]
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", ())
        pattern = splits[0].get("pattern", {}).get("Regex") if splits else None
        self.splits = steps == NORMALIZERS and pattern == WORD_SPLIT and told["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.encoded(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = ids
        return ids

    def learn(self, words: list[str]) -> None:
        """Encodes pre-tokens together; a result that does not fall into one part for each is left to the single look-up."""
        new = [w for w in dict.fromkeys(words) if w not in self and len(w) <= LONG_WORD]
        if len(self) + len(new) > CACHE_SIZE:
            self.clear()
            new = [w for w in dict.fromkeys(words) if len(w) <= LONG_WORD]
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(new) and stops[-1] == len(ids):
                whole, at = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.update((w, whole[a:b]) for w, a, b in zip(new, at, at[1:]))

    def text(self, text: str) -> bytes:
        if self.splits and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            words = PLAIN_SPLIT.findall(text.lower())
            self.learn(words)
        elif ODD_SPACE.search(text):
            return self.encoded(text)
        else:
            words = text.split()
        return b"".join(map(self.__getitem__, words))


@cache
def word_ids(file: str) -> WordIds:
    """One for each Python worker, whose tasks share it."""
    return WordIds(file)


def token_pieces(docs: DataFrame, file: str, end_id: int = 1, length: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Every document ends with ``end_id``.

    ``file`` is a tokenizer that drops white space. A null or empty text is the end id alone.
    """
    end = end_id.to_bytes(4, "little")
    size = 4 * length

    def cut(batches):
        words = word_ids(file)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).to_pylist()):
                whole = memoryview(words.text(text or "") + end)
                for piece, at in enumerate(range(0, len(whole), size)):
                    part = whole[at : at + size]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Bounded-space online best-fit: ``open_bins`` bins, found by free space through a bitset."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.free = 0  # bit f is set while a bin with f free places is open
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes the next item, and the item's place in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.size, self.made
            self.made += 1
        rest = space - length
        if rest:
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        left = self.bins[space]
        number = left.pop()
        if not left:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def still_open(self) -> dict[int, int]:
        """Bin -> places used."""
        return {number: self.size - space for space, numbers in self.bins.items() for number in numbers}


def _packed(items: DataFrame, parts: int, size: int, open_bins: int) -> DataFrame:
    """(item, length) -> item, part, bin, place, open_used: the bin's fill if the packer ended with it open, else null."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["draw", "item"])  # large and small mixed, the same order on every run
        packer = BestFit(size, open_bins)
        placed = [packer.place(n) for n in frame["length"].tolist()]
        frame = frame[["item", "part"]].assign(bin=[b for b, _ in placed], place=[p for _, p in placed])
        return frame.assign(open_used=frame["bin"].map(packer.still_open()).astype("Int64"))

    draw = F.xxhash64("item")
    dealt = items.select("item", "length", draw.alias("draw"), F.pmod(draw, F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "item long, part int, bin long, place long, open_used long")


def pack_pieces(pieces: DataFrame, length: int = SEQUENCE, open_bins: int = OPEN_BINS, part_items: int = PART_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, length.

    Pieces that fill a sequence get one without packing. Rounds of packing end when one packer took all that was open;
    each round leaves at most ``open_bins`` bins per ``part_items`` items, so the rounds shrink by a fixed factor.
    """
    pieces = durable(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    short, none = F.col("length") < length, F.lit(0).cast("long")
    closed = pieces.where(~short).select("item", none.alias("offset"), (-1 - F.col("item")).alias("sequence_id"))
    items = pieces.where(short).select("item", "length")
    # holder: the item that stands for a piece in this round; shift: the piece's place inside the holder
    held = items.select("item", F.col("item").alias("holder"), none.alias("shift"))
    left, level = items.count(), 0
    while True:
        parts = max(1, -(-left // part_items))
        packed = durable(_packed(items, parts, length, open_bins), "bins")
        bin_id = F.col("part").cast("long") * F.lit(1 << 32) + F.col("bin")
        placed = held.join(packed.withColumnRenamed("item", "holder"), "holder").select(
            "item", (F.col("shift") + F.col("place")).alias("offset"), bin_id.alias("holder"), "open_used"
        )
        ends = placed if parts == 1 else placed.where("open_used IS NULL")
        closed = closed.unionByName(ends.select("item", "offset", (F.col("holder") + F.lit(level << 59)).alias("sequence_id")))
        if parts == 1:
            return pieces.join(closed, "item").drop("item")
        held = durable(placed.where("open_used IS NOT NULL").select("item", "holder", F.col("offset").alias("shift")), "held")
        items = packed.where("open_used IS NOT NULL").groupBy(bin_id.alias("item")).agg(F.max("open_used").alias("length"))
        left, level = parts * open_bins, level + 1


def pack_documents(docs: DataFrame, file: str, end_id: int = 1, length: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece. A null text counts as empty
    and still takes its end id; repeated rows and null ids are packed each on its own; ties are settled by row number;
    other columns are ignored; an empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack_pieces(token_pieces(docs, file, end_id, length), length, open_bins).select(*columns)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, pieces (offset, doc_id, piece, length) in order."""
    part = F.struct("offset", "doc_id", "piece", "length")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("pieces"))
