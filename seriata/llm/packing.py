"""Packing: first-fit decreasing over a tournament tree of bin capacities, run independently in randomised groups of documents.

Documents are dealt to partitions by a hash, or by stretches of their order; a partition packs one bounded group after another, so memory doesn't grow
with the input, and a lost partition is packed anew on its own. What first-fit decreasing leaves open is closed by cutting
pieces of the emptiest bins, so that only one sequence of a group stays short.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters.
TOKENIZER = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
#: A group closes when it holds so many ids.
GROUP_IDS = 4 << 20
#: Rows of a consecutive stretch, where the order of the rows counts.
STRETCH = 1024
#: The shortest piece that topping up cuts off.
MIN_PIECE = 16
#: Units that a worker's cache holds before it starts afresh.
CACHE_UNITS = 700_000
_CHUNK = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: Outside these characters the tokenizer's classes of letters, digits and blanks aren't taken for granted.
_OTHER = re.compile(r"[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ¿¡«»“”‘’–—…€]")
#: The tokenizer's own split over those characters, in lower case.
_UNIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

#: What units rest on, as the tokenizer's file states it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordTokenizer:
    """Ids of whole texts by way of a cache of units.

    The tokenizer drops white space, lower-cases, cuts a text into letter runs, digits and symbol runs, and merges inside those alone. So a
    text's ids are those of its units, one after another; a text with other characters than the common Latin ones is
    cut at blanks only, across which nothing is normalised or merged either.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, "rb") as f:
            told = json.load(f)
        #: A tokenizer that splits otherwise gets every text whole.
        self.by_units = (told["normalizer"], told["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, fresh: list[str]) -> None:
        coded = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        ids, at = coded.ids, coded.word_ids
        if at and at[-1] == len(fresh) - 1:  # no unit gives nothing, so each is one of the tokenizer's words
            lengths = np.bincount(np.array(at), minlength=len(fresh))
        else:
            each = [x.ids for x in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
            ids, lengths = [i for x in each for i in x], np.array([len(x) for x in each])
        k = len(self.at)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(fresh) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k : k + len(fresh)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k : k + len(fresh)] = lengths
        self.used += len(ids)
        self.at.update(zip(fresh, range(k, k + len(fresh)), strict=True))

    def encode(self, text: str) -> np.ndarray:
        if not self.by_units:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        units = _CHUNK.findall(text) if _OTHER.search(text) else _UNIT.findall(text.lower())
        if not units:
            return np.zeros(0, np.uint32)
        if len(self.at) > CACHE_UNITS:
            self.clear()
        try:
            index = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        except KeyError:
            self._learn([u for u in dict.fromkeys(units) if u not in self.at])
            index = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[index] - ends + lengths, lengths) + np.arange(ends[-1])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, which must come in descending order: the first bin with room, by a tournament tree whose
    nodes hold the most room below them."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out.append(node - leaves)
        tree[node] -= size
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return out


def pack(lengths: list[int], capacity: int = SEQUENCE, min_piece: int = MIN_PIECE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) that hold every item wholly, each at most ``capacity``."""
    bins, rests = [], []
    for i, n in enumerate(lengths):
        bins += [[(i, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rests.append((i, n - n % capacity, n % capacity))
    rests.sort(key=lambda p: -p[2])
    opened: list[list[tuple[int, int, int]]] = []
    for piece, b in zip(rests, first_fit_decreasing([p[2] for p in rests], capacity), strict=True):
        while len(opened) <= b:
            opened.append([])
        opened[b].append(piece)
    room = {id(b): capacity - sum(p[2] for p in b) for b in opened}
    opened.sort(key=lambda b: room[id(b)])
    lo, hi = 0, len(opened) - 1
    while lo < hi:
        gap, donor = room[id(opened[lo])], opened[hi]
        if gap < min_piece:
            lo += 1
            continue
        item, start, n = donor.pop()
        moved = min(gap, n)
        opened[lo].append((item, start, moved))
        room[id(opened[lo])] -= moved
        if moved < n:
            donor.append((item, start + moved, n - moved))
        room[id(donor)] += moved
        if not donor:
            hi -= 1
    return bins + [b for b in opened if b]


def stretches(docs: DataFrame, rows: int = STRETCH) -> DataFrame:
    """``docs``, as read from Parquet files, with ``stretch``: the number of its run of ``rows`` consecutive rows, by file and place in the file.

    One count for each file comes to the driver. Files are in the order of the number that Spark gave to their part.
    """
    placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {r[0]: r[1] for r in placed.groupBy("_file").count().collect()}
    order = sorted(counts, key=lambda f: (int(m[1]) if (m := re.match(r"part-(\d+)", f)) else -1, f))
    before = list(zip(order, accumulate((counts[f] for f in order), initial=0), strict=False))
    table = docs.sparkSession.createDataFrame(before, "_file string, _before long")
    at = F.floor((F.col("_before") + F.col("_row")) / rows)
    return placed.join(F.broadcast(table), "_file").withColumn("stretch", at).drop("_file", "_row", "_before")


def pack_documents(
    docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = SEQUENCE, group_ids: int = GROUP_IDS, with_ids: bool = False, stretch: str | None = None
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` if asked for).

    A document's ids are its tokens and the end id. Null text counts as empty (the end id alone); repeated rows are packed
    each; extra columns are ignored; an empty table gives no rows. The text is shuffled once, by a hash of id and text, and sorted by it, so
    that a task that is run again packs the same groups.

    With ``stretch``, a column of numbers from 0 on, rows of different stretches never share a group, rows are mixed by that hash inside their
    stretch alone, and sequences are numbered in the order of the stretches.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")

    def pack_groups(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tokens = tokenizer_at(public_tokenizers.path(tokenizer))
        sequence = 0 if stretch else TaskContext.get().partitionId() << 40
        now = None
        names: list = []
        held: list[np.ndarray] = []
        count = 0

        def close():
            nonlocal sequence
            # the rows come in the order of a hash; pieces are listed by id
            order = sorted(range(len(held)), key=lambda k: (names[k] is None, names[k] or 0, len(held[k])))
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for pieces in pack([len(held[k]) for k in order], capacity):
                offset = 0
                for item, start, n in pieces:
                    ids = held[order[item]]
                    part = ids[start : start + n]
                    row = (names[order[item]], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset)
                    for c, v in zip(cols, (*row, part) if with_ids else row, strict=True):
                        c.append(v)
                    offset += n
                sequence += 1
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
            return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for doc_id, text, run in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist() if stretch else repeat(None, len(batch)), strict=True):
                if run != now:
                    if held:
                        yield close()
                        names, held, count = [], [], 0
                    now, sequence = run, run << 32
                ids = np.append(tokens.encode(text.as_py() or ""), np.uint32(END_ID))
                names.append(doc_id)
                held.append(ids)
                count += len(ids)
                if count >= group_ids:
                    yield close()
                    names, held, count = [], [], 0
        if held:
            yield close()

    mix = F.xxhash64("doc_id", F.xxhash64("text"), F.lit("packing"))
    if stretch:
        runs = docs.select("doc_id", "text", F.col(stretch).cast("bigint").alias("stretch"), mix.alias("_mix")).repartition("stretch")
        dealt = runs.sortWithinPartitions("stretch", "_mix").drop("_mix")
    else:
        dealt = docs.select("doc_id", "text", mix.alias("_mix")).repartition("_mix").sortWithinPartitions("_mix").drop("_mix")
    return dealt.mapInArrow(pack_groups, schema)
