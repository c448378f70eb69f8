"""Packing token sequences by first-fit decreasing over a tournament tree.

Documents are tokenised where they are read. What fills whole sequences is cut off at once; the
rests go, by a hash, to randomised groups of a bounded number of documents, and each group is
packed alone: rests from longest to shortest, each into the first open sequence with room, found
in logarithmic time in a tournament tree over the room that each has. Where the emptiest sequence
of a group fits into the gaps of the others, it is cut up to fill them, and the last one is cut
into parts whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import materialise, read, row_count, small_batches

LENGTH = 2048
END = 1
#: Documents of a group, on average.
GROUP_DOCS = 4096
#: Gaps below this stay as padding; smaller pieces aren't worth a cut.
LEAST_CUT = 16
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=2)
def reference_tokenizer(name: str = VOCABULARY):
    """The public tokenizer as its json file defines it; nothing is set on it."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(f"{name}.json"))


@lru_cache(maxsize=2)
def tokenizer(name: str = VOCABULARY):
    """Text to the ids of `reference_tokenizer(name).encode(text, add_special_tokens=False)`.

    A text that holds one of the file's added tokens is given to that tokenizer. Any other is
    merged from the rank file of the same vocabulary, which gives the same ids (the tests compare
    them) in a quarter of the time; what the rank form refuses goes to the json form as well."""
    import public_tokenizers as P
    import tiktoken

    whole = reference_tokenizer(name)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(t in text for t in added):
            try:
                return fast.encode_ordinary(text)
            except Exception:  # too deep for its regular expressions
                pass
        return whole.encode(text, add_special_tokens=False).ids

    return encode


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_CUT = "n long, crcs array<long>, rest binary"


def tokenised(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n, crcs, rest): ids with the end id, the crc of each whole sequence, and the ids
    after these, two bytes each."""

    @arrow_udf(_CUT)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = tokenizer(vocabulary)
        for texts in batches:
            n, crcs, rests = [], [], []
            for at in range(0, len(texts), 64):
                for text in texts.slice(at, 64).to_pylist():
                    ids = np.array([*encode(text or ""), END], np.uint32)
                    whole = len(ids) // length
                    n.append(len(ids))
                    crcs.append([crc(ids[k * length : (k + 1) * length]) for k in range(whole)])
                    rests.append(ids[whole * length :].astype("<u2").tobytes())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], ["n", "crcs", "rest"])

    return docs.select("doc_id", cut(F.col("text").cast("string")).alias("t")).select("doc_id", "t.*")


class Tournament:
    """The leftmost of many bins with room for a piece; new bins open on the right."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.size = 1
        while self.size < max(bins, 1):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def place(self, piece: int) -> int:
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < piece:
                i += 1
        room[i] -= piece
        found = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in sizes; sizes must come in falling order and be capacity at most."""
    tree = Tournament(len(sizes), capacity)
    bins: list[list[int]] = []
    for k, s in enumerate(sizes):
        b = tree.place(s)
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def pack(sizes: list[int], capacity: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items of the given sizes, longest first."""
    seqs = [[(k, 0, sizes[k]) for k in b] for b in first_fit_decreasing(sizes, capacity)]
    fill = [sum(x[2] for x in s) for s in seqs]
    order = sorted(range(len(seqs)), key=lambda b: (fill[b], b))
    gap = {b: capacity - fill[b] for b in order if capacity - fill[b] >= least_cut}
    free = sum(gap.values())
    gone: set[int] = set()
    for b in order:
        free -= gap.pop(b, 0)
        if fill[b] > free or fill[b] == capacity:
            break
        gone.add(b)
        rest = []
        for item, start, left in sorted(seqs[b], key=lambda x: -x[2]):
            while left and gap:
                to = max(gap, key=lambda g: (gap[g], -g))
                step = min(left, gap[to])
                seqs[to].append((item, start, step))
                fill[to] += step
                gap[to] -= step
                free -= step
                if gap[to] < least_cut:
                    free -= gap.pop(to)
                start, left = start + step, left - step
            if left:  # gaps that became too small to use were counted
                rest.append((item, start, left))
        if rest:
            gone.discard(b)
            seqs[b], fill[b] = rest, sum(x[2] for x in rest)
            break
    out = []
    for b, s in enumerate(seqs):
        if b in gone:
            continue
        if capacity - fill[b] >= 4 * least_cut:
            out += powers_of_two(s)
        else:
            out.append(s)
    return out


def powers_of_two(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a sequence over sequences whose lengths are the powers of two of its length."""
    total = sum(x[2] for x in seq)
    lengths = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, pieces = [], list(reversed(seq))
    for want in lengths:
        one = []
        while want:
            item, start, n = pieces.pop()
            step = min(n, want)
            one.append((item, start, step))
            want -= step
            if n > step:
                pieces.append((item, start + step, n - step))
        out.append(one)
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_group(length: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group_id")[0].as_py()
        rows = list(zip(table.column("doc_id").to_pylist(), table.column("n").to_pylist(), table.column("crcs").to_pylist(), (np.frombuffer(x, "<u2") for x in table.column("rest").to_pylist()), strict=True))
        rows.sort(key=lambda r: (-len(r[3]), r[0] is None, r[0] or 0, r[1], r[2], r[3].tobytes()))
        out: list[tuple] = []
        seq = group << 24
        for doc, n, crcs, _ in rows:
            for k, c in enumerate(crcs):
                out.append((doc, k * length, length, c, n, seq, 0))
                seq += 1
        rests = [r for r in rows if len(r[3])]
        for pieces in pack([len(r[3]) for r in rests], length):
            offset = 0
            for item, start, size in pieces:
                doc, n, crcs, ids = rests[item]
                out.append((doc, len(crcs) * length + start, size, crc(ids[start : start + size]), n, seq, offset))
                offset += size
            seq += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], names)

    return run


def pack_documents(docs: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece of docs(doc_id long, text, ...).

    Nulls: a null text is empty and gives its end id alone; rows with a null doc_id are packed like
    others. An empty text is one id, a very long one fills sequences of its own as far as it goes.
    Repeated rows are packed one by one and dealt to groups one by one, so no number of copies
    fills a group. Ties in size go by id, then by content. An empty table gives none. Other
    columns, whatever their names, are not read.

    The ids are written to the shared folder before they are dealt: a row's group follows from its
    place in that table, so a task that is repeated deals alike, and no text is tokenised twice.
    """
    small_batches(docs.sparkSession)
    t = materialise(tokenised(docs, length, vocabulary), "tokens")
    groups = max(1, -(-row_count(t) // group_docs))
    t = t.select(F.pmod(F.xxhash64("doc_id", "n", F.crc32("rest"), F.monotonically_increasing_id()), F.lit(groups)).alias("group_id"), "doc_id", "n", "crcs", "rest")
    return t.groupBy("group_id").applyInArrow(_pack_group(length), _PIECES)


def op4_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table in pieces; see pack_documents for nulls, repeats and long texts."""
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
