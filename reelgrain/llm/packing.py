"""Problem 6: documents of varying length in containers of fixed capacity, with little room left over.

Method: lexical retrieval packing. Documents are cut into pieces only where longer than the capacity. Pieces are
sorted by a min-hash of their words and cut into shards of ``SHARD`` pieces, each with its own BM25 inverted index
(document frequencies and mean length are those of all documents). In a shard the longest unused piece seeds a
container, the index returns its unused neighbours, and they fill the container greedily by score; the piece that
closes a container is the longest that fits. Containers filled below ``RETRY`` are taken apart and packed once more
together, over all shards, as a shard's last containers find few pieces left.

Tokens: runs of word characters (letters, marks, digits, underscore) and runs of other characters but white space.

Defined results: null and blank texts have no tokens and no container; null ids are left out; a repeated row is
packed as often as it occurs, each time on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrain.llm.graphs import join_unique
from reelgrain.sources.scratch import Scratch

CAPACITY = 2048
SHARD = 2000
RETRY = 0.985
K1, B = 1.2, 0.75
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+")
_WORDY = regex.compile(r"[\p{L}\p{M}\p{N}_]")
PIECE = "doc_id long, piece int, start_token int, n_tokens int, terms array<int>, tf array<int>, sig int"
PACKED = "shard long, container int, uid long, doc_id long, piece int, start_token int, n_tokens int, filled int"


def tokens_of(text: str) -> list[str]:
    """Tokens of the WordPunct tokenizer."""
    return TOKEN.findall(text)


def _pieces(capacity: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                tokens = tokens_of(text)
                for piece, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at : at + capacity]
                    counts: Counter[int] = Counter()
                    for word, n in Counter(part).items():
                        number = known.get(word)
                        if number is None:
                            # punctuation is no term; a term is its CRC as a signed integer
                            number = (zlib.crc32(word.casefold().encode("utf-8", "surrogatepass")) - (1 << 31)) if _WORDY.match(word) else -(1 << 40)
                            if len(known) < 1_000_000:
                                known[word] = number
                        if number > -(1 << 40):
                            counts[number] += n
                    terms = np.fromiter(counts.keys(), np.int64, len(counts))
                    sig = int(((terms * 2654435761) & 0xFFFFFFFF).min() >> 1) if len(terms) else 0
                    rows.append((doc_id, piece, at, len(part), terms.astype(np.int32), np.fromiter(counts.values(), np.int32, len(counts)), sig))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_token", "n_tokens", "terms", "tf", "sig"])

    return cut


def fill(lengths: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of row numbers) for pieces of ``lengths``; ``row, term, weight`` are the index's postings."""
    n = len(lengths)
    by_term, by_row = np.argsort(term, kind="stable"), np.argsort(row, kind="stable")
    t_row, t_weight = row[by_term], weight[by_term]
    starts = np.append(np.flatnonzero(np.append([True], np.diff(term[by_term]) != 0)), len(term)) if len(term) else np.zeros(1, int)
    slot = np.zeros(len(term), np.int64)
    if len(term):
        slot[by_term] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    r_slot = slot[by_row]
    r_at = np.searchsorted(row[by_row], np.arange(n + 1))
    unused = np.ones(n, bool)
    out = []
    for seed in np.argsort(-lengths, kind="stable"):
        if not unused[seed]:
            continue
        unused[seed] = False
        box, room = [int(seed)], capacity - int(lengths[seed])
        at = np.flatnonzero(unused & (lengths <= room))
        if len(at):
            scores = np.zeros(n)
            mine = r_slot[r_at[seed] : r_at[seed + 1]]
            if len(mine):
                # all postings of the seed's terms, end to end
                lo, size = starts[mine], starts[mine + 1] - starts[mine]
                reach = np.repeat(lo - np.append([0], np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                scores = np.bincount(t_row[reach], t_weight[reach], n)
            score, length = scores[at], lengths[at]
            shortest = int(length.min())
            while len(at):
                best = int(score.argmax())
                if room - length[best] < shortest:  # it closes the container: leave as little room as possible
                    longest = length == length.max()
                    best = int(np.where(longest, score, -1.0).argmax())
                box.append(int(at[best]))
                room -= int(length[best])
                unused[at[best]] = False
                keep = length <= room
                keep[best] = False
                at, score, length = at[keep], score[keep], length[keep]
        out.append(box)
    return out


def _packer(capacity: int, n_all: int, mean: float):
    def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["n_tokens", "doc_id", "piece", "uid"], ascending=[False, True, True, True], ignore_index=True)
        lengths = left["n_tokens"].to_numpy(np.int64)
        counts = np.array([len(t) for t in left["terms"]], np.int64)
        row = np.repeat(np.arange(len(left)), counts)
        term = np.concatenate([np.asarray(t, np.int64) for t in left["terms"]]) if counts.sum() else np.zeros(0, np.int64)
        tf = np.concatenate([np.asarray(t, float) for t in left["tf"]]) if counts.sum() else np.zeros(0)
        order = np.argsort(right["term"].to_numpy(np.int64))
        known, df = right["term"].to_numpy(np.int64)[order], right["df"].to_numpy(float)[order]
        n_in = df[np.searchsorted(known, term)] if len(term) else np.zeros(0)
        idf = np.log1p((n_all - n_in + 0.5) / (n_in + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(mean, 1.0)))
        boxes = fill(lengths, row, term, weight, capacity)
        box = np.zeros(len(left), np.int64)
        for k, members in enumerate(boxes):
            box[members] = k
        out = left[["shard", "uid", "doc_id", "piece", "start_token", "n_tokens"]].copy()
        out["container"], out["filled"] = box, np.bincount(box, lengths)[box].astype(np.int64)
        return out[["shard", "container", "uid", "doc_id", "piece", "start_token", "n_tokens", "filled"]]

    return pack


def _round(scratch: Scratch, pieces: DataFrame, df: DataFrame | None, n_all: int, mean: float, capacity: int, shard: int, want: int) -> tuple[DataFrame, DataFrame]:
    """Shard, index and pack ``pieces`` in at least ``want`` shards; returns the packed rows and the document frequencies."""
    parts = max(1, min(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), want))
    placed = pieces.repartitionByRange(parts, "sig", "uid").sortWithinPartitions("sig", "uid")
    row = F.monotonically_increasing_id()
    number = F.shiftright(row, 33) * (1 << 24) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / shard)
    sharded = scratch.write(placed.withColumn("shard", number.cast("long")))
    terms = sharded.select("shard", F.explode("terms").alias("term")).groupBy("shard", "term").agg(F.count(F.lit(1)).alias("c"))
    if df is None:
        terms = scratch.write(terms)
        df = scratch.write(terms.groupBy("term").agg(F.sum("c").alias("df"), F.count(F.lit(1)).alias("n")))
    total = max(1, n_all)
    known = join_unique(terms.select("shard", "term"), df, "term", "n", total).select(F.col("shard").alias("of"), "term", "df")
    packed = sharded.groupBy("shard").cogroup(known.groupBy("of")).applyInPandas(_packer(capacity, n_all, mean), PACKED)
    packed = scratch.write(packed)
    scratch.drop(sharded)
    return packed, df


def pack(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, retry: float = RETRY) -> DataFrame:
    """``container, doc_id, piece, start_token, n_tokens, filled``: every token of every document in one container.

    ``container`` is unique; ``filled`` is the number of tokens in it. A document of at most ``capacity`` tokens has
    one piece.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    # each piece has a number of its own, so that repeated rows stay apart; it is fixed by being written
    pieces = scratch.write(docs.mapInPandas(_pieces(capacity), PIECE).withColumn("uid", F.monotonically_increasing_id()))
    n_all, mean = pieces.agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
    full = pieces.where(F.col("n_tokens") == capacity)
    name = lambda kind: F.concat_ws("-", F.lit(kind), "shard", "container")
    alone = full.select(F.concat_ws("-", F.lit("full"), "uid").alias("container"), "doc_id", "piece", "start_token", "n_tokens", F.col("n_tokens").alias("filled"))
    first, df = _round(scratch, pieces.where(F.col("n_tokens") < capacity), None, n_all, mean or 0.0, capacity, shard, 4 * n_all // shard)
    good = first.where(F.col("filled") >= retry * capacity)
    poor = first.where(F.col("filled") < retry * capacity).select("uid")
    again = pieces.join(poor, "uid", "left_semi")
    second, _ = _round(scratch, again, df, n_all, mean or 0.0, capacity, shard, -(-poor.count() // shard))
    shape = ["container", "doc_id", "piece", "start_token", "n_tokens", "filled"]
    return alone.unionByName(good.withColumn("container", name("a")).select(*shape)).unionByName(second.withColumn("container", name("b")).select(*shape))


def cut_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id`` of the documents that had to be cut, as they were packed."""
    return pack(documents, capacity).where("piece > 0").select("doc_id").distinct()
