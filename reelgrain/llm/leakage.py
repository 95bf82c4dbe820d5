"""Problem 7: evaluation texts that leak into training text.

Method: training suffix arrays. Every task turns its documents into word numbers, shard by shard (about
``SHARD_WORDS`` words), builds the shard's suffix array by prefix doubling and binary-searches every suffix of every
evaluation text in it. A range of the array that shares ``SEED`` words gives all places of a verbatim match; each is
extended to its longest verbatim match, and beyond one changed, dropped or added word. The scan of the documents is
the only pass and nothing of them is shuffled: only hits leave a task.

Exactness: of 24 words with one edit, 12 in a row are untouched (``SEED``), so the search loses nothing. Suffixes that
meet a word no evaluation text has within SEED words cannot match and are left out of the array.

The evaluation side is sent to the tasks in blocks of at most ``EVAL_CHARS`` characters; more text means more scans.

Defined results: null texts and texts without letters or digits match nothing; null ids are left out; repeated items
and documents each give their own rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 24
SEED = 12
MIN_CHARS = 44
CHAR_LANGS = ("zh", "ja")
SHARD_WORDS = 1_000_000
EVAL_CHARS = 16_000_000
PLACES = 4_000_000
HITS = "item_id long, doc_id long, kind string, item_start long, doc_start long, span long, edits int"

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_MARKUP = re.compile("[*`\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")


def words_of(text: str) -> list[str]:
    """Words as the comparison sees them: width forms and case folded, markup, tags and invisible characters gone."""
    return _WORD.findall(unicodedata.normalize("NFKC", _MARKUP.sub("", _TAG.sub("", text))).casefold())


def suffix_order(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of their suffixes, compared to ``depth`` tokens at least."""
    rank = tokens.astype(np.int64)
    n, k = len(rank), 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        _, rank = np.unique(key, return_inverse=True)
        k *= 2
        if int(rank.max(initial=0)) == n - 1:
            break
    return at[np.argsort(rank[at], kind="stable")]


def search(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of ``queries`` (fixed length prefixes) the first place in ``order`` not below (above) it."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    span = np.arange(queries.shape[1])
    open_rows = np.flatnonzero(lo < hi)
    while len(open_rows):
        mid = (lo[open_rows] + hi[open_rows]) // 2
        diff = tokens[order[mid][:, None] + span] - queries[open_rows]
        first = (diff != 0).argmax(axis=1)
        sign = diff[np.arange(len(diff)), first]
        below = sign <= 0 if upper else sign < 0
        lo[open_rows[below]] = mid[below] + 1
        hi[open_rows[~below]] = mid[~below]
        open_rows = open_rows[lo[open_rows] < hi[open_rows]]
    return lo


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Length of the equal stretch of a[i...] and b[j...] going by ``step``; token 0 equals nothing."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    k = 0
    while len(live):
        x, y = i[live] + k * step, j[live] + k * step
        inside = (x >= 0) & (x < len(a)) & (y >= 0) & (y < len(b))
        same = np.zeros(len(live), bool)
        same[inside] = (a[x[inside]] == b[y[inside]]) & (a[x[inside]] > 0)
        live = live[same]
        out[live] += 1
        k += 1
    return out


def matches(test: np.ndarray, text: np.ndarray, seed: int, need: int, edits: int) -> pd.DataFrame:
    """Places where ``text`` holds ``need`` tokens of ``test``, at most ``edits`` (0 or 1) of them edited.

    Both are token numbers from 1; 0 stands for any token that matches nothing, such as an end. One row per maximal
    verbatim match: ``i, j`` where the span starts, ``span`` in tokens of test, ``edits``.
    """
    empty = pd.DataFrame({"i": [], "j": [], "span": [], "edits": []}, dtype=np.int64)
    text = np.append(text, np.zeros(seed, text.dtype))
    test = np.append(test, np.zeros(seed, test.dtype))

    def starts(x: np.ndarray) -> np.ndarray:
        stop = np.flatnonzero(x == 0)
        at = np.arange(len(x))
        return at[stop[np.searchsorted(stop, at)] - at >= seed]

    at, ask = starts(text), starts(test)
    if not len(at) or not len(ask):
        return empty
    longest = int(np.diff(np.append([-1], np.flatnonzero(test == 0))).max())
    order = suffix_order(text, at, max(seed, longest))
    queries = test[ask[:, None] + np.arange(seed)]
    lo, hi = search(text, order, queries, False), search(text, order, queries, True)
    n = hi - lo
    found = []
    # places of a passage that many items share are listed in slices, and of each only where a verbatim match begins
    ends = np.cumsum(n)
    for at in range(0, int(n.sum()), PLACES):
        rank = np.arange(at, min(at + PLACES, int(n.sum())))
        row = np.searchsorted(ends, rank, side="right")
        i = ask[row]
        j = order[lo[row] + rank - (ends[row] - n[row])]
        left = (i > 0) & (j > 0)
        maximal = ~left
        maximal[left] = (test[i[left] - 1] != text[j[left] - 1]) | (test[i[left] - 1] == 0)
        found.append((i[maximal], j[maximal]))
    if not found:
        return empty
    i, j = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return empty
    size = common(test, i, text, j, 1)
    best, start, doc, used = size.copy(), i.copy(), j.copy(), np.zeros(len(i), np.int64)
    if edits:
        for di, dj in ((1, 1), (1, 0), (0, 1)):  # changed, dropped, added
            right = common(test, i + size + di, text, j + size + dj, 1)
            # an edited word at the end counts only where the test has that word
            ends = (test[np.minimum(i + size, len(test) - 1)] > 0).astype(np.int64) * di
            span = size + np.where(right > 0, di + right, ends)
            better = span > best
            best[better], start[better], doc[better], used[better] = span[better], i[better], j[better], 1
            back = common(test, i - 1 - di, text, j - 1 - dj, -1)
            ends = ((i > 0) & (test[np.maximum(i - 1, 0)] > 0)).astype(np.int64) * di
            more = np.where(back > 0, di + back, ends)
            better = size + more > best
            best[better], used[better] = (size + more)[better], 1
            start[better], doc[better] = (i - more)[better], (j - np.where(back > 0, dj + back, 0))[better]
    out = pd.DataFrame({"i": start, "j": doc, "span": best, "edits": used})
    return out[out["span"] >= need]


class _Side:
    """The evaluation texts as numbers: words or characters, with where each item starts."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.numbers: dict[str, int] = {}
        out: list[int] = []
        self.ids, self.starts = [], []
        for item_id, tokens in items:
            self.ids.append(item_id)
            self.starts.append(len(out))
            out += [self.numbers.setdefault(t, len(self.numbers) + 1) for t in tokens] + [0]
        self.tokens = np.array(out, np.int64)

    def hits(self, docs: list[int], numbers: list[np.ndarray], kind: str, seed: int, need: int, edits: int) -> pd.DataFrame:
        text = np.concatenate(numbers)
        first = np.cumsum([0] + [len(x) for x in numbers[:-1]])
        found = matches(self.tokens, text, seed, need, edits)
        item = np.searchsorted(self.starts, found["i"], side="right") - 1
        doc = np.searchsorted(first, found["j"], side="right") - 1
        out = pd.DataFrame({
            "item_id": np.array(self.ids, np.int64)[item], "doc_id": np.array(docs, np.int64)[doc], "kind": kind,
            "item_start": found["i"].to_numpy() - np.array(self.starts, np.int64)[item], "doc_start": found["j"].to_numpy() - first[doc],
            "span": found["span"].to_numpy(), "edits": found["edits"].to_numpy(),
        })
        return out.sort_values("span", ascending=False).drop_duplicates(["item_id", "doc_id"])

    def number(self, tokens: list[str]) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(t, 0) for t in tokens] + [0], np.int64)


def _finder(items: list[tuple[int, str | None, str]], min_words: int, seed: int, min_chars: int, shard_words: int):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = [(i, lang, words_of(text)) for i, lang, text in items]
        by_word = _Side([(i, w) for i, _, w in split])
        joined = [(i, "".join(w)) for i, lang, w in split if (lang or "").strip().lower()[:2] in CHAR_LANGS]
        by_char = _Side([(i, list(w)) for i, w in joined])
        # documents without such a character can be skipped only if no window of the items is without one
        cjk_only = all(_CJK.search(w[k : k + min_chars]) for _, w in joined for k in range(max(0, len(w) - min_chars + 1)))
        held: dict[str, list] = {"words": [], "chars": []}
        size = {"words": 0, "chars": 0}

        def flush(kind: str) -> pd.DataFrame:
            docs, held[kind], size[kind] = held[kind], [], 0
            side, args = (by_word, (seed, min_words, 1)) if kind == "words" else (by_char, (min_chars, min_chars, 0))
            return side.hits([d for d, _ in docs], [n for _, n in docs], kind, *args)

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                words = words_of(text)
                todo = [("words", by_word.number(words))] if len(words) >= seed else []
                if joined and (not cjk_only or _CJK.search(text)):
                    chars = "".join(words)
                    todo += [("chars", by_char.number(list(chars)))] if len(chars) >= min_chars else []
                for kind, numbers in todo:
                    held[kind].append((doc_id, numbers))
                    size[kind] += len(numbers)
                    if size[kind] >= shard_words:
                        yield flush(kind)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    return find


def leaks(items: DataFrame, documents: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``item_id, doc_id, kind, item_start, doc_start, span, edits``: per item and document its longest match.

    ``kind`` is words or chars, the unit of the positions and of ``span`` (counted in the item).
    """
    seed = (min_words - 1 + 1) // 2
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    given = items.where("item_id is not null and text is not null").select("item_id", "lang", "text")
    out = None
    for block in _blocks(given):
        part = docs.mapInPandas(_finder(block, min_words, seed, min_chars, shard_words), HITS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return documents.sparkSession.createDataFrame([], HITS)
    best = F.max_by(F.struct("kind", "item_start", "doc_start", "span", "edits"), F.struct("span", "kind", "item_start", "doc_start"))
    return out.groupBy("item_id", "doc_id").agg(best.alias("m")).select("item_id", "doc_id", "m.*")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None, str]]]:
    """The stated query set, in blocks of bounded size, one on the driver at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["lang"], row["text"]))
        size += len(row["text"])
        if size >= EVAL_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def clean(items: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents`` without those that leak an item. Documents with null ids or texts stay."""
    return documents.join(leaks(items, documents).select("doc_id").distinct(), "doc_id", "left_anti")
