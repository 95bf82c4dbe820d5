"""Problem 8: sentences of every document, whatever its language, script and type.

Method: rules compiled into finite transducers. A mark is read with three small alphabets: the class of what stands
before it (abbreviation, initial, ordinal, ...), the kind of mark, and the class of what follows (digit, upper case,
a word that carries on, ...); the rules are compiled once into the table ``STOPS`` over these classes, which says
whether a sentence may end there, and the answer is the event the transducer reads. Its state is the kind of the open
quote, the depth of open brackets and whether the line is a heading or list item; an end mark ends a sentence only where
no quote or bracket is open. Whether an opening mark is ever closed in its paragraph is found by a second, right-to-left
transducer whose state is the set of closers ahead; an opening mark without one is ignored.

Texts longer than ``CHUNK`` are cut into chunks in one pass, always between a letter and a character that goes on with no
word or file name: no event spans such a border and no class looks across it but for the few characters a chunk is given
with it, so chunks give exactly the events of the whole text. A chunk is summed up as the state-transition function of its
events, and the functions are composed by a prefix scan (once from the right, once from the left) over one small row a
chunk; only then are the chunks' sentences put out. A long document is so spread over many tasks, at a cost that grows
with its length.

Defined results: null and blank texts (white space, byte order marks) give no row; null ids are left out; a null
``doc_type`` counts as prose; a heading or list mark without text gives no row; repeated rows give their rows once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgrain.sources.scratch import Scratch

CHUNK = 16_384
LINES = "job_log"

# Abbreviations after which a sentence goes on, whatever follows (lower case, without the last stop).
NEVER = frozenset("mr mrs ms dr prof st mt fig figs sect sec vol ch eq vs ca cf e.g i.e approx dept jr sr resp al nos "
                  "nr abb vgl bzw z.b d.h u.a z evtl ggf inkl str tab "
                  "env p.ex c.-à-d mme mm mlle ex "
                  "sra dra ej núm num pág pag aprox ee "
                  "डॉ".split())  # fmt: skip
# Those after which it goes on before a lower-case letter only.
OFTEN = frozenset("a.m u.k u.s u.n uu ee.uu inc ltd co no".split())
# Those that end it unless a word of GOES_ON follows.
MOSTLY = frozenset("p.m etc usw ff".split())
# Words that carry on the sentence after a closed quote or one of MOSTLY.
GOES_ON = frozenset("and or but asked said says reads wrote replied added are is was were on in at und oder aber stand stehen sagte et ou mais dit y o pero dice dijo और तथा".split())
ORDINAL = frozenset("die der das dem den des am im vom zum zur bis ab seit beim und".split())

_END = ".!?…。！？．｡।॥؟۔‽"
_CLOSE = "\"”’»“)]}）】」』›"
KINDS = 5  # straight, curly, low-high, guillemets, corner
# Events. Openers and closers have one number per kind; FINAL means a sentence may end after them.
(NL, BLANK, ITEM, END, B_OPEN, B_CLOSE, B_FINAL, QUOTE) = range(8)  # QUOTE + 3 * kind + (0 open, 1 close, 2 close final)
SWITCH = QUOTE + 3 * KINDS  # “ opens, or closes a low quote; SWITCH + 1 is the closing one that is final
N_EVENTS = SWITCH + 2
N_STATES = (KINDS + 1) * 3 * 2

_OPENERS = {"„": 2, "«": 3, "‹": 3, "「": 4, "『": 4}
_CLOSERS = {"”": 1, "»": 3, "›": 3, "」": 4, "』": 4}
_EVENT = re.compile(
    rf"[\r\n\v\f\x1c-\x1e\x85\u2028\u2029][\s\ufeff]*|(?<=[฀-๿])[\s\ufeff]+(?=[฀-๿])|[{_END}]+(?:[ \u00a0\u202f\r\n]{{0,3}}[»›]|[{re.escape(_CLOSE)}])*|[\"“”„«»‹›「」『』()\[\]（）【】]"
)
_BREAKS = re.compile(r"\r\n|[\r\n\v\f\x1c-\x1e\x85\u2028\u2029]")
_LINE = re.compile(r"[\r\n\v\f\x1c-\x1e\x85\u2028\u2029][\s\ufeff]*")
_MARK = re.compile(r"(?:#{1,6}|[-*+•–]|(\d{1,3})[.)])(?:[ \t\u00a0]+|$)")
_SPACE = re.compile(r"[\s\ufeff]*")
_FILE = re.compile(r"\w+(?:[.-]\w+)*\.(?:py|json|md|txt|ply|png|jpe?g|csv|ya?ml|log|sh|mp4|out)(?![A-Za-z0-9_])|\w+_\w|[a-z]+[A-Z]")
_WORD = re.compile(r"[^\W\d_]+")
# A border: after a letter, before a character with which no word, file name or mark goes on.
_BORDER = re.compile(r"(?<=[^\W\d_])(?=[^\w.\-])")
_LEAD = "([{«\"“„*_`"  # may stand before an abbreviation
_APART = frozenset("\"“”„«»‹›「」『』()[]（）【】\ufeff")  # end a token, as white space does
_LONGEST = max(len(w) for w in NEVER | OFTEN | MOSTLY) + 1

# What stands before a full stop; CAPITAL variants end in a capital letter or sign.
(PLAIN, EMPTY, GOES_NEVER, INITIAL, NUMBER, GOES_OFTEN, GOES_MOSTLY, HOUR, DAY, COUNT) = range(10)
CAPITAL = 10
# The mark: one full stop, an ellipsis, another mark; each without and with a closer behind it.
STOP, DOTS, OTHER = range(3)
# What follows: glued to a full stop, or after white space; FILE variants begin a file name.
(TIGHT_LOW, TIGHT, NOTHING, DIGIT, COMMA, CLOSER, OPENER, UPPER, CARRIER, LOWER, LETTER, SIGN) = range(12)
FILE = 12


def _rule(before: int, mark: int, closed: bool, after: int, lower: bool) -> bool:
    """Whether a sentence may end at a mark, from the classes around it; ``lower``: the text has no upper case."""
    file, after = after >= FILE, after % FILE
    capital, before = before >= CAPITAL, before % CAPITAL
    if after == NOTHING:
        return True
    low_word = after in (CARRIER, LOWER) and not file
    if mark == STOP:
        if after == TIGHT_LOW:
            return False
        if after == TIGHT:
            return not capital and before not in (GOES_NEVER, EMPTY)
        if before in (GOES_NEVER, INITIAL) or (before == DAY and after in (UPPER, CARRIER, LOWER, LETTER)):
            return False
        if before in (NUMBER, COUNT):
            return after != DIGIT
        if before in (GOES_OFTEN, GOES_MOSTLY, HOUR) and after == COMMA:
            return False
        if before == GOES_OFTEN:
            return not low_word
        if before in (GOES_MOSTLY, HOUR):  # in a text without case, what follows tells nothing
            return not low_word or lower or not (after == CARRIER or (before == HOUR and not lower))
    if mark == DOTS and not closed:
        return file or after in (UPPER, OPENER)
    if closed:
        goes_on = after in (COMMA, CLOSER, DIGIT) or (not file and (after in (CARRIER, LETTER) or (after == LOWER and not lower)))
        return not goes_on
    return True


# The rules, compiled: STOPS[lower][closed][mark][before][after].
STOPS = [[[[[_rule(b, m, c, a, low) for a in range(2 * FILE)] for b in range(2 * CAPITAL)] for m in range(3)] for c in (False, True)] for low in (False, True)]


def _back(text: str, at: int) -> int:
    """Where what a rule may read before ``at`` begins: the token, or its last characters and all lead marks before."""
    k = at
    while k > 0:
        c = text[k - 1]
        if c.isspace() or c in _APART or (at - k > _LONGEST and c not in _LEAD):
            break
        k -= 1
    return k


def _before(text: str, at: int, begun: int) -> int:
    """Class of what stands before the full stop at ``at``; the sentence began at ``begun`` or earlier."""
    k = max(_back(text, at), begun)
    token = text[k:at]
    if (not token or token[-1].isdigit()) and _counts(text, at):
        return COUNT
    if not token:
        return EMPTY
    c = token[-1]
    capital = 0 if c.islower() or c.isdigit() or not c.isascii() else CAPITAL
    whole = k in (0, begun) or text[k - 1].isspace() or text[k - 1] in _APART
    low = token.lower()
    if whole:
        low = low.lstrip(_LEAD)
        if low in NEVER:
            return GOES_NEVER + capital
        if low == "no":
            return NUMBER + capital
        if low in OFTEN:
            return GOES_OFTEN + capital
        if low in MOSTLY:
            return (HOUR if low == "p.m" else GOES_MOSTLY) + capital
        if len(low) == 1 and low.isalpha():
            return INITIAL + capital
        if len(token) <= 2 and token.isdigit() and _day(text, k):
            return DAY
    if len(low) > 1 and low[-2] in ".-" and low[-1].isalpha():
        return INITIAL + capital
    return PLAIN + capital


def _counts(text: str, at: int) -> bool:
    """Whether a number directly behind a Chinese or Japanese letter ends at ``at``, white space aside: such texts may be
    spaced out anywhere."""
    k, digits = at, 0
    while k > 0 and (text[k - 1].isspace() or text[k - 1].isdigit()):
        k -= 1
        digits += text[k].isdigit()
    return digits > 0 and k > 0 and "぀" <= text[k - 1] <= "鿿"


def _day(text: str, at: int) -> bool:
    """Whether a word of ORDINAL and white space stand before ``at``."""
    k = at
    while k > 0 and text[k - 1].isspace():
        k -= 1
    word = k
    while word > 0 and k - word < 4 and (text[word - 1].isalnum() or text[word - 1] == "_"):
        word -= 1
    return word < k < at and text[word:k].lower() in ORDINAL


def _after(text: str, at: int) -> int:
    """Class of what stands at ``at``, which is no white space."""
    c = text[at]
    if c.isdigit():
        base = DIGIT
    elif c in ",;:)":
        return COMMA
    elif c in "]}،，、；：":
        return CLOSER
    elif c in "\"“„«¿¡「":
        return OPENER
    elif not c.isalpha():
        base = SIGN
        if c != "_":
            return SIGN
    elif c.isupper():
        return UPPER
    elif not c.islower():
        base = LETTER
    else:
        base = CARRIER if _WORD.match(text, at).group() in GOES_ON else LOWER
    return base + FILE if _FILE.match(text, at) else base


def _stops(text: str, start: int, stop: int, end: int, lower: bool, begun: int) -> bool:
    """Whether the marks text[start:stop], with closers to ``end``, may end a sentence that began at ``begun`` or earlier."""
    marks = text[start:stop]
    mark = STOP if marks == "." else DOTS if set(marks) <= {".", "…"} else OTHER
    at = _SPACE.match(text, end).end()
    if at >= len(text) or (at > end and len(_BREAKS.findall(text, end, at)) > 1):
        return True
    if mark == STOP and end == stop and at == end and (text[end].isalnum() or text[end] in "_-"):
        c = text[end]
        after = TIGHT_LOW if not c.isupper() and (c.islower() or c.isdigit() or c in "_-") else TIGHT
    else:
        after = _after(text, at)
    return STOPS[lower][end > stop][mark][_before(text, start, begun) if mark == STOP else PLAIN][after]


def _marked(text: str, at: int) -> bool:
    """Whether a line whose text begins at ``at`` is a heading or list item, or looks like one."""
    return _MARK.match(text, at) is not None


def cut(text: str, size: int) -> list[tuple[int, int, bool]]:
    """``(start, stop, marked)`` of chunks of at least ``size`` characters (but the last); ``marked``: see ``events``."""
    out, at, marked = [], 0, _marked(text, _SPACE.match(text).end())
    while True:
        m = _BORDER.search(text, at + size)
        stop = m.start() if m else len(text)
        out.append((at, stop, marked))
        if m is None:
            return out
        line = None
        for line in _LINE.finditer(text, at, stop):
            pass
        if line is not None:
            marked = _marked(text, line.end())
        at = stop


def window(text: str, start: int, stop: int) -> tuple[int, str]:
    """``(base, piece)``: the chunk text[start:stop] with what the rules may read before it and the character behind it."""
    base = min(_back(text, start), max(0, start - _LONGEST))
    return base, text[base : stop + 1]


def events(text: str, lines: bool, lower: bool, start: int = 0, stop: int | None = None, marked: bool = False) -> list[tuple[int, int, int]]:
    """``(symbol, end, next)`` of the events that begin in text[start:stop].

    ``end`` is where a sentence ending here ends, ``next`` where the following one begins. The text's own start and end
    are BLANK or ITEM events. ``start`` and ``stop`` are 0, the length or borders as of ``cut``; ``marked`` says whether
    the line ``start`` lies in begins like a heading or list item.
    """
    size = len(text)
    stop = size if stop is None else stop
    out = []

    def begin(free: bool, end: int, at: int, symbol: int) -> None:
        """A line's text begins; a number is a list mark only after a blank line, an item or a finished sentence."""
        nonlocal marked
        mark = None if lines else _MARK.match(text, at)
        item = mark is not None and (mark.group(1) is None or free or marked or text[end - 1] in _END + ":：" or text[end - 1] in _CLOSE)
        marked = mark is not None
        if item:
            out.append((ITEM, end, _SPACE.match(text, mark.end()).end() if mark.end() < size else size))
        else:
            out.append((symbol, end, at))

    begun = start - 1  # the end of the last mark that may end a sentence
    if start == 0:
        begin(True, 0, _SPACE.match(text).end(), BLANK)
    for m in _EVENT.finditer(text, start):
        a, b = m.span()
        if a >= stop:
            break
        c = text[a]
        if c.isspace():
            end = a
            while end > 0 and (text[end - 1].isspace() or text[end - 1] == "\ufeff"):
                end -= 1
            breaks = len(_BREAKS.findall(text, a, b))
            if b >= size or lines and breaks or breaks > 1:
                begin(True, end, b, BLANK)
            elif not breaks:
                if not lines:
                    out.append((END, end, b))
            else:
                thai = end > 0 and "฀" <= text[end - 1] <= "๿" and b < size and "฀" <= text[b] <= "๿"
                begin(False, end, b, END if thai else NL)
                if thai and out[-1][0] == END:  # also the end of a heading or list item
                    out.append((NL, end, b))
            continue
        if lines:
            continue
        if c in _END:
            k = a
            while k < b and text[k] in _END:
                k += 1
            final = _stops(text, a, k, b, lower, begun)
            begun = b if final else begun
            if k == b:
                if final:
                    out.append((END, b, _SPACE.match(text, b).end()))
                continue
            closers = [i for i in range(k, b) if not text[i].isspace()]
            marked = marked and closers[0] + len(closers) == b and _BREAKS.search(text, k, b) is None
            for i in closers:
                _quote(out, text, i, final and i == closers[-1], True)
        else:
            _quote(out, text, a, False, False)
    if stop >= size:
        end = size
        while end > 0 and (text[end - 1].isspace() or text[end - 1] == "\ufeff"):
            end -= 1
        out.append((BLANK, end, size))
    return out


def _quote(out: list, text: str, i: int, final: bool, after_end: bool) -> None:
    c = text[i]
    nxt = _SPACE.match(text, i + 1).end() if final else i + 1
    if c in "([（【{":
        out.append((B_OPEN, i, i))
    elif c in ")]）】}":
        out.append((B_FINAL if final else B_CLOSE, i + 1, nxt))
    elif c == "“":
        out.append((SWITCH + final, i + 1, nxt))
    elif c in _OPENERS:
        out.append((QUOTE + 3 * _OPENERS[c], i, i))
    elif c in _CLOSERS:
        out.append((QUOTE + 3 * _CLOSERS[c] + 1 + final, i + 1, nxt))
    elif c == '"':
        before = text[i - 1] if i else " "
        opens = not after_end and (before.isspace() or before in "([（{\ufeff¿¡")
        out.append((QUOTE if opens else QUOTE + 1 + final, i + 1, nxt))
    elif final:  # ’ after an end mark
        out.append((END, i + 1, nxt))


def _state(kind: int, depth: int, item: int) -> int:
    return (kind * 3 + depth) * 2 + item


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``move[matched, symbol, state]`` and ``ends[matched, symbol, state]`` of the left-to-right transducer."""
    move = np.tile(np.arange(N_STATES), (2, N_EVENTS, 1))
    ends = np.zeros((2, N_EVENTS, N_STATES), bool)
    for matched in (0, 1):
        for kind in range(KINDS + 1):
            for depth in range(3):
                for item in (0, 1):
                    s = _state(kind, depth, item)
                    free = kind == 0 and depth == 0 and not item

                    def go(symbol: int, to: int, end: bool) -> None:
                        move[matched, symbol, s], ends[matched, symbol, s] = to, end

                    go(NL, 0 if item else s, bool(item))
                    go(BLANK, 0, True)
                    go(ITEM, 1, True)
                    go(END, s, free)
                    go(B_OPEN, _state(kind, min(depth + matched, 2), item), False)
                    lower = _state(kind, max(depth - 1, 0), item)
                    go(B_CLOSE, lower, False)
                    go(B_FINAL, lower, kind == 0 and depth <= 1 and not item)
                    for q in range(KINDS):
                        opened = _state(q + 1, depth, item) if kind == 0 and matched else s
                        closed = _state(0, depth, item) if kind == q + 1 else s
                        go(QUOTE + 3 * q, opened, False)
                        go(QUOTE + 3 * q + 1, closed, False)
                        go(QUOTE + 3 * q + 2, closed, kind in (0, q + 1) and depth == 0 and not item)
                    if kind == 3:  # a low quote is open
                        go(SWITCH, _state(0, depth, item), False)
                        go(SWITCH + 1, _state(0, depth, item), depth == 0 and not item)
                    else:
                        go(SWITCH, _state(2, depth, item) if kind == 0 and matched else s, False)
                        go(SWITCH + 1, s, free)
    return move, ends


MOVE, ENDS = _tables()
_MOVE, _ENDS = MOVE.tolist(), ENDS.tolist()

# The right-to-left transducer: one bit per closer still ahead in the paragraph.
_BRACKET_BIT = 1 << KINDS
_SETS = [0] * N_EVENTS
_NEEDS = [0] * N_EVENTS
for _q in range(KINDS):
    _SETS[QUOTE + 3 * _q + 1] = _SETS[QUOTE + 3 * _q + 2] = 1 << _q
    _NEEDS[QUOTE + 3 * _q] = 1 << _q
_SETS[B_CLOSE] = _SETS[B_FINAL] = _BRACKET_BIT
_NEEDS[B_OPEN] = _BRACKET_BIT
_SETS[SWITCH] = _SETS[SWITCH + 1] = 1 << 2
_NEEDS[SWITCH] = 1 << 1
_RESETS = [s in (BLANK, ITEM) for s in range(N_EVENTS)]
ALL_BITS = (1 << (KINDS + 1)) - 1


def right_function(symbols: list[int]) -> tuple[int, int]:
    """A chunk as a function of the bits coming from its right: ``bits & keep | set``."""
    keep, put = ALL_BITS, 0
    for s in reversed(symbols):
        if _RESETS[s]:
            keep = put = 0
        else:
            put |= _SETS[s]
    return keep, put


def matched_flags(symbols: list[int], bits: int) -> list[int]:
    """For every event whether its closer is ahead, given the ``bits`` from the right of the chunk."""
    flags = [0] * len(symbols)
    for i in range(len(symbols) - 1, -1, -1):
        s = symbols[i]
        if _NEEDS[s]:
            flags[i] = 1 if bits & _NEEDS[s] else 0
        if _RESETS[s]:
            bits = 0
        else:
            bits |= _SETS[s]
    return flags


def left_function(symbols: list[int], flags: list[int]) -> np.ndarray:
    """A chunk as a function of the state coming from its left."""
    f = np.arange(N_STATES)
    for s, m in zip(symbols, flags):
        f = MOVE[m, s][f]
    return f


def boundaries(symbols: list[int], flags: list[int], state: int) -> list[int]:
    """Numbers of the events that end a sentence, starting in ``state``."""
    out = []
    for i, (s, m) in enumerate(zip(symbols, flags)):
        if _ENDS[m][s][state]:
            out.append(i)
        state = _MOVE[m][s][state]
    return out


def sentences_of(text: str, doc_type: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of the sentences of one text, in one piece."""
    found = events(text, doc_type == LINES, text == text.lower())
    symbols = [s for s, _, _ in found]
    flags = matched_flags(symbols, 0)
    out, start = [], None
    for i in boundaries(symbols, flags, 0):
        _, end, nxt = found[i]
        if start is not None and end > start:
            out.append((start, end))
        start = nxt
    return out


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, starts, ends = [], [], []
        for doc_id, text, kind in zip(pdf["doc_id"], pdf["text"], pdf["doc_type"]):
            for a, b in sentences_of(text, kind):
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "start_char": np.array(starts, np.int64), "end_char": np.array(ends, np.int64)})


_PIECE = "row long, doc_id long, chunk int, base long, lead int, stop int, piece string, lines boolean, lower boolean, marked boolean, last boolean"


def _cut(chunk: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc_id, text, kind in zip(pdf["row"], pdf["doc_id"], pdf["text"], pdf["doc_type"]):
                lower, chunks, out = text == text.lower(), cut(text, chunk), []
                for i, (start, stop, marked) in enumerate(chunks):
                    base, piece = window(text, start, stop)
                    out.append((row, doc_id, i, base, start - base, stop - base, piece, kind == LINES, lower, marked, i == len(chunks) - 1))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return pieces


def _chunk_events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for row in pdf.itertuples():
            found = events(row.piece, row.lines, row.lower, row.lead, len(row.piece) if row.last else row.stop, row.marked)
            symbols = [e[0] for e in found]
            keep, put = right_function(symbols)
            rows.append((row.row, row.doc_id, row.chunk, symbols, [row.base + e[1] for e in found], [row.base + e[2] for e in found], keep, put))
        yield pd.DataFrame(rows, columns=["row", "doc_id", "chunk", "symbols", "ends", "nexts", "keep", "put"])


def _scan_right(pdf: pd.DataFrame) -> pd.DataFrame:
    """Bits from the right of every chunk of a text: a scan by doubling over ``bits & keep | put``."""
    pdf = pdf.sort_values("chunk", ignore_index=True)
    keep, put = pdf["keep"].to_numpy(np.int64), pdf["put"].to_numpy(np.int64)
    k = 1
    while k < len(keep):  # (keep, put)[i] becomes the function of chunks i ... i + 2k - 1
        new_put = put.copy()
        new_keep = keep.copy()
        new_put[:-k] = put[k:] & keep[:-k] | put[:-k]
        new_keep[:-k] = keep[k:] & keep[:-k]
        keep, put, k = new_keep, new_put, 2 * k
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "bits": np.append(put[1:], 0)})


def _scan_left(pdf: pd.DataFrame) -> pd.DataFrame:
    """State before every chunk of a text: a scan by doubling over the composed transition functions."""
    pdf = pdf.sort_values("chunk", ignore_index=True)
    f = np.stack([np.asarray(x, np.int64) for x in pdf["f"]])
    k = 1
    while k < len(f):
        new = f.copy()
        new[k:] = np.take_along_axis(f[k:], f[:-k], axis=1)
        f, k = new, 2 * k
    # the start of the next sentence also travels: the last boundary before the chunk, whatever state led to it
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "state": np.append([0], f[:-1, 0])})


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [left_function(list(s), matched_flags(list(s), int(b))) for s, b in zip(pdf["symbols"], pdf["bits"])]
        yield pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "f": [r.tolist() for r in rows]})


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sentences that begin and end in a chunk, and per chunk with boundaries one ``edge`` row: its first sentence end and
    the start of the sentence open at its end."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            symbols = list(row.symbols)
            at = boundaries(symbols, matched_flags(symbols, int(row.bits)), int(row.state))
            out += [(row.row, row.doc_id, row.chunk, False, int(row.nexts[i]), int(row.ends[j])) for i, j in zip(at, at[1:])]
            if at:
                out.append((row.row, row.doc_id, row.chunk, True, int(row.nexts[at[-1]]), int(row.ends[at[0]])))
        yield pd.DataFrame(out, columns=["row", "doc_id", "chunk", "edge", "start_char", "end_char"])


def sentences(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, start_char, end_char``: one row per sentence; positions count characters, the end is exclusive."""
    scratch = Scratch(documents.sparkSession, "sentences")
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "doc_type")
    short = docs.where(F.length("text") <= chunk).mapInPandas(_whole, "doc_id long, start_char long, end_char long")
    long = docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    pieces = long.mapInPandas(_cut(chunk), _PIECE)
    chunks = scratch.write(pieces.repartition("row", "chunk").mapInPandas(
        _chunk_events, "row long, doc_id long, chunk int, symbols array<int>, ends array<long>, nexts array<long>, keep int, put int"))
    bits = chunks.select("row", "chunk", "keep", "put").groupBy("row").applyInPandas(_scan_right, "row long, chunk int, bits int")
    ready = chunks.select("row", "doc_id", "chunk", "symbols", "ends", "nexts").join(bits, ["row", "chunk"])
    ready = scratch.write(ready)
    f = ready.select("row", "chunk", "symbols", "bits").mapInPandas(_functions, "row long, chunk int, f array<int>")
    states = f.groupBy("row").applyInPandas(_scan_left, "row long, chunk int, state int")
    marks = ready.join(states, ["row", "chunk"]).mapInPandas(_marks, "row long, doc_id long, chunk int, edge boolean, start_char long, end_char long")
    marks = scratch.write(marks)
    # a sentence over a border runs from one edge's start to the next edge's end: one row a chunk meets here
    order = Window.partitionBy("row").orderBy("chunk")
    edges = marks.where("edge").select("doc_id", F.lag("start_char").over(order).alias("start_char"), "end_char")
    spans = marks.where("not edge").select("doc_id", "start_char", "end_char").unionByName(edges.where("start_char is not null"))
    return short.unionByName(spans.where("end_char > start_char"))
