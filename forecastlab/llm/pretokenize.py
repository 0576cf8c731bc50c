"""Vectorised pre-tokenisation: codepoint classes and an associative scan of transition functions, no regular expression."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White space outside ASCII, and in it (fixed values of the Unicode property White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Symbols that a code point becomes with what follows it: a class; white space inside a run; the last white space
#: before text, a blank or not; an apostrophe that may begin a contraction of two or three characters; the end of a text.
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_BLANK, S_LAST, S_APOS2, S_APOS3, S_END = range(9)
#: States after a code point: nothing open; a run of letters, numbers, others or white space; a blank that the next
#: run takes in; one or two letters of a contraction to come.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each code point; the next state by symbol and state; whether the symbol starts a token in that state."""
    kinds = np.fromiter((LETTER if (c := unicodedata.category(chr(i))[0]) == "L" else NUMBER if c == "N" else OTHER for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    kinds[WHITE] = SPACE
    to, starts = np.zeros((9, 8), dtype=np.uint8), np.ones((9, 8), dtype=bool)
    for symbol, state in ((S_OTHER, IN_OTHERS), (S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS)):
        to[symbol] = state
        starts[symbol, [state, AFTER_BLANK]] = False
    to[S_LETTER, ONE_MORE], to[S_LETTER, TWO_MORE] = NONE, ONE_MORE
    starts[S_LETTER, [ONE_MORE, TWO_MORE]] = False
    to[S_WHITE], starts[S_WHITE, IN_WHITE] = IN_WHITE, False
    to[S_BLANK], to[S_LAST], to[S_END] = AFTER_BLANK, NONE, NONE
    for symbol, state in ((S_APOS2, ONE_MORE), (S_APOS3, TWO_MORE)):
        to[symbol] = state
        to[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, AFTER_BLANK]] = False
    return kinds, to, starts


def _symbols(points: np.ndarray, end: int) -> np.ndarray:
    """The symbol of each code point; end is the code point that closes each text."""
    kinds, _, _ = _tables()
    closing = points == end
    kind = kinds[np.where(closing, 0, points)]
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], dtype=np.uint8)[kind]
    after = np.append(points[1:], end)
    last = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~closing[1:]
    blank = points[:-1] == 0x20
    symbol[:-1][last & blank], symbol[:-1][last & ~blank] = S_BLANK, S_LAST
    apostrophes = np.flatnonzero(points == 0x27)
    a, b = after[apostrophes], after[np.minimum(apostrophes + 1, len(after) - 1)]
    two = np.isin(a, [ord(c) for c in "stmd"])
    three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    symbol[apostrophes[two]], symbol[apostrophes[three]] = S_APOS2, S_APOS3
    symbol[closing] = S_END
    return symbol


def states_before(symbol: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol, from NONE on, by a scan.

    Each symbol is a function from states to states, and functions compose associatively: rows of `width` symbols are
    composed side by side, the rows' functions are composed pair by pair in doubling strides, and each row then runs
    from the state that the rows before it leave.
    """
    to = _tables()[1].reshape(-1).astype(np.intp)
    n = len(symbol)
    rows = -(-n // width)
    grid = np.full(rows * width, S_END, dtype=np.intp)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, width).T) * 8
    whole = np.tile(np.arange(8, dtype=np.intp)[:, None], (1, rows))
    for column in grid:
        whole = to.take(column + whole)
    whole = np.ascontiguousarray(whole.T)
    stride = 1
    while stride < rows:
        whole[stride:] = np.take_along_axis(whole[stride:], whole[:-stride], axis=1)
        stride *= 2
    state = np.concatenate([np.zeros(1, dtype=np.intp), whole[:-1, NONE]])
    out = np.empty((width, rows), dtype=np.uint8)
    for k, column in enumerate(grid):
        out[k] = state
        state = to.take(column + state)
    return out.T.reshape(-1)[:n]


def cuts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, the offsets in them at which tokens start, with the end, and how many tokens each text has."""
    end = 0x10FFFF  # a noncharacter; a text that has it is taken by itself
    odd = [i for i, t in enumerate(texts) if chr(end) in t]
    if odd and len(texts) > 1:
        parts = [cuts([t]) for t in texts]
        base = np.cumsum([0, *[len(data) for data, *_ in parts]])
        return np.concatenate([d for d, *_ in parts]), np.concatenate([*[at[:-1] + b for (_, at, _), b in zip(parts, base)], base[-1:]]), np.concatenate([n for *_, n in parts])
    if odd:
        end = next(c for c in range(0xE000, 0x110000) if chr(c) not in texts[0])
    points = np.frombuffer((chr(end).join(texts) + chr(end)).encode("utf-32-le"), dtype=np.uint32) if texts else np.zeros(0, dtype=np.uint32)
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    if not len(points):
        return data, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    symbol = _symbols(points, end)
    closing = symbol == S_END
    start = np.flatnonzero(_tables()[2][symbol, states_before(symbol)] & ~closing)
    if len(data) == len(points) - len(texts):
        offset = np.arange(len(points), dtype=np.int64) - (np.cumsum(closing) - closing)
    else:
        size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        size[closing] = 0
        offset = np.cumsum(size, dtype=np.int64) - size
    return data, np.append(offset[start], len(data)), np.diff(np.searchsorted(start, np.flatnonzero(closing)), prepend=0)


def boundaries(texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
    """For each text its UTF-8 bytes and the byte offsets of its tokens' starts, and of the end."""
    _, at, n = cuts(texts)
    out, first, base = [], 0, 0
    for text, tokens in zip(texts, n.tolist()):
        data = text.encode()
        out.append((data, np.append(at[first : first + tokens] - base, len(data))))
        first, base = first + tokens, base + len(data)
    return out
