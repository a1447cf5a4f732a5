"""Pairing of tags, in one pass over the tags of a page.

The columns of ``functions.html`` cut a page into tags and texts; a tag arrives here as its code: ``name`` for
one that opens, ``/name`` for one that ends, nothing for all others. An end tag ends the nearest open element of
its name and all inside it, or nothing; what is still open ends with the page. Each tag is pushed and popped once, so
the time is linear in the page, however deep or broken it is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Page columns then work on executors that do not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def elements(codes: str) -> Iterator[tuple[int, int, str]]:
    """(first tag, last tag, name) of every element in the order of their ends; last is the number of tags if unclosed."""
    tags = codes.split(" ")
    stack: list[int] = []
    count: dict[str, int] = {}
    for i, code in enumerate(tags):
        if not code:
            continue
        if code[0] != "/":
            stack.append(i)
            count[code] = count.get(code, 0) + 1
        elif count.get(code[1:]):
            name = ""
            while name != code[1:]:
                first = stack.pop()
                name = tags[first]
                count[name] -= 1
                yield first, i, name
    while stack:
        first = stack.pop()
        yield first, len(tags), tags[first]


def outermost(codes: str, names: frozenset[str]) -> list[int]:
    """First and last tags, one after the other, of those elements of some names that are inside of no other such."""
    out: list[int] = []
    for first, last in sorted((a, b) for a, b, name in elements(codes) if name in names):
        if not out or first > out[-1]:
            out += [first, last]
    return out


def nodes_of(codes: str, texts: list[str], names: tuple[str, ...], least: int) -> list[list[str]]:
    """Text nodes of the elements of each name in turn, in page order; ``texts`` stand before, between and after the tags.

    Nodes are trimmed and blank ones left out. Lengths come from running sums, so that elements with less than
    ``least`` characters cost nothing.
    """
    texts = [t.strip() for t in texts]
    length = [0, *accumulate(map(len, texts))]
    filled = [0, *accumulate(1 if t else 0 for t in texts)]
    full = [t for t in texts if t]
    level = {n: i for i, n in enumerate(names)}
    found = sorted((level[name], a, b) for a, b, name in elements(codes)
                   if name in level and length[b + 1] - length[a + 1] >= least)
    return [full[filled[a + 1]:filled[b + 1]] for _, a, b in found]


# As columns. Wanted names are part of the function, codes and texts its arguments.

@lru_cache
def outermost_column(names: tuple[str, ...]):
    wanted = frozenset(names)

    @F.pandas_udf("array<int>")
    def ranges(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: outermost(c, wanted) if c else [])
    return ranges


@lru_cache
def nodes_column(names: tuple[str, ...], least: int):
    @F.pandas_udf("array<array<string>>")
    def nodes(page: pd.DataFrame) -> pd.Series:
        return pd.Series([nodes_of(c, list(t), names, least) for c, t in zip(page["codes"], page["texts"])], dtype=object)
    return nodes
