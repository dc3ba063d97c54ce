"""URL rules as one bit-parallel wildcard automaton.

Every rule is a few globs over the canonical URL (host, then path): ``**`` stands
for any run of bytes, ``*`` for one without a slash, ``?`` for one byte. The states of all globs lie side by
side in a few 64-bit words, and one shift, one mask and one or step all of them
at once, for all URLs of a batch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import q
from tideframe.llm import text as tx


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        """The host itself and all below it; the path begins with the rule's."""
        plain = self.host + self.path
        return [f"{plain}**", f"*.{plain}**"]


class Automaton:
    """Shift-And over several words for a list of globs.

    A glob's literal bytes take one bit each, and a bit before the first says
    that the beginning is reached. A star keeps the bit before it set as long as it
    takes the bytes that come.
    """

    def __init__(self, globs: list[str]):
        masks: list[tuple[int, int | None]] = []      # (bit, byte it takes; None for any)
        loops: list[tuple[int, bool]] = []            # (bit, whether it takes slashes too)
        first, last = [], []
        bit = 0
        for glob in globs:
            first.append(bit)
            for part in re.findall(rb"(?s)\*\*|.", glob.encode()):
                if part[:1] == b"*":
                    loops.append((bit, len(part) == 2))
                else:
                    bit += 1
                    masks.append((bit, None if part == b"?" else part[0]))
            last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.first = self._bits(first)
        self.loop = np.tile(self._bits([at for at, _ in loops]), (256, 1))
        self.loop[ord("/")] = self._bits([at for at, slashes in loops if slashes])
        self.last = np.array(last, dtype=np.int64)
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        for at, c in masks:
            self.step[slice(None) if c is None else c, at // 64] |= np.uint64(1 << (at % 64))

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for at in places:
            out[at // 64] |= np.uint64(1 << (at % 64))
        return out

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x globs: whether the whole of each row's bytes fits each glob."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.first, (len(lengths), 1))
        begins, ordered = offsets[:-1][order], lengths[order]
        going = len(order)
        for i in range(int(ordered[0]) if len(ordered) else 0):
            while ordered[going - 1] <= i:
                going -= 1
            old = state[:going]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            byte = data[begins[:going] + i]
            state[:going] = (moved & self.step[byte]) | (old & self.loop[byte])
        hit = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, dtype=bool)
        out[order] = hit.astype(bool)
        return out


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ://, A-Z lower-cased, up to / ? # or
    the end, and the path from there up to ? # or the end. Empty without a ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")),
            F.coalesce(path, F.lit("")))


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and verdict.

    Of equally long rules the first listed wins. Null URLs and such without a
    host fit no rule whose host is not empty. No rows give no rows. Columns
    of ``df`` named like an added one are replaced. The rules go to every task;
    they are the caller's list, not data.
    """
    globs = [(i, g) for i, r in enumerate(rules) for g in r.globs()]
    rank = {i: n for n, i in enumerate(sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i)))}
    by_rank = sorted(rank, key=rank.get)

    @F.pandas_udf("int")
    def best(column: pd.Series) -> pd.Series:
        machine = Automaton([g for _, g in globs])
        out = np.full(len(column), -1, dtype=np.int32)
        data, offsets = tx.utf8(pa.array(column, pa.large_string()))
        fits = machine.run(data, offsets)
        for i in reversed(by_rank):
            out[fits[:, [n for n, (r, _) in enumerate(globs) if r == i]].any(1)] = i
        return pd.Series(out)

    host, path = canonical(F.col(q(url_col)))
    df = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    fit = best(F.concat("host", "path")) if rules else F.lit(-1)
    names, verdicts = (F.array(*[F.lit(x) for x in xs]) if rules else F.array(F.lit("")) for xs in
                       ([r.name for r in rules], [r.verdict for r in rules]))
    place, = tx.unused(df, "_fit")
    df = df.withColumn(place, fit)
    some = F.col(place) >= 0
    return df.withColumn("rule", F.when(some, F.get(names, F.col(place)))) \
        .withColumn("verdict", F.when(some, F.get(verdicts, F.col(place))).otherwise(otherwise)).drop(place)

