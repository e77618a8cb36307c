"""URL filters with a bit-parallel wildcard automaton (operator 5).

Glob rules over canonical URLs (host + path) are packed into multiword Shift-And masks; one step of the automaton
advances all rules over the next byte of all URLs of a batch. ``*`` in a glob stands for any bytes but ``/``, ``**``
for any bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import flat, slices

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """verdict for the host of ``rule`` (up to the first /) and all its subdomains, and paths that start with the rest."""

    rule: str
    verdict: str

    def globs(self) -> tuple[str, str]:
        safe = self.rule if "/" in self.rule else self.rule + "/"
        return f"{safe}**", f"*.{safe}**"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _AZ, _AZ.lower())


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


class ShiftAnd:
    """The masks of a list of globs, in words of 64 states; a glob of m literals has m + 1 states."""

    def __init__(self, globs: list[str]):
        parts = [re.findall(r"\*\*|\*|[^*]+", g) for g in globs]
        sizes = [1 + sum(len(p.encode()) for p in ps if p[0] != "*") for ps in parts]
        self.words = max(1, -(-sum(sizes) // 64))
        step, loop = np.zeros((256, 64 * self.words), bool), np.zeros((256, 64 * self.words), bool)
        first, last, at = [], [], 0
        for ps in parts:
            first.append(at)
            for p in ps:
                if p == "**":
                    loop[:, at] = True
                elif p == "*":
                    loop[np.arange(256) != ord("/"), at] = True
                else:
                    for b in p.encode():
                        at += 1
                        step[b, at] = True
            last.append(at)
            at += 1
        self.step, self.loop = self._pack(step), self._pack(loop)
        self.first = self._pack(np.isin(np.arange(64 * self.words), first)[None])[0]
        self.steady = np.bitwise_and.reduce(self.loop, axis=0)
        self.last = [(k // 64, np.uint64(k % 64)) for k in last]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), self.words)

    def run(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, globs): whether each glob fits the whole of each text."""
        state = np.repeat(self.first[None], len(at) - 1, axis=0)
        live = np.flatnonzero(np.diff(at) > 0)
        t = 0
        one, top = np.uint64(1), np.uint64(63)
        while len(live):
            byte, now = body[at[live] + t], state[live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            now = (moved & self.step[byte]) | (now & self.loop[byte])
            state[live] = now
            t += 1
            # a text has been decided when it has ended, or when only states that stay for ever are left
            live = live[(at[live] + t < at[live + 1]) & (now & ~self.steady).any(axis=1)]
        return np.stack([state[:, w] >> b & one for w, b in self.last], axis=1).astype(bool)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict (the rule's, else ``default``).

    Of rules equally long the first listed wins. Null urls have an empty host and path and no rule; repeated rows stay;
    an empty table gives an empty one; an input column named like an added one raises ValueError. Urls of any length
    are read to where no rule can change any more.
    """
    if both := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"rename these input columns first: {sorted(both)}")
    ordered = sorted(rules, key=lambda r: -len(r.rule))
    globs = [g for r in ordered for g in r.globs()]

    def run(batches):
        automaton = ShiftAnd(globs)
        names = pa.array([r.rule for r in ordered] + [None], pa.string())
        verdicts = pa.array([r.verdict for r in ordered] + [default], pa.string())
        for batch in slices(batches, "__canonical", 4 << 20):
            fits = automaton.run(*flat(batch.column("__canonical"))) if globs else np.zeros((batch.num_rows, 0), bool)
            fits = np.concatenate([fits[:, 0::2] | fits[:, 1::2], np.ones((batch.num_rows, 1), bool)], axis=1)
            best = pa.array(fits.argmax(axis=1))
            own = batch.drop_columns(["__canonical"])
            yield pa.RecordBatch.from_arrays([*own.columns, names.take(best), verdicts.take(best)], [*own.schema.names, "rule", "verdict"])

    canonical = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in canonical.schema.fields)
    return canonical.withColumn("__canonical", F.concat("host", "path")).mapInArrow(run, f"{fields}, rule string, verdict string")
