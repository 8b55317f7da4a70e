"""Repair of conversation structure by alignment with the alternating grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.llm.common import table
from surfparc.session import cut

# Costs of the edits; a truncated row that stays costs as much as a change.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"s": "system", "u": "user", "a": "assistant"}
# Cells of the alignment table kept at once; beyond, rows in between are computed again.
CELLS = 4_000_000
FAR = np.int64(2**40)
SPACE = " \t\n\x0b\f\r"


class Alignment:
    """Wagner-Fischer tables of one conversation against every feasible length of the alternating string.

    All targets end alike (``...uaua``), so one table over the number of target
    places still to fill serves all lengths. Costs are counted above what every
    repair pays (forced deletions, one charge per truncated row). A plain repair
    gives the incumbent, whose cost bounds how far the numbers of places and of
    rows that are left may be apart (Ukkonen's band). Memory is the band's cells,
    or, beyond ``CELLS``, those of about the square root of the rows.
    """

    def __init__(self, initials: str, faults: str, cells: int = CELLS) -> None:
        # "-" is a row that has to go.
        self.initials = "".join("-" if f in "bd" else i for i, f in zip(initials, faults, strict=True))
        self.base = sum(DELETE if f in "bd" else TRUNCATED if f == "t" else 0 for f in faults)
        self.away = [0 if f in "bd" else DELETE - (TRUNCATED if f == "t" else 0) for f in faults]
        self.n = len(initials)
        free = self.initials.replace("-", "")
        most = min(self.plain(free), sum(self.away), self.plain(free[1:] or "xx") if free[:1] == "s" else sum(self.away))
        rows = np.array([c != "-" for c in self.initials], np.int64)
        left, soft = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (rows, rows * (np.array(self.away, np.int64) < DELETE)))
        # As many rows as the incumbent's cost pays for may go; truncated ones cost least.
        gone = np.minimum(most // (DELETE - TRUNCATED), soft) + np.maximum(most - soft * (DELETE - TRUNCATED), 0) // DELETE
        self.low, self.high = np.maximum(left - gone, 0), left + most // INSERT + 1
        self.step = max(self.n, 1) if int((self.high - self.low + 1).sum()) <= cells else isqrt(self.n) + 1
        self.solve()

    @staticmethod
    def plain(initials: str) -> int:
        """Cost of a repair that changes wrong roles and puts in what is missing between turns."""
        cost, want = 0, "u"
        for c in initials:
            cost += INSERT if c in "ua" and c != want else 0 if c in "ua" else REROLE
            spoken = c if c in "ua" else want
            want = "a" if spoken == "u" else "u"
        return cost + (INSERT if want == "a" else 0)

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row ``i`` of the table from row ``i + 1``: the least cost of filling r places from rows ``i`` on, by r."""
        lo, hi = int(self.low[i]), int(self.high[i])
        a, b = int(self.low[i + 1]), int(self.high[i + 1])
        padded = np.full(hi - lo + 2, FAR)
        s, e = max(a, lo - 1), min(b, hi)
        padded[s - lo + 1 : e - lo + 2] = after[s - a : e - a + 1]
        out, places = padded[1:] + self.away[i], np.arange(lo, hi + 1)
        if self.initials[i] != "-":
            used = padded[:-1] + np.where(np.where(places % 2 == 1, "a", "u") == self.initials[i], 0, REROLE)
            out = np.minimum(out, np.where(places > 0, used, FAR))
        return np.minimum.accumulate(out - INSERT * places) + INSERT * places

    def least(self, i: int, row: np.ndarray, places: int) -> int:
        """Cheapest even number of places, from ``places`` on."""
        r = np.arange(self.low[i], self.high[i] + 1)
        return int(np.where((r % 2 == 0) & (r >= places), row, FAR).min())

    def solve(self) -> None:
        """Goes through all rows backwards; notes what a repair costs that keeps an ``s`` as its first turn."""
        row = INSERT * np.arange(self.low[self.n], self.high[self.n] + 1, dtype=np.int64)
        self.rows, started = {self.n: row}, {}
        for i in range(self.n - 1, -1, -1):
            if self.initials[i] == "s":
                started[i] = sum(self.away[:i]) + self.least(i + 1, row, 2)
            row = self.before(i, row)
            if self.step >= self.n or i % self.step == 0:
                self.rows[i] = row
        self.best = min([self.least(0, row, 0), *started.values()])
        self.openings = {i for i, c in started.items() if c == self.best}

    def at(self, i: int, r: int) -> int:
        """A cell; rows between kept ones are computed again, one stretch at a time."""
        if i not in self.rows:
            first = i - i % self.step
            self.rows = {k: v for k, v in self.rows.items() if k % self.step == 0 or k == self.n}
            for k in range(min(first + self.step, self.n) - 1, first, -1):
                self.rows[k] = self.before(k, self.rows[k + 1])
        return int(self.rows[i][r - self.low[i]]) if self.low[i] <= r <= self.high[i] else int(FAR)

    def even(self, i: int, cost: int) -> set[int]:
        return {r for r in range(int(self.low[i]), int(self.high[i]) + 1) if r % 2 == 0 and self.at(i, r) == cost}

    def audit(self) -> tuple[int, str, str]:
        """The least cost, the ASCII-least string of edits of all cheapest repairs, and the initials it leaves.

        The backtraces of all tied lengths go forward side by side: they share the
        edits so far and what is still to pay, and those that can't take the
        smallest next edit drop out. None stands for a backtrace that has yet to
        keep its opening ``s``; until then it deletes.
        """
        i, cost, edits, roles = 0, self.best, [], []
        states: set[int | None] = self.even(0, cost) | ({None} if self.openings else set())
        while i < self.n or cost:
            nexts: dict[str, set[int | None]] = {"D": set(), "I": set(), "K": set(), "R": set()}
            places = next((r for r in states if r is not None), 0)
            want = "a" if places % 2 else "u"
            for r in states:
                if r is None:
                    if i in self.openings:
                        nexts["K"] |= self.even(i + 1, cost) - {0}
                    if max(self.openings) > i:
                        nexts["D"].add(None)
                    continue
                if i < self.n:
                    if self.at(i + 1, r) == cost - self.away[i]:
                        nexts["D"].add(r)
                    fits = self.initials[i] == want
                    if r and self.initials[i] != "-" and self.at(i + 1, r - 1) == cost - (0 if fits else REROLE):
                        nexts["K" if fits else "R"].add(r - 1)
                if r and self.at(i, r - 1) == cost - INSERT:
                    nexts["I"].add(r - 1)
            edit = next(e for e in "DIKR" if nexts[e])
            if edit != "D":
                roles.append(self.initials[i] if edit == "K" else want)
            cost -= {"D": self.away[i] if i < self.n else 0, "I": INSERT, "K": 0, "R": REROLE}[edit]
            edits.append(edit)
            states = nexts[edit]
            i += edit != "I"
        return self.best + self.base, "".join(edits), "".join(roles)


@lru_cache(4096)
def cheapest(initials: str, faults: str) -> tuple[int, str, str]:
    """Cost, audit and initials left; many conversations look alike."""
    return Alignment(initials, faults).audit()


def marked(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text, digest); nulls of role and text are one space."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary")))


def audits(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults, cheapest repair and its audit for every conversation; see ``repair``."""
    rows = marked(turns, key, turn, role, text)
    nth = F.row_number().over(W.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    last, initial = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)), F.substring("role", 1, 1)
    slim = rows.select("conv", "turn", "role", "digest", last.alias("last")).withColumn("nth", nth)
    fault = F.when(F.col("last") == "", "b").when(F.col("nth") > 1, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-")
    coded = slim.select("conv", "turn", "role", "digest", "nth", F.when(initial.isin(*NAMES), initial).otherwise("x").alias("initial"), fault.alias("fault"))
    placed = coded.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "nth")
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles"]

    def report(conv, numbers: list, initials: str, faults: str) -> tuple:
        known = [t for t in numbers if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(pair not in ("su", "ua", "au") for pair in (initials[i : i + 2] for i in range(len(initials) - 1)))
        return conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *cheapest(initials, faults)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, initials, faults = None, [], [], []
        out: list[tuple] = []
        kinds = None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for conv, number, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "initial", "fault")), strict=True):
                if initials and conv != now:
                    out.append(report(now, numbers, "".join(initials), "".join(faults)))
                    numbers, initials, faults = [], [], []
                now = conv
                numbers.append(number)
                initials.append(initial)
                faults.append(fault)
            if out:
                yield as_batch(out, kinds)
                out = []
        if initials:
            yield as_batch([report(now, numbers, "".join(initials), "".join(faults))], kinds)

    def as_batch(out: list[tuple], kinds) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds), *[pa.array(c, pa.int64()) for c in columns[1:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], names)

    kind = rows.schema["conv"].dataType.simpleString()
    found = placed.mapInArrow(scan, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string")
    return found.withColumnRenamed("conv", key)


def repair(turns: DataFrame, reports: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``key``, place (from 0), role, text, edit.

    ``reports`` is what ``audits`` gave for the same rows. A row's first fault
    counts: blank (nothing but white space), duplicate (role and text seen earlier
    in the conversation), truncated (the last character that is no white space is
    none of ``.!?``). Blank and duplicate rows are deleted; keeping costs 0, a new
    role or an inserted empty turn 3, a deletion 4, and every truncated row that
    stays 3 more. The initials of the roles left read ``(s?(ua)+)?``; of all
    cheapest repairs the one with the ASCII-least edits (D, I, K, R) is taken.

    Null roles and texts are one space; roles that begin with none of s, u, a can't
    stay as they are. Null keys are one conversation; null turn numbers come first;
    rows that share a number are ordered by role, then digest of the text, and
    repeated rows are duplicates. Other columns are ignored; no rows give no rows.

    Texts are shuffled once, behind their conversation's report, and stream
    through the task in order: it holds one batch and one report, never a whole
    conversation's texts. A conversation's turns stay together and in order.
    """
    rows = marked(turns, key, turn, role, text).withColumn("__kind", F.lit(1))
    none = F.lit(None).cast("string")
    heads = reports.select(F.col(key).alias("conv"), F.lit(None).cast("long").alias("turn"), F.col("roles").alias("role"), F.col("audit").alias("text"), none.alias("digest"), F.lit(0).alias("__kind"))
    placed = heads.unionByName(rows).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "__kind", F.col("turn").asc_nulls_first(), "role", "digest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, roles, at, place, now, kinds = "", "", 0, 0, None, None
        out: list[tuple] = []

        def inserted() -> None:
            nonlocal at, place
            while at < len(edits) and edits[at] == "I":
                out.append((now, place, NAMES[roles[place]], "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            kinds = batch.schema.field(0).type
            for conv, said, words, head in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "__kind")), strict=True):
                if head == 0:
                    inserted()
                    edits, roles, at, place, now = words, said, 0, 0, conv
                    continue
                inserted()
                edit, at = edits[at], at + 1
                if edit != "D":
                    out.append((now, place, said if edit == "K" else NAMES[roles[place]], words, edit))
                    place += 1
            if out:
                yield as_batch(out, kinds)
                out.clear()
        inserted()
        if out:
            yield as_batch(out, kinds)

    def as_batch(out: list[tuple], kinds) -> pa.RecordBatch:
        conv, place, role, text, edit = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(conv, kinds), pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(edit, pa.string())], ["conv", "place", "role", "text", "edit"]
        )

    kind = rows.schema["conv"].dataType.simpleString()
    return placed.mapInArrow(scan, f"conv {kind}, place long, role string, text string, edit string").withColumnRenamed("conv", key)


def digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines; ``repaired`` holds its turns together and in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, kinds = None, None, None
        out: list[tuple] = []
        for batch in batches:
            kinds = batch.schema.field(0).type
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if running is not None:
                        out.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256()
                running.update((f"{chr(10) if place else ''}{role}:{text}").encode())
            if out:
                yield as_batch(out, kinds)
                out = []
        if running is not None:
            yield as_batch([(now, running.hexdigest())], kinds)

    def as_batch(out: list[tuple], kinds) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kinds), pa.array([x for _, x in out])], ["conv", "sha"])

    kind = repaired.schema[key].dataType.simpleString()
    return repaired.select(key, "place", "role", "text").mapInArrow(scan, f"conv {kind}, sha string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by crc32(``conv_id:turn``) modulo 20; nulls of role, text and in the hashed text are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), d.alias("d")).filter("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits and digests of all conversations, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    reports = cut(audits(rows))
    shas = digests(repair(rows, reports))
    every = turns.select("conv_id").distinct()
    found = every.join(reports.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    found = found.join(shas, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def oracle() -> str:
    """Another way to the same repair: per row, the cheapest and ASCII-least way into each state of the grammar."""
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
    pay = lambda state, cost, edit, said="''": f"{{'c': struct_extract({state}, 'c') + ({cost}), 'a': struct_extract({state}, 'a') || '{edit}', 't': struct_extract({state}, 't') || {said}}}"
    least = lambda *states: f"list_sort([{', '.join(states)}])[1]"
    line = lambda role, text: f"{role} || ':' || {text} || chr(10)"
    inserts = f"""
      SELECT *, {least("qu", *[pay(q, 3, "I", "'user:' || chr(10)") for q in ("q0", "qs", "qa")])} AS iu, {least("qa", pay("iu", 3, "I", "'assistant:' || chr(10)"))} AS ia FROM """
    stay = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
    lost = "CASE WHEN fault IN ('b', 'd') THEN 1000000000 ELSE 0 END"
    keep = lambda q, i: pay(q, f"{stay} + {lost} + CASE WHEN initial = '{i}' THEN 0 ELSE 1000000000 END", "K", line("role", "text"))
    change = lambda q, name: pay(q, f"3 + {stay} + {lost}", "R", line(f"'{name}'", "text"))
    drop = lambda q: pay(q, 4, "D")
    into_u = [f(q, x) for q in ("q0", "qs", "ia") for f, x in ((keep, "u"), (change, "user"))]
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM keyed, crc),
rows AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS n, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM seen),
coded AS (SELECT conv_id, turn, n, role, text, left(role, 1) AS initial,
    CASE WHEN last = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
facts AS (SELECT conv_id, max(n) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id),
steps AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS q0, {far} AS qs, {far} AS qu, {far} AS qa FROM facts
  UNION ALL
  SELECT s.conv_id, c.n, {drop("q0")}, {least(drop("qs"), keep("q0", "s"))}, {least(drop("iu"), *into_u)}, {least(drop("ia"), keep("iu", "a"), change("iu", "assistant"))}
  FROM ({inserts} steps) s JOIN coded c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.n + 1),
done AS (SELECT conv_id, n, {least("q0", "ia")} AS best FROM ({inserts} steps))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, length(best.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id AND d.n = f.rows
"""


ORACLE = oracle()
