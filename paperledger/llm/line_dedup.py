"""Line deduplication by pairwise alignment.

1. *Lines.* Each text becomes the hashes and word counts of its lines, without white space at their ends.
2. *Overlaps.* Keys are the shortest runs of lines with ``BLOCK_WORDS`` words or more from each line on, and up to each
   line, but blank ones. A block's lines all stand in such runs within it, so that whatever a block shares has a key
   of its own. A key that two documents
   or more hold brings each later document together with the first that holds it. A key that a third of all documents
   hold is as rare as any in this: its first holder comes from an aggregation that is merged before it is sent, and
   it makes one pair for each later document, never all pairs of its holders. Pairs that several keys make are one. A
   key finds its first holder, and a pair the first holder's lines, by salts of the later documents, so that no task
   gets all of one key's holders or all partners of one long document.
3. *Alignment.* Patience diff aligns the two rows of line hashes: lines that are unique in both and in one order are
   anchors; between anchors, equal lines at either end are matched, and the rest is aligned in the same way.
4. *Runs.* An alignment is one rising row and rests on unique lines. Where it leaves lines that the earlier document
   holds, a suffix automaton of that document finds every run of lines common to both, wherever and however often it
   stands in either.
5. *Removal.* A block is a run of lines that follow each other in both documents. Blocks of ``BLOCK_WORDS`` words or
   more go from the later document; shorter ones, which clean documents share by chance, stay.

Only hashes are paired; a text moves once, to meet the numbers of its lines that go.

Defined cases: a null text stays null and an empty one empty, with no lines; a null id is neither first nor later, and
its row stays as it is; rows that repeat an id are not earlier or later than each other, and each loses what stands in a
text of the least id; ties between earlier documents fall to the least id; of a very long text hashes and
counts of lines are held, some bytes a line; an empty table gives an empty result; columns of any other names go along,
while ``n_lines``, ``n_removed`` and ``removed`` are the operator's own. Blank lines are aligned only between equal
neighbours and count no words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, wordhash

BLOCK_WORDS = 10


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that are unique in both ranges, as the longest row that rises in both: patience sorting."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
    both = [(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at]
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(both):
        p = bisect_left(tops, j)
        before.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    row, k = [], piles[-1] if piles else -1
    while k >= 0:
        row.append(both[k])
        k = before[k]
    return row[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned lines of ``a`` and ``b``, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if not anchors:
            continue
        out += anchors
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def _automaton(a: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Steps, suffix links and lengths of the states of the suffix automaton of ``a``."""
    steps: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for x in a:
        new = len(steps)
        steps.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and x not in steps[p]:
            steps[p][x] = new
            p = links[p]
        if p >= 0:
            q = steps[p][x]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and steps[p].get(x) == q:
                    steps[p][x] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return steps, links, lengths


def common_runs(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Numbers of the lines of ``b`` in any run of at least so many words that ``a`` holds too, in any order and any
    number of times. Of the runs that end at a line the longest holds the others."""
    steps, links, lengths = _automaton(a)
    upto = [0, *accumulate(words)]
    gone: list[int] = []
    state = held = free = 0
    for j, x in enumerate(b):
        while state and x not in steps[state]:
            state = links[state]
            held = lengths[state]
        if x in steps[state]:
            state, held = steps[state][x], held + 1
        if upto[j + 1] - upto[j + 1 - held] >= least:
            gone += range(max(free, j + 1 - held), j + 1)
            free = j + 1
    return gone


def removed_lines(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Numbers of the lines of ``b``, the later one, in common blocks of at least so many words."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-1, -1)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least:
                gone += block
            block = []
        block.append(j)
        last = i, j
    in_a, settled = set(a), set(gone)
    left = any(h in in_a and j not in settled for j, h in enumerate(b))
    return common_runs(a, b, words, least) if left else gone


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, gone = [], []
        rows = []
        for c in (2, 3, 4):
            offsets, flat = batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()
            rows.append((offsets, flat))
        for k in range(len(batch)):
            a, b, words = (flat[o[k] : o[k + 1]].tolist() for o, flat in rows)
            found = removed_lines(a, b, words)
            if found:
                kept.append(k)
                gone.append(found)
        ids = [batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "which", "gone"])


def runs(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Of documents whose lines lie between the positions ``at``: the document's number and the key of each shortest run
    of at least so many words from a line on, and up to a line. Blank lines within a run count as lines."""
    n = len(hashes)
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(words, out=upto[1:])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    lines = np.flatnonzero(words > 0)
    ends = np.searchsorted(upto, upto[lines] + least)
    whole = ends <= at[1:][doc[lines]]
    starts = np.searchsorted(upto, upto[lines + 1] - least, "right") - 1
    late = starts >= at[:-1][doc[lines]]
    span = np.unique(np.concatenate([np.stack([lines[whole], ends[whole]], 1), np.stack([starts[late], lines[late] + 1], 1)]), axis=0)
    up, down = wordhash.powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(wordhash.mix(hashes.view(np.uint64)) * up[:n], out=total[1:])
        key = (total[span[:, 1]] - total[span[:, 0]]) * down[span[:, 0]]
        key = wordhash.mix(key + (span[:, 1] - span[:, 0]).astype(np.uint64) * wordhash.GOLDEN)
    return doc[span[:, 0]], key.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column(2).offsets.to_numpy()
        hashes, words = (batch.column(c).values.to_numpy()[at[0] : at[-1]] for c in (2, 3))
        doc, key = runs(hashes, words, at - at[0])
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(doc)) for c in (0, 1)), pa.array(key)], ["doc_id", "which", "key"])


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, and n_lines, n_removed and removed (numbers of lines, from 0) added in columns
    of these names, which replace any of the input's."""
    own_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    lined = docs.where(own_id.isNotNull() & (F.length(text) > 0)).select(own_id.alias("doc_id"), F.xxhash64(text).alias("which"), _lines(text).alias("lines"))
    lined = lined.select(
        "doc_id",
        "which",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))).alias("words"),
    )
    lined = scratch.table(lined, "lines")
    salt = scratch.salt("doc_id")
    keys = lined.mapInArrow(_keys, "doc_id long, which long, key long")
    first = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), scratch.salts(salt)).where("first < last")
    first = first.select("key", "first", scratch.each_salt())
    pairs = keys.withColumn("salt", salt).join(first, ["key", "salt"]).where("first < doc_id").select("first", "doc_id", "which").distinct()
    pairs = scratch.table(pairs, "line-pairs")
    own = lined.dropDuplicates(["doc_id", "which"])
    asked = pairs.groupBy("first").agg(scratch.salts(salt))
    earlier = own.select(F.col("doc_id").alias("first"), F.col("hashes").alias("a")).join(asked, "first")
    earlier = earlier.select("first", "a", scratch.each_salt())
    met = pairs.join(own, ["doc_id", "which"]).withColumn("salt", salt).join(earlier, ["first", "salt"])
    gone = met.select("doc_id", "which", "a", F.col("hashes").alias("b"), "words").mapInArrow(_align, "doc_id long, which long, gone array<int>")
    gone = gone.groupBy("doc_id", "which").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, own_id.alias("doc_id"), F.xxhash64(text).alias("which"))
    rows = rows.join(gone, ["doc_id", "which"], "left")
    text = F.col("row")[text_col]
    parts = F.split(text, "\n", -1)
    rest = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("removed", i)), "\n")
    kept = F.when(F.col("removed").isNull(), text).otherwise(rest)
    n = F.when(F.length(text) > 0, F.size(parts)).otherwise(F.lit(0))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    new = {text_col: kept, "n_lines": n, "n_removed": F.size(removed), "removed": removed}
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed") or c in (id_col, text_col)]
    return rows.select(*[new[c].alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns], *[new[c].alias(c) for c in ("n_lines", "n_removed", "removed")])
