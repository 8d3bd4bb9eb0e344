"""N-gram Jaccard self-join with signature trees: documents link when 100 * |A & B| >= 80 * |A | B|.

1. *Sets.* Each text becomes the set of the hashes of its distinct word 5-grams. Documents of one set are a class,
   which its least doc_id stands for; from here on, classes are joined. A class keeps its size and bitmap.
2. *Buckets.* Linked sets share a token among the first |A| - ceil(0.8 |A|) + 1 of each, in any one order of tokens.
   The order is by hash, but with the most frequent tokens last; these, ``HOT`` at most, are found from counts over
   all documents. Only the order rests on them, never a result. Classes that share a prefix token form a bucket; equal
   buckets count once. A token that is expected in over ``SMALL`` classes is dealt by pairs of blocks where its classes
   are posted; a bucket that turns out larger, after the shuffle.
3. *Candidates.* Each bucket's classes form signature trees, one for each width of bitmap; the dual traversal leaves
   the pairs whose overlap may suffice, and a spanning forest of these goes on. Its components hold every link within.
   The task of two blocks joins each block's members first, as that block's own task does, and emits only edges between
   the blocks that join what is still apart, so that a group of near copies makes about as many edges as members.
4. *Links.* The token sets of such classes come together by component, a large one by pairs of blocks. Trees again give
   the candidates, and each candidate that no earlier link has joined is compared exactly. A spanning forest of the
   links remains; its components are the result.

No task holds more than a block pair's members, or 16 bytes for each class of a bucket of no frequent token, and none
emits more than a forest of these. A component of k blocks is sent k times: what candidates chain together costs its
square over the block's size.

Defined cases: null and white texts have no shingles and link with nothing; a text of fewer than five words has its
whole sequence as the one shingle; ties are links; where ids are null or repeat, each row counts as a document of its
own, with a row and links of its own, and a component of null ids alone has a null component_id; of a very long text a
worker holds some bytes for each word; an empty table gives an empty result; other columns are not read. Tokens are 64-bit hashes: two shingles of one pair of documents share one
with a chance below 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, signature_tree, wordhash
from .components import components

N = 5
HOT = 1 << 16
OFTEN = 4
WINDOW = 4_000_000
SPLIT, SMALL, FEW = 8192, 512, 16
SEEN = 1_000_000
BLOCK_TOKENS = 4_000_000
_SETS = "doc_id long, n int, h1 long, h2 long, bits binary, token long, df long"
_TASKS = "task long, rep long, n int, tokens binary, side int"


def token_sets(texts: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's row and sorted distinct tokens."""
    for a, b, data, offsets in wordhash.chunks(texts):
        h, first, _, _ = wordhash.words(data, offsets)
        tokens, at = wordhash.shingles(h, first, n)
        for i in range(b - a):
            yield a + i, np.unique(tokens[at[i] : at[i + 1]])


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(wordhash.mix(s ^ wordhash.GOLDEN).sum(dtype=np.uint64).view(np.int64)), int(wordhash.mix(s + wordhash.GOLDEN).sum(dtype=np.uint64).view(np.int64))


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tokens = np.sort(np.concatenate(sets))
    at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    counts = np.diff(np.r_[at, len(tokens)])
    often = counts >= OFTEN
    return tokens[at][often].view(np.int64), counts[often]


def _batch(schema: str, count: int, /, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    arrays = [pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(count, kinds[t]) for k, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [k for k, _ in fields])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows of tokens that many classes of a window of the partition hold."""
    window, held, seen = [], 0, set()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = []
        for i, s in token_sets(batch.column(1)):
            h1, h2 = _digest(s)
            out.append((ids[i], len(s), h1, h2, signature_tree.bitmap(s).tobytes() if len(s) else None))
            if (h1, h2) not in seen:
                seen.add((h1, h2))
                window.append(s)
                held += len(s)
            if held >= WINDOW:
                token, df = _frequent(window)
                yield _batch(_SETS, len(token), token=token, df=df)
                window, held, seen = [], 0, set()
        if out:
            doc_id, n, h1, h2, bits = zip(*out, strict=True)
            yield _batch(_SETS, len(out), doc_id=doc_id, n=n, h1=h1, h2=h2, bits=bits)
    token, df = _frequent(window)
    yield _batch(_SETS, len(token), token=token, df=df)


def blocks_of(size):
    """Into how many blocks a bucket of so many classes is split: of ``SMALL`` while there are ``FEW`` at most, of
    ``SPLIT`` where it is large."""
    return np.maximum(-(-size // SPLIT), np.minimum(-(-size // SMALL), FEW))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _post(shared):
    """Rows (key, cls, side): the classes of each prefix token, once for each partition's window; ``side`` as in
    ``_sides``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, order, blocks = shared.value
        keys, classes, sides, held, seen = [], [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, classes, sides)], ["key", "cls", "side"])
                keys.clear()
                classes.clear()
                sides.clear()

        for batch in batches:
            for _, s in token_sets(batch.column(0)):
                if not len(s):
                    continue
                cls = _digest(s)
                if cls in seen:
                    continue
                seen.add(cls)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    is_hot = hot[at] == s
                    if is_hot.any():
                        late = at[is_hot]
                        late = late[np.argsort(order[late], kind="stable")]
                        take = prefix_length(len(s))
                        cool = s[~is_hot][:take]
                        late = late[: take - len(cool)]
                        keys.append(cool.view(np.int64))
                        classes.append(np.full(len(cool), cls[0]))
                        sides.append(np.zeros(len(cool), np.int32))
                        held += len(cool)
                        for i in late:
                            k = int(blocks[i])
                            token, side = hot[i : i + 1], np.zeros(1, np.int32)
                            if k > 1:  # a block meets every block, itself too
                                own = cls[1] % k
                                side = _sides(np.full(k, own), np.arange(k))
                                with np.errstate(over="ignore"):
                                    token = np.array([wordhash.mix(token + np.uint64(1 + min(own, o) * k + max(own, o)) * wordhash.GOLDEN)[0] for o in range(k)], np.uint64)
                            keys.append(token.view(np.int64))
                            classes.append(np.full(len(token), cls[0]))
                            sides.append(side)
                            held += len(token)
                        if held >= WINDOW // 4:
                            yield from flush()
                            held, seen = 0, set()
                        continue
                own = s[: prefix_length(len(s))]
                keys.append(own.view(np.int64))
                classes.append(np.full(len(own), cls[0]))
                sides.append(np.zeros(len(own), np.int32))
                held += len(own)
                if held >= WINDOW // 4:
                    yield from flush()
                    held, seen = 0, set()
        yield from flush()

    return run


def _sides(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of members of block ``own`` in the task of two blocks: 1 in the lower one, 2 in the higher, 0 in a block's own."""
    return np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int32)


def _split(name: int, k: int, cls: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (bucket, cls, side) of some classes of a bucket by pairs of its ``k`` blocks: a block meets every block,
    itself too. In a bucket of two blocks, those of one meet those of the other only."""
    own = (wordhash.mix(cls.view(np.uint64)) % np.uint64(k)).astype(np.int64)
    own, other, side = np.repeat(own, k), np.tile(np.arange(k), len(cls)), np.repeat(side, k)
    low, high = np.where(side == 0, np.minimum(own, other), np.where(side == 1, own, other)), np.where(side == 0, np.maximum(own, other), np.where(side == 1, other, own))
    with np.errstate(over="ignore"):
        task = wordhash.mix(np.uint64(name & (1 << 64) - 1) + (1 + low * k + high).astype(np.uint64) * wordhash.GOLDEN)
    return task.view(np.int64), np.repeat(cls, k), np.where(side == 0, _sides(own, other), side)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and class to rows (bucket, cls, side) of buckets with two classes or more, and of two blocks
    that both have some; of equal buckets that lie near to each other in this partition, one."""
    seen: set[int] = set()
    rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(key: np.ndarray, cls: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        fresh = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls, side = key[fresh], cls[fresh], side[fresh]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[at, len(key)])
        with np.errstate(over="ignore"):
            name = wordhash.mix(np.add.reduceat(wordhash.mix((cls.view(np.uint64) ^ wordhash.GOLDEN) + side.astype(np.uint64)), at) + sizes.astype(np.uint64)).view(np.int64)
        paired = side[at] > 0
        keep = (sizes > 1) & ~(paired & (np.minimum.reduceat(side, at) == np.maximum.reduceat(side, at)))
        _, first = np.unique(np.where(keep, name, 0), return_index=True)
        once = np.zeros(len(at), bool)
        once[first] = True
        keep &= once
        keep &= np.fromiter((int(x) not in seen for x in name), bool, len(name)) if keep.any() else False
        if len(seen) > SEEN:
            seen.clear()
        seen.update(name[keep].tolist())
        blocks = blocks_of(np.where(paired, sizes // 2, sizes))
        large = keep & (blocks > 1)
        rows = np.repeat(keep & ~large, sizes)
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[rows]), pa.array(cls[rows]), pa.array(side[rows])], ["bucket", "cls", "side"])
        for i in np.flatnonzero(large):
            k, end = int(blocks[i]), at[i] + sizes[i]
            step = max(1, WINDOW // 4 // k)
            for a in range(at[i], end, step):
                b = min(a + step, end)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _split(int(name[i]), k, cls[a:b], side[a:b])], ["bucket", "cls", "side"])

    for batch in batches:
        key, cls, side = (batch.column(i).to_numpy() for i in range(3))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            parts = [*rest, (key[:cut], cls[:cut], side[:cut])]
            yield from found(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            rest = []
        elif rest and rest[0][0][0] != key[0]:
            yield from found(*(np.concatenate(x) for x in zip(*rest, strict=True)))
            rest = []
        rest.append((key[cut:], cls[cut:], side[cut:]))
    if rest:
        yield from found(*(np.concatenate(x) for x in zip(*rest, strict=True)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal first columns, from batches sorted by it."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        at = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(at, at[1:], strict=False):
            if parts and parts[0].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _by_width(rows: list[np.ndarray], members: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The members, and their bitmaps, of each width."""
    widths = np.array([len(rows[i]) for i in members])
    return {int(w): (members[widths == w], np.stack([rows[i] for i in members[widths == w]])) for w in np.unique(widths)}


def _between(mine: dict, theirs: dict, sizes: np.ndarray, of: np.ndarray | None, equal: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for w, (ids, bits) in mine.items():
        own = signature_tree.Tree(bits, sizes[ids], ids)
        if equal and w in theirs:
            more, wide = theirs[w]
            yield from signature_tree.pairs(own, own if mine is theirs else signature_tree.Tree(wide, sizes[more], more), of)
        if 2 * w in theirs:
            more, wide = theirs[2 * w]
            near = sizes[more] * 4 <= sizes[ids].max() * 5
            if near.any():
                other = signature_tree.Tree(signature_tree.fold(wide[near], w), sizes[more[near]], more[near])
                yield from signature_tree.pairs(own, other, of)


def candidates(rows: list[np.ndarray], sizes: np.ndarray, of: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members, by number, from trees over each width of bitmap and over neighbouring widths; sets of widths
    farther apart differ too much in size to link."""
    trees = _by_width(rows, np.arange(len(rows)))
    yield from _between(trees, trees, sizes, of)


def _dealt(rows: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, labels: signature_tree.Labels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates of a task, which the caller joins in ``labels``. Of two blocks, first those within either, whose
    edges are then forgotten, as the block's own task emits them."""
    if not side.any():
        yield from candidates(rows, sizes, labels.of)
        return
    low, high = (_by_width(rows, np.flatnonzero(side == x)) for x in (1, 2))
    for own in (low, high):
        yield from _between(own, own, sizes, labels.of)
    labels.edges.clear()
    yield from _between(low, high, sizes, labels.of)
    yield from _between(high, low, sizes, labels.of, equal=False)


def _edges(ids: np.ndarray, labels: signature_tree.Labels) -> pa.RecordBatch:
    e = np.array(labels.edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], ["a", "b"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rep, n, bits, side), sorted by bucket, to a forest of each bucket's candidate pairs."""
    for t in _groups(batches):
        ids, sizes = t.column("rep").to_numpy(), t.column("n").to_numpy()
        rows = [np.frombuffer(b, np.uint8) for b in t.column("bits").to_pylist()]
        labels = signature_tree.Labels(len(ids))
        for a, b in _dealt(rows, sizes, t.column("side").to_numpy(), labels):
            labels.join(a, b)
        if labels.edges:
            yield _edges(ids, labels)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, component, blocks) to rows (task, rep, n, tokens, side): of a component in k blocks, a
    member goes to the k tasks that pair its block with each."""
    for batch in batches:
        ids, component, blocks = (batch.column(i).to_numpy() for i in (0, 2, 3))
        out = []
        for i, s in token_sets(batch.column(1)):
            k = int(blocks[i])
            own = int(wordhash.mix(np.array([ids[i]], np.int64).view(np.uint64))[0] % np.uint64(k))
            for o in range(k):
                with np.errstate(over="ignore"):
                    task = wordhash.mix(np.array([component[i]], np.int64).view(np.uint64) * wordhash.GOLDEN + np.uint64(min(own, o) * k + max(own, o)))
                out.append((int(task.view(np.int64)[0]), int(ids[i]), len(s), s.tobytes(), (own > o) + (own != o)))
            if sum(len(x[3]) for x in out[-64:]) > 1 << 22 or len(out) >= 4096:
                yield _batch(_TASKS, len(out), **dict(zip(("task", "rep", "n", "tokens", "side"), zip(*out, strict=True), strict=True)))
                out = []
        if out:
            yield _batch(_TASKS, len(out), **dict(zip(("task", "rep", "n", "tokens", "side"), zip(*out, strict=True), strict=True)))


def link(sets: list[np.ndarray], side: np.ndarray | None = None) -> signature_tree.Labels:
    """The forest of exact links among token sets; of two blocks, without the edges within either."""
    sizes = np.array([len(s) for s in sets], np.int64)
    labels = signature_tree.Labels(len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(names), bool)
    side = np.zeros(len(sets), np.int32) if side is None else side
    for a, b in _dealt([signature_tree.bitmap(s) for s in sets], sizes, side, labels):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for i, j in zip(at, np.r_[at[1:], len(a)], strict=True):
            x, ys = a[i], b[i:j]
            ys = ys[labels.of[ys] != labels.of[x]]
            if not len(ys):
                continue
            own = flat[first[x] : first[x + 1]]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[flat[first[y] : first[y + 1]]]) for y in ys])
            mark[own] = False
            good = 9 * both >= 4 * (sizes[x] + sizes[ys])
            labels.join(np.full(good.sum(), x), ys[good])
    return labels


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches):
        ids = t.column("rep").to_numpy()
        labels = link([np.frombuffer(b, np.uint64) for b in t.column("tokens").to_pylist()], t.column("side").to_numpy())
        if labels.edges:
            yield _edges(ids, labels)


def _odd(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are null or repeat."""
    return not docs.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1").isEmpty()


def _numbered(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``docs`` as doc_id, text, ``more`` and a number, by id, nulls last, then by the text's hash. Numbers rise with the
    partitions of a sorted table; written, they are the same in every scan."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *more)
    rows = rows.orderBy(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    return scratch.table(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and class_id, the least doc_id with the same set (null
    for documents without shingles)."""
    if not _odd(docs, id_col):
        return _components(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    rows = _numbered(docs, id_col, text_col)
    found = _components(rows.select(F.col("number").alias("doc_id"), "text"))
    ids = rows.select("number", "doc_id")
    for c in ("doc_id", "component_id", "class_id"):
        found = found.withColumnRenamed(c, "of").join(ids.select(F.col("number").alias("of"), F.col("doc_id").alias(c)), "of", "left").drop("of")
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def _components(rows: DataFrame) -> DataFrame:
    """The same, of rows (doc_id, text) whose ids are unique and not null."""
    spark = rows.sparkSession
    described = scratch.table(rows.mapInArrow(_describe, _SETS), "sets")
    own = described.where("n IS NOT NULL").select("doc_id", "n", "h1", "h2", "bits")
    counts = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("df").alias("df"))
    often = counts.orderBy(F.desc("df"), "token").limit(HOT).collect()
    tokens = np.array([r.token for r in often], np.int64).view(np.uint64)
    df = np.array([r.df for r in often], np.int64)
    by = np.argsort(tokens)
    shared = spark.sparkContext.broadcast((tokens[by], df[by], blocks_of(df[by])))

    salt = scratch.salt("doc_id")
    classes = own.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"), scratch.salts(salt))
    classes = scratch.table(classes, "classes")
    posts = rows.select("text").mapInArrow(_post(shared), "key long, cls long, side int")
    buckets = posts.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_buckets, "bucket long, cls long, side int").distinct()
    members = buckets.join(classes.select(F.col("h1").alias("cls"), "rep", "n", "bits"), "cls").select("bucket", "rep", "n", "bits", "side")
    maybe = members.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_may_link, "a long, b long")
    groups = scratch.table(components(maybe), "groups")

    sized = groups.join(classes.select(F.col("rep").alias("node"), "n"), "node")
    few = F.least(F.ceil(F.count("*") / SMALL), F.lit(FEW))
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), few).cast("int").alias("blocks"))
    placed = groups.join(blocks, "component").select(F.col("node").alias("doc_id"), "component", "blocks")
    tasks = rows.join(placed, "doc_id").select("doc_id", "text", "component", "blocks").mapInArrow(_blocks, _TASKS)
    links = tasks.repartition("task").sortWithinPartitions("task", "rep").mapInArrow(_link, "a long, b long")
    found = scratch.table(components(links), "links")

    # A class that a third of all documents share is dealt over the salts that its rows have.
    named = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("h1", "h2", "n", "rep", "component", scratch.each_salt())
    joined = own.select("doc_id", "n", "h1", "h2", salt.alias("salt")).join(named, ["h1", "h2", "n", "salt"], "left")
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.col("rep").alias("class_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of least id, of each component; documents without shingles stay. Where ids are
    null or repeat, each row counts as a document of its own: a null id loses to any other, and of equal ids the row
    whose text has the least hash is kept."""
    if not _odd(docs, id_col):
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        found = _components(rows).where("doc_id = component_id").select("doc_id")
        return docs.join(found.withColumnRenamed("doc_id", id_col), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    whole = _numbered(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = _components(whole.select(F.col("number").alias("doc_id"), "text")).where("doc_id = component_id")
    return whole.select("number", "row").join(found.select(F.col("doc_id").alias("number")), "number", "left_semi").select("row.*")
