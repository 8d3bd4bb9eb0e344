import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperledger.llm import merges, packing, queries, scratch


def texts(n=400):
    rng = random.Random(9)
    letters, signs = "eeeetaoinsrhldcumfpgwybvkjxqzüéñß", [chr(c) for c in [*range(33, 127), *range(0xC0, 0x130), 0x300, 0x2019, 0x1F642]]

    def word():
        kind = rng.random()
        if kind < 0.6:
            return "".join(rng.choice(letters + letters.upper()) for _ in range(rng.randint(1, 12)))
        if kind < 0.8:
            return "".join(rng.choice(signs) for _ in range(rng.randint(1, 9)))
        if kind < 0.9:
            return rng.choice(["a", "ab", "É", "!", "9", "ß"]) * rng.randint(1, 70)
        return rng.choice(["it", "", "!", "É"]) + rng.choice(["'s", "'LL", "''re", "'x", "<|endoftext|>", "<|"]) + rng.choice(["", "a", "7"])

    return ["", None, *(" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(queries.tokenizer()), packing.Encoder(queries.tokenizer())
    got = [i.tolist() for _, i in own.encode(pa.array(texts()))]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts()]


def test_plain_words_need_no_tokenizer():
    """Words of Latin-1's letters, digits and signs are merged here; each by itself cost more than all else."""
    from tokenizers import Tokenizer

    own, text = packing.Encoder(queries.tokenizer()), 'Straße "Ünder" 1234,5 ÀÉÎ!! internationalization (x=y) ' + "ab" * 30
    ids = [i.tolist() for _, i in own.encode(pa.array([text]))]
    assert "tokenizer" not in vars(own)
    assert ids == [[*Tokenizer.from_file(queries.tokenizer()).encode(text, add_special_tokens=False).ids, packing.END]]


def test_merges_by_rank_then_position():
    vocab = {c: i for i, c in enumerate(merges.byte_signs())} | {"aa": 256, "aab": 257, "ab": 258, "aaaa": 259}
    model = {"type": "BPE", "vocab": vocab, "merges": [["a", "b"], "a a", ["aa", "aa"], ["aa", "b"]]}
    a, b = ord("a"), ord("b")
    for part, right in ((b"aab", [a, 258]), (b"aaa", [256, a]), (b"aaaaa", [259, a]), (b"b", [b]), (b"a" * 7 + b"b", [259, 256, 258])):
        ids, count = merges.Merges.of(model).ids(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        assert ids.tolist() == right and count.tolist() == [len(right)], part
    for odd in ({"dropout": 0.1}, {"ignore_merges": True}, {"byte_fallback": True}, {"type": "WordPiece"}, {"end_of_word_suffix": "</w>"}):
        assert merges.Merges.of(model | odd) is None


def test_no_more_files_than_the_pieces_have(spark):
    """Each file costs forked processes, which count an executor's memory again."""
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string").repartition(3)
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        made = packing.pack(docs, queries.tokenizer())
        assert made.rdd.getNumPartitions() <= 4
        rows = made.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    own = packing.Encoder(queries.tokenizer())
    right = [(i, zlib.crc32(ids)) for i, ids in own.encode(pa.array(texts(40)))]
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == right
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.LENGTH


def test_texts_pass_in_small_batches(spark, monkeypatch):
    """While pieces are made, and only then: 4,000 texts of 1,000 bytes, at 100,000 bytes a batch."""
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    real = scratch.table

    def table(df, *rest):
        rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 1000))
        sizes.extend(r.n for r in rows.mapInArrow(lambda own: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in own), "n long").collect())
        return real(df, *rest)

    monkeypatch.setattr(scratch, "table", table)
    monkeypatch.setattr(packing, "BATCH", 100_000)
    before = spark.conf.get(name)
    docs = spark.createDataFrame(list(enumerate(texts(40))), "doc_id long, text string")
    assert packing.pack(docs, queries.tokenizer()).count() == 42
    assert sum(sizes) == 4000 and max(sizes) <= 200
    assert spark.conf.get(name) == before
    for own, within in (("1k", "1k"), ("64m", "4096b")):
        spark.conf.set(name, own)
        try:
            with pytest.raises(ZeroDivisionError), scratch.batches(spark, 4096):
                assert spark.conf.get(name) == within
                raise ZeroDivisionError
            assert spark.conf.get(name) == own
        finally:
            spark.conf.set(name, before)
