"""Operators 1, 3, 4, 5, 8 and 9 against plain Python on awkward tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from traymetrics.llm import decontaminate, exact_dedup, exchange, rolling, sharding, simhash, substring_dedup, suffix_dedup
from traymetrics.llm.components import components

import plain


def tables():
    rows = plain.awkward()
    yield "plain", rows
    yield "repeated rows and a null id", rows + rows[:15] + [(None, rows[20][1], None, None, None), (None, "alone " * 30, None, None, None)]
    yield "empty", []
    yield "one row", rows[30:31]


CASES = list(tables())


@pytest.fixture(params=CASES, ids=[n for n, _ in CASES])
def rows(request):
    return request.param[1]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.octet_length(c).cast("long")], ids=["hash", "clashing hash"])
def test_exact_dedup(spark, rows, hashed):
    got = exact_dedup.exact_dedup(plain.documents(spark, rows), size=7 if len(rows) < 130 else 64, hashed=hashed)
    assert plain.rows_of(got) == plain.exact_groups(rows)


def test_exact_dedup_tells_lengths_apart(spark):
    texts = ["a" * n for n in range(30)] + ["a" * 29, "b"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    assert plain.rows_of(exact_dedup.exact_dedup(plain.documents(spark, rows), size=3)) == plain.exact_groups(rows)


def test_suffix_dedup(spark, rows):
    for hot in (suffix_dedup.HOT_ANCHOR, 1):
        out = suffix_dedup.suffix_dedup(plain.documents(spark, rows), hot_anchor=hot)
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        got = out.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256))
        assert plain.rows_of(got) == plain.suffix_kept(rows)


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    for module in (suffix_dedup, rolling):
        monkeypatch.setattr(module, "SLICE_BYTES", 300)
    rows = plain.awkward(3, 40)
    buf = np.frombuffer((rows[-2][1] or "").encode(), np.uint8)
    column = suffix_dedup.pa.array([r[1] for r in rows])
    whole = [(lo, base, len(part)) for lo, _, base, part, _ in suffix_dedup._pieces(column, 50)]
    assert any(base for _, base, _ in whole) and max(n for *_, n in whole) <= 300 + 300
    row, start, count, anchor = suffix_dedup.segments(buf, np.array([0, len(buf)]), 50, 24)
    got = []
    for at in range(0, len(buf) - 49, 251):
        part = buf[at : at + 300]
        _, s, c, a = suffix_dedup.segments(part, np.array([0, len(part)]), 50, 24)
        got += [(p, h) for x, n, h in zip(s + at, c, a) for p in range(x, x + n)]
    assert got == [(p, h) for x, n, h in zip(start, count, anchor) for p in range(x, x + n)]


def test_suffix_ranks_order_windows():
    data = np.frombuffer(b"banana bandana banana band", np.uint8)
    for window in (8, 9, 16, 20):
        starts = np.arange(len(data) - window + 1)
        rank = suffix_dedup.suffix_ranks(data, starts, window)
        texts = [data[s : s + window].tobytes() for s in starts]
        order = {t: k for k, t in enumerate(sorted(set(texts)))}
        assert np.unique(rank, return_inverse=True)[1].tolist() == [order[t] for t in texts]


def test_substring_dedup(spark, rows):
    out = substring_dedup.substring_dedup(plain.documents(spark, rows))
    assert plain.rows_of(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))) == plain.substring_kept(rows)


def test_exchange_over_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(exchange, "STRETCH", 500)
    monkeypatch.setattr(exchange, "BUCKET_KEYS", 300)
    rows = plain.awkward(11)
    assert plain.rows_of(substring_dedup.substring_dedup(plain.documents(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))) == plain.substring_kept(rows)


def test_decontaminate(spark, rows):
    rnd = random.Random(5)
    items = [(0, None), (1, ""), (2, "two WORDS"), (3, "one"), (None, "zebra of"), (2, "the the the the")]
    for k, (_, t, *_) in enumerate(rows[:40]):
        words = (t or "").split(" ")
        at = rnd.randint(0, len(words))
        items.append((10 + k, " ".join(words[at : at + rnd.choice([5, 9, 10, 11, 30])])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BLOCK_BYTES, 300):  # one block, and many
        marked = decontaminate.mark_contamination(plain.documents(spark, rows), benchmark, block_bytes=limit)
        hits = decontaminate.hit_words()
        got = marked.select("doc_id", "_word_count", hits, F.size("_hit_items"), F.sha2(F.array_join("_hit_items", ","), 256), hits > 0)
        assert plain.rows_of(got) == plain.contamination(rows, items)
        if limit > 300 and not rows:
            break
    assert not decontaminate.mark_contamination(plain.documents(spark, rows), benchmark.limit(0)).filter("size(_hit_spans) > 0").count()


def test_simhash(spark, rows):
    for block in (simhash.BLOCK, 8):
        out = simhash.near_dedup(plain.documents(spark, rows), block=block)
        assert plain.rows_of(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")) == plain.near_groups(rows)


def test_trie_finds_every_link():
    rnd = np.random.default_rng(4)
    seeds = rnd.integers(0, 1 << 63, 40, np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 7), replace=False))) for _ in range(2000)]
    prints = np.unique(np.array([seeds[k % 40] ^ f for k, f in enumerate(flips)], np.uint64))
    turned = [np.sort(simhash._turned(prints, side)) for side in (0, 1)]
    found = set()
    for side, x in enumerate(turned):
        for i, j in simhash.walk(x, x, 4, 0, True):
            found |= {tuple(sorted(p)) for p in zip(simhash._turned(x[i], side).tolist(), simhash._turned(x[j], side).tolist())}
    want = {(int(a), int(b)) for k, a in enumerate(prints) for b in prints[k + 1 :] if int(a ^ b).bit_count() <= 4}
    assert found == want


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).distinct().collect()))
    assert got == {**{k: 0 for k in range(201)}, 1000: 1000, 1001: 1000, 1002: 1000}


def test_sharding(spark, rows):
    for ranges in (sharding.RANGES, 30):
        out = sharding.shard(plain.documents(spark, rows), shards=5, ranges=ranges, whole=0.2).collect()
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 5
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_have_near_equal_sizes_with_a_hot_text(spark):
    rows = [(k, "same text" * 20 if k % 3 == 0 else f"text {k} " * (k % 11), None, None, None) for k in range(4000)]
    out = sharding.shard(plain.documents(spark, rows, clash=False)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 24 and max(sizes) < 1.03 * sum(sizes) / 24
    groups = sharding.shard(plain.documents(spark, rows, clash=False)).filter("text_crc32 <> " + str(zlib.crc32(("same text" * 20).encode())))
    split = groups.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"), F.sum("size").alias("b")).filter("n > 1").collect()
    assert all(r["b"] > 0.02 * sum(sizes) / 24 for r in split)


def test_index_of_a_block_keeps_every_item_of_a_window():
    line = "one two three four five six seven eight nine ten"
    items = [{"item_id": k, "text": t} for k, t in enumerate([line + " " + line, line.upper() + " eleven", "only three words", None, "", "only three words", "same " * 30, line])]
    index = decontaminate._Index(items, 10, 5)
    hashes, places = index.by_length[10]
    assert sorted(index.by_length) == [3, 10] and (hashes[1:] >= hashes[:-1]).all()
    owners = [(index.text(p, 10), index.ids[index.owner[p]]) for p in places]
    assert len(owners) == len(set(owners))  # a window repeated inside one item is kept once
    assert {i for t, i in owners if t == line.encode()} == {0, 1, 7}
    assert [i for t, i in owners if t == b" ".join([b"same"] * 10)] == [6]
    assert {index.ids[index.owner[p]] for p in index.by_length[3][1]} == {2, 5}
    assert not decontaminate._Index([], 10, 5).by_length
