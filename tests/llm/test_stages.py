"""Stages of the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from traymetrics.llm import quality, similar, simhash, stages

import corpus_pipeline as p
import plain

SF = "/root/testdata/sf0.001"
STAGES = dict(p.STAGES)
DEDUP = {**STAGES, "similar": stages.drop_similar}


def shingle_set(text):
    words = re.compile(rb"[^\x20\x09-\x0D]+").findall((text or "").encode().lower())
    return set(plain.windows(words, 5)) or {tuple(words)}


def similar_kept(rows, similarity=0.8):
    """The least (doc_id, text) of each group linked by similar sets."""
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append((plain.least_first(r[0]), plain.sha(r[1] or "")))
    return Counter(min(g) for g in groups.values())


def linked_kept(rows, bits=4):
    """The least (doc_id, text) of each group linked by fingerprints that differ in few bits."""
    named = plain.near_groups([(k, r[1]) for k, r in enumerate(rows)], bits)
    groups = defaultdict(list)
    for k, _, component in named:
        groups[component].append((plain.least_first(rows[k][0]), plain.sha(rows[k][1] or "")))
    return Counter(min(g) for g in groups.values())


def keys(df):
    return Counter((plain.least_first(r["doc_id"]), plain.sha(r["text"] or "")) for r in df.collect())


def near_copies(seed, n, words=60):
    """One text changed in up to eight places, and texts that share half of it."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(words)]
    rows = []
    for k in range(n):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 8])):
            text[rnd.choice([0, 1, 2, 20, 21, 22, 57, 58, 59])] = rnd.choice("xyz")
        if k % 5 == 0:
            text = text[: words // 2] + [f"v{rnd.randint(0, 10**6)}" for _ in range(words // 2)]
        rows.append((k if k % 7 else None, " ".join(text), None, None, None))
    return rows


def test_similar_stage_finds_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert keys(DEDUP["similar"](spark, docs, SF)) == similar_kept([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("pairs", [similar.PAIRS, 0.01])
def test_similar_stage_on_a_large_group(spark, monkeypatch, pairs):
    monkeypatch.setattr(similar, "PAIRS", pairs)
    rows = near_copies(4, 220) + plain.awkward(8, 80)
    docs = plain.documents(spark, rows + rows[:5])
    got = DEDUP["similar"](spark, docs, SF)
    assert keys(got) == similar_kept(rows) and got.columns == docs.columns
    assert DEDUP["similar"](spark, docs.limit(0), SF).count() == 0


def test_similar_stage_with_one_shingle_in_all_texts(spark):
    """A passage that every text has, at the head of every prefix: all lists meet in it."""
    rnd = random.Random(12)
    shared = " ".join(f"s{k}" for k in range(12))
    rows = [(k, shared + " " + " ".join(f"w{rnd.randint(0, 3 if k % 3 else 10**6)}" for _ in range(9)), None, None, None) for k in range(250)]
    assert keys(DEDUP["similar"](spark, plain.documents(spark, rows), SF)) == similar_kept(rows)


def test_near_dedup_stage_links_by_simhash(spark, monkeypatch):
    """Short texts of few common shingles fall together where their fingerprints are near, and only there."""
    rows = near_copies(4, 120) + plain.awkward(8, 80)
    want = linked_kept(rows)
    assert want != similar_kept(rows)
    for block in (simhash.BLOCK, 8):
        monkeypatch.setattr(simhash.name_groups, "__defaults__", (simhash.BITS, block))
        got = STAGES["near_dedup"](spark, plain.documents(spark, rows + rows[:5]), SF)
        assert keys(got) == want
    assert STAGES["near_dedup"](spark, plain.documents(spark, rows[:0]), SF).count() == 0


def copies_kept(rows):
    """One row of the greatest doc_id for each text."""
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(best.get(t or "", plain.least_first(None)), plain.least_first(i))
    return Counter((i, plain.sha(t)) for t, i in best.items())


@pytest.mark.parametrize("name, want", [("exact_dedup", copies_kept), ("near_dedup", linked_kept), ("similar", similar_kept)])
def test_dedup_stages_decide_on_rows(spark, name, want):
    few = [(None, "a"), (None, "b"), (None, "b"), (9, "b"), (5, "a x"), (5, "b"), (7, None), (7, ""), (None, None)]
    rows = [(i, t, None, None, None) for i, t in few]
    some = plain.awkward(6, 60)
    rows += [(None if k % 3 == 0 else r[0] % 20, *r[1:]) for k, r in enumerate(some + some[:10])]
    rows += [(None, *r[1:]) for r in near_copies(5, 12)]
    docs = plain.documents(spark, rows)
    out = DEDUP[name](spark, docs, SF)
    assert keys(out) == want(rows) and out.columns == docs.columns


def test_toxic_documents_are_told_by_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    toxic = quality.fit(docs, labels.filter("doc_id % 5 <> 0"), target="toxic")
    test = docs.join(labels.filter("doc_id % 5 = 0").select("doc_id", "toxic"), "doc_id")
    words = r"(?i)\b(trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b"
    rows = quality.score(test, 1.0, toxic).selectExpr("toxic = 1 as toxic", f"rlike(text, r'{words}') as told", "_toxic >= 0.5 as found").collect()
    found = [r["found"] for r in rows if r["toxic"] and r["told"]]
    clean = [not r["found"] for r in rows if not r["toxic"]]
    told = [r["told"] for r in rows if r["toxic"]]
    print("toxic", len(told), "with words", len(found), "found", sum(found), "found of all", sum(r["found"] for r in rows if r["toxic"]), "clean kept", sum(clean), len(clean))
    assert sum(found) > 0.97 * len(found) and sum(clean) > 0.98 * len(clean)


def test_quality_stage_drops_toxic_documents(spark, tmp_path):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(2, 5) for _ in range(30)) + (" You MORON." if k % 8 == 0 else " You dear.") for k in range(600)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], plain.DOCS)
    spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in STAGES["quality"](spark, docs, str(tmp_path)).collect()} == {k for k in range(600) if k % 8}
