"""Operators 2, 6, 7, 10 and the pipeline against libraries and plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from traymetrics.llm import boosting, bpe, pii, quality, warc
from traymetrics.llm.queries import LLM_QUERIES as QUERIES
from traymetrics.session import scratch_path

import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library(tokenizer):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE)), public_tokenizers.PATTERN)
    rnd = random.Random(2)
    letters = "aab bcé  \n\tthe'reß12中 <|endoftext|>  🙂"
    texts = ["", " " * 3000, "a" * 3000, "ab" * 2000, "\u0000 x"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(800)]
    texts += [bytes(rnd.randint(0, 255) for _ in range(60)).decode("latin1") for _ in range(200)]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_lower_rank_after_a_merge_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 299, b"ca": 298, b"abca": 301}
    codec = bpe.Codec(ranks, r"\S+")
    own = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcab", "abcabcab", "cababcaab", "abcaabca"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_encode_and_decode_tables(spark, tokenizer):
    rows = plain.awkward()
    docs = plain.documents(spark, rows + rows[:3])
    out = bpe.decode(bpe.encode(docs)).select("doc_id", "text", "ids", "decoded", "lang").collect()
    assert len(out) == len(rows) + 3
    for r in out:
        assert r["ids"] == tokenizer.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    want = Counter((i, len(e := tokenizer.encode_ordinary(t or "")), plain.sha(b"".join(x.to_bytes(4, "little") for x in e)), plain.sha(t or "")) for i, t, *_ in rows + rows[:3])
    assert plain.rows_of(bpe.round_trip(docs)) == want
    assert bpe.round_trip(docs.limit(0)).count() == 0


def pages():
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "<p>größe</p>" * 200
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", inner), (8, "u", "before" + inner * 3 + big)]
    rows += [(9, "u", "before" + inner * 3 + big), (10, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (11, "u", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n"), (-4, "u", "x\r\n" * 900)]
    return rows + [(12 + k, "u", f"{k}" * 1500 + inner * (k % 3)) for k in range(40)] + [(None, "u", "no id"), (9, "u", "before" + inner * 3 + big)]


def want_records(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 1000:
            first[h] = i if first.get(h) is None else max(first[h], i if i is not None else first[h])
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = (h or "") in first and first[h or ""] != i
        out[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    return out


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_warc_round_trip(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for rows in (pages(), []):
            path = scratch_path(spark, "test-warc")
            df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as file", "2 as at", "3 as sha1", "4 as id")
            warc.write_archives(df.repartition(3), path)
            records = warc.read_archives(spark, path)
            got = records.select(warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")))
            assert plain.rows_of(got) == want_records(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def pii_rows():
    rnd = random.Random(9)
    pieces = ["mail", "a.b@c.de", "..x@y.z..w@q.r", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (988) 555-2485", "+49 30 1234", "+1..", "+1234567890123456", "é🙂", "-", " ", "\n", "42", "a@b-.c-", "@", "555-12-3456", "(212) 555-1234", "x[at]y[dot]com", "2001:db8:0:0:0:ff00:42:8329", "4111.1111.1111.1111"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", ", ", ":"]) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    texts += [None, "", "1" * 30000, "1 2-" * 20000, "a." * 20000 + "@b", "1." * 20000, "+1" + " " * 20000, "a@" + "b." * 20000 + "c", "é" * 50 + "a@b.cd"]
    return [(k, t, None, None, None) for k, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, "i@j.kl", None, None, None)]


def test_base_spans_of_pii(spark):
    rows = pii_rows()
    out = pii.find_pii(plain.documents(spark, rows)).collect()
    got = Counter((r["doc_id"], tuple((s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["base"])) for r in out)
    assert got == Counter((i, tuple(plain.base_spans(t or ""))) for i, t, *_ in rows)
    assert pii.find_pii(plain.documents(spark, [])).count() == 0


def test_boosted_trees_add_what_looks_right(spark):
    rnd = random.Random(3)

    def card(valid):
        digits = [4] + [rnd.randint(0, 9) for _ in range(14)]
        total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits))
        return "".join(map(str, digits)) + str((-total + (not valid) * rnd.randint(1, 9)) % 10)

    texts = [f"please charge my card {card(True)}, thanks" for _ in range(900)] + [f"order no {rnd.randint(10**12, 10**13 - 1)}x" for _ in range(900)] + [f"please charge my card {card(False)}, thanks" for _ in range(3)]
    out = pii.find_pii(plain.documents(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert all([s["base"] for s in r["spans"]] == [False] for r in out[1800:])  # a slip in the check digit
    loose = sum(not s["base"] for r in out[900:1800] for s in r["spans"])
    assert loose <= 18  # the threshold was set for few false spans


LOOSE = {
    "email": "jane.miller7 [at] mail2 [dot] com",
    "ip": "2001:db8:0:0:0:ff00:42:8329",
    "card": "4111.1111.1111.1111",
    "phone": "(212) 555-1234",
}


def test_spelled_out_personal_data_is_added_on_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = [(10**9 + k, f"ereat thon in the {span} andeou the") for k, span in enumerate(LOOSE.values())]
    planted += [(10**9 + 10, "paid by 4111.1111.1111.1112 then"), (10**9 + 11, "meet me at noon in version 3.5 of 1234567890"), (10**9 + 12, "call +1 (212) 555-1234 now")]
    out = pii.find_pii(docs.union(spark.createDataFrame(planted, docs.schema))).filter(f"doc_id >= {10**9} OR exists(spans, s -> NOT s.base)").collect()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], s["base"]) for s in r["spans"]] for r in out}
    for k, (kind, span) in enumerate(LOOSE.items()):
        assert got.pop(10**9 + k) == [(kind, 18, 18 + len(span), False)]
    assert got.pop(10**9 + 12) == [("phone", 5, 22, True)]  # the part without its +1 is inside
    assert got.pop(10**9 + 10) == got.pop(10**9 + 11) == []
    assert not got  # nothing is added to the other documents


def test_precision_bound():
    assert pii.precision_bound(0, 0) == 0 and pii.precision_bound(8, 0) < 0.9 < pii.precision_bound(10, 0)
    assert pii.precision_bound(900, 100) < 0.9 < pii.precision_bound(920, 80)
    rows = [(2.0, 30, 0), (1.0, 10, 1), (0.0, 1, 40)]
    assert pii._lowest(rows, 0.9) == 1.0 and pii._lowest(rows[2:], 0.9) is None and pii._lowest([], 0.9) is None


def test_folds_and_spans_do_not_depend_on_the_layout(spark):
    df = plain.documents(spark, pii_rows())
    assert plain.rows_of(pii.find_pii(df.repartition(7)).selectExpr("doc_id", "to_json(spans)")) == plain.rows_of(pii.find_pii(df.coalesce(1)).selectExpr("doc_id", "to_json(spans)"))


def test_boosting_learns_an_interaction():
    cells = [boosting.Cell((a, b), 90.0 if a == b else 10.0, 10.0 if a == b else 90.0) for a in (0, 1) for b in (0, 1)]
    cells[0] = boosting.Cell((0, 0), 95.0, 10.0)
    model = boosting.fit(cells, rounds=40)
    assert all((model.logit(c.codes) > 0) == (c.positive > c.negative) for c in cells)
    assert boosting.fit([]).logit((1, 2)) == 0.0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    test = labels.filter("doc_id % 5 = 0")
    model = quality.fit(docs, labels.filter("doc_id % 5 <> 0"))
    assert sum(map(sum, model.exchanged)) > 0
    scored = quality.score(docs.join(test.select("doc_id", "quality"), "doc_id"), model).select("quality", "_quality", "_text_quality").collect()
    right = sum((r["_quality"] >= 0.5) == (r["quality"] == 1) for r in scored)
    clean = [r["_quality"] >= 0.5 for r in scored if r["quality"] == 1]
    assert right > 0.97 * len(scored) and sum(clean) > 0.98 * len(clean)


def test_quality_of_awkward_rows(spark):
    rows = plain.awkward()
    docs = plain.documents(spark, rows + rows[:2] + [(None, "null id", None, None, None)])
    some = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows[:60])] + [(rows[0][0], 1), (None, 1), (rows[70][0], None)], "doc_id long, quality int")
    for labels in (some, some.limit(0), some.filter("quality = 1")):
        out = quality.classify(docs, labels)
        assert out.count() == len(rows) + 3 and out.filter("_quality IS NULL OR _quality < 0 OR _quality > 1").count() == 0
        assert set(docs.columns) <= set(out.columns)
    assert quality.classify(docs.limit(0), some).count() == 0


def test_pipeline(spark, tokenizer):
    import corpus_pipeline
    from traymetrics.llm import stages as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, columns = {r["doc_id"]: tuple(r) for r in docs.collect()}, docs.columns
    good = p.keep_good(spark, docs, SF)
    assert good.columns == columns
    copies = p.drop_copies(spark, docs, SF)
    want = {r[0] for r in plain.exact_groups(list(rows.values())) if r[3]}
    assert {r["doc_id"] for r in copies.collect()} == want and copies.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = p.drop_contaminated(spark, docs, SF)
    want = {r[0] for r in plain.contamination(list(rows.values()), items) if not r[5]}
    assert {r["doc_id"] for r in clean.collect()} == want and clean.columns == columns
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r["ids"] == tokenizer.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
        assert tuple(r[c] for c in columns) == rows[r["doc_id"]]


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline as p

    rows = plain.awkward(5, 60)
    docs = plain.documents(spark, rows + rows[:4] + [(None, "null id", None, None, None)])
    for case in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, case, SF)
            assert out.count() <= case.count()
            assert name == "tokens" or out.columns == docs.columns


def test_every_operator_has_its_query():
    names = [n for n in QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES
