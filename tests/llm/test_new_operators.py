"""Operators 11, 12 and 13 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

from traymetrics.llm import conversations, search, toxicity
from traymetrics.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


# operator 13


def want_ranks(rows, items, best=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    texts = [(i, Counter(split((t or "").translate(plain._LOWER)))) for i, t, *_ in rows]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(c.total() for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item] |= set(split((t or "").translate(plain._LOWER)))
    out = Counter()
    for item, words in wanted.items():
        scores = []
        for i, c in texts:
            m = 100 - 90 + 90 * c.total() * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w]), plain.least_first(i), i))
        for k, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:best], 1):
            out[(item, k, i, -s)] += 1
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_search_on_awkward_rows(spark, block_bytes):
    rows = plain.awkward(13)
    rows += rows[:3] + [(None, rows[20][1], None, None, None), (None, "the of", None, None, None)]
    rnd = random.Random(1)
    cut = lambda t: " ".join(rnd.sample(t.split(), min(len(t.split()), 12)))
    items = [(k, cut(r[1] or "")) for k, r in enumerate(rows[10:40])] + [(3, "THE zebra"), (None, "of und"), (None, "été"), (90, None), (91, " -- "), (92, "nowhereseen"), (93, "the the of")]
    items += [(100 + k, items[k][1] + " the of und zebra") for k in range(12)]
    docs, asked = plain.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc", "2 as score", "3 as item")
    assert plain.rows_of(search.search(docs, asked, block_bytes=block_bytes)) == want_ranks(rows, items)
    assert search.search(docs.limit(0), asked).count() == search.search(docs, asked.limit(0)).count() == 0


def test_shared_sums_give_every_item_its_own_sum():
    rnd = random.Random(5)
    words = [f"w{k}".encode() for k in range(60)]
    items = [set(rnd.sample(words[: rnd.choice([10, 60])], rnd.randint(0, 10))) for _ in range(80)]
    graph = search.SharedSums(items)
    assert graph.sums  # something is shared
    worth = {t: rnd.randint(1, 10**6) for t in graph.terms}
    got = graph.evaluate(np.zeros(len(graph.terms), np.int64), np.arange(len(graph.terms)), np.array([worth[t] for t in graph.terms]), 1)[:, 0]
    assert dict(zip(graph.with_parts.tolist(), got.tolist())) == {i: sum(map(worth.get, s)) for i, s in enumerate(items) if s}
    plainly = sum(len(s) for s in items)
    assert len(graph.parts) + 2 * len(graph.sums) < plainly


def test_terms_of_one_hash_are_told_apart():
    known = search.Vocabulary([b"one", b"two", b"six"])
    known.hashes[:] = known.hashes[0]
    known.alike = 3
    buf = np.frombuffer(b"two six ten one", np.uint8)
    starts, ends = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15])
    real, search.span_hashes = search.span_hashes, lambda *_: np.full(4, known.hashes[0])
    try:
        assert known.find(buf, starts, ends).tolist() == [1, 2, -1, 0]
    finally:
        search.span_hashes = real


# operator 12


def repaired(rows):
    """[(initial, free, late, role, text)] to (cost, audit, lines), forwards, over every state."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(3):
            for q, (c, a, said) in list(best.items()):
                to = (c + 2, a + "I", said + [("user:" if after[q] == "u" else "assistant:")])
                if after[q] not in best or to < best[after[q]]:
                    best[after[q]] = to
        return best

    best = inserts({"": (0, "", [])})
    for initial, free, late, role, text in rows:
        new = {}

        def put(q, cost, audit, lines):
            if q not in new or (cost, audit, lines) < new[q]:
                new[q] = (cost, audit, lines)

        for q, (c, a, said) in best.items():
            put(q, c + 3, a + "D", said)
            if free:
                if initial == after[q] or (initial == "s" and q == ""):
                    put(initial, c + late, a + "K", said + [f"{role}:{text}"])
                put(after[q], c + 2 + late, a + "R", said + [f"{'user' if after[q] == 'u' else 'assistant'}:{text}"])
        best = inserts(new)
    return min(best[q] for q in ("", "a") if q in best)


def want_repairs(rows):
    """rows of (conv_id, turn, role, text), damaged here by the rule."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        group = groups[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            group += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = Counter()
    for conv, group in groups.items():
        group.sort(key=lambda g: (g[0], g[1], g[2].encode(), g[3].encode()))
        seen, counts, told, illegal, last = set(), Counter(), [], 0, None
        for given, turn, role, text in group:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
            last = role[:1]
            told.append((role[:1] if role[:1] in tuple("sua") else "-", fault not in ("blank", "duplicate"), fault == "truncated", role, text))
        turns = {t for given, t, *_ in group if given}
        cost, audit, lines = repaired(told)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[(conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())] += 1
    return out


def talk(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why", "why?", "", " \n", "ended. ", "ünd?", None, "Yes."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "admin"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            rows.append((conv, rnd.choice([turn, turn, turn, turn, None, turn * 7 % 5]), rnd.choice(roles), rnd.choice([*texts, f"text {turn}.", f"text {turn}"])))
    rows += [(900, k, rnd.choice(["user", "assistant"]), f"{k % 97}{rnd.choice('.?x')}") for k in range(1500)]  # crosses the chunks
    rows += [(901, None, "user", "same.")] * 40 + [(902, k, "user", "") for k in range(30)] + [(903, k, "system", f"{k}.") for k in range(12)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations(spark, seed):
    rows = talk(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as edits", "2 as _entry", "3 as kind", "4 as _c").repartition(3)
    got = conversations.report(conversations.repair(conversations.damage(df)))
    want = Counter({k: n for k, n in want_repairs(rows).items() if k[7]})
    assert Counter({tuple(r[c] for c in ("conv_id", *conversations._COUNTS, "audit", "repaired_sha256")): 1 for r in got.collect()}) == want
    assert conversations.report(conversations.repair(conversations.damage(df.limit(0)))).count() == 0


def test_repaired_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain.rows_of(LLM_QUERIES["op12_conversations"](spark, SF)) == want_repairs(rows)


def test_least_audit_by_ranks_equals_search_over_all_paths():
    rnd = random.Random(8)
    for _ in range(200):
        faults = [rnd.choice([None, None, "truncated", "duplicate", "blank"]) for _ in range(rnd.randint(1, 7))]
        roles = [rnd.choice(["system", "user", "assistant", "tool"]) for _ in faults]
        kinds = [conversations.kind_of(r, f) for r, f in zip(roles, faults)]
        letters, _ = conversations.Repairs(kinds, [conversations.Piece(0, len(kinds))]).edits()
        told = [(r[0] if r[0] in "sua" else "-", f not in ("blank", "duplicate"), f == "truncated", r, "") for r, f in zip(roles, faults)]
        assert "".join(letters) == repaired(told)[1]


# operator 11


def characters_of(text):
    low = {c: chr(ord(c) + 32) for c in [*map(chr, range(0x41, 0x5B)), *map(chr, range(0xC0, 0xDF))] if c != "×"}
    return " " + "".join(" " if ord(c) < 0x20 else low.get(c, c) for c in text or "") + " "


def grams_of(text):
    t = characters_of(text)
    return {t[k : k + n] for n in toxicity.SIZES for k in range(len(t) - n + 1) if " " not in t[k + 1 : k + n - 1]}


def test_grams_against_plain_strings():
    import pyarrow as pa

    texts = ["", "Été ÷×Þ ab", "日本🙂 ok", None, "a\tb\ncd", "ÀÉÎ" * 50, "x"] * 2
    places = {}
    for lo, hi, buf, bounds in toxicity.slices(pa.array(texts), 40):
        row, place = toxicity.grams(buf, bounds)
        for k in range(hi - lo):
            places[lo + k] = set(place[row == k].tolist())
    for k, text in enumerate(texts):
        assert len(places[k]) == len(grams_of(text))  # no two n-grams of a text share a place here
        for j, other in enumerate(texts):
            assert len(places[k] & places[j]) == len(grams_of(text) & grams_of(other))


def test_toxicity_against_brute_force(spark):
    """Counts, ratios and regression written out plainly give the same scores."""
    rnd = random.Random(4)
    rows = [(k, " ".join([rnd.choice(["alpha", "beta", "gamma", "delta", "Épsilon"]) for _ in range(8)] + (["MORONIC", "scumlike"][k % 2 : k % 2 + 1] if k % 4 == 0 else [])), None, None, None) for k in range(160)]
    labels = [(k, int(k % 4 == 0)) for k in range(160) if k % 7]
    docs = plain.documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["_toxic"] for r in toxicity.score(docs, model).collect()}
    train = [(grams_of(rows[i][1]), y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    yes, no = Counter(g for s, y in train for g in s if y), Counter(g for s, y in train for g in s if not y)
    a, b = sum(yes.values()) + (1 << 20), sum(no.values()) + (1 << 20)
    every = sorted(g for g in {*yes, *no} if yes[g] + no[g] > 1)
    assert len(every) <= toxicity.FEATURES  # so that none is left out
    x = np.array([[(g in s) * (math.log((yes[g] + 1) / a) - math.log((no[g] + 1) / b)) for g in every] for s, _ in train])
    y = np.array([y for _, y in train], float)
    w = np.zeros(len(every) + 1)
    one = np.c_[x, np.ones(len(x))]
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-one @ w))
        w += np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag([1.0] * len(every) + [1e-12]), one.T @ (y - p) - np.append(w[:-1], 0))
    for i, t, *_ in rows:
        s = sum(w[k] * (math.log((yes[g] + 1) / a) - math.log((no[g] + 1) / b)) for k, g in enumerate(every) if g in grams_of(t)) + w[-1]
        assert abs(got[i] - 1 / (1 + math.exp(-s))) < 2e-3


def test_toxicity_on_labels_kept_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = LLM_QUERIES["op11_toxicity"](spark, folder).collect()
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean), (sum(toxic), len(toxic), sum(clean), len(clean))


def test_toxicity_of_awkward_rows(spark):
    rows = plain.awkward()
    docs = plain.documents(spark, rows + rows[:2] + [(None, "null id", None, None, None)]).selectExpr("*", "1 as label", "2 as _toxic", "3 as place")
    some = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows[:80])] + [(rows[0][0], 1), (None, 1), (rows[90][0], None)], "doc_id long, toxic int")
    for labels in (some, some.limit(0), some.filter("toxic = 1")):
        out = toxicity.score(docs, toxicity.fit(docs, labels))
        assert out.count() == len(rows) + 3 and out.filter("_toxic IS NULL OR _toxic < 0 OR _toxic > 1").count() == 0
        assert set(docs.columns) <= set(out.columns)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, some)).count() == 0
    assert toxicity.fit(docs.limit(0), some) == 0.0


def test_tables_of_equal_length_have_codecs_of_their_own(spark, tmp_path):
    import base64

    import public_tokenizers

    from traymetrics.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
    swap = {b"th": ranks[b"he"], b"he": ranks[b"th"]}
    other = tmp_path / "other.tiktoken"
    other.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % swap.get(t, r) for t, r in ranks.items()))
    docs = spark.createDataFrame([(1, "th")], "doc_id long, text string")
    first, second = (bpe.encode(docs, path).first()["ids"] for path in (None, str(other)))
    assert first != second and bpe.encode(docs, str(other)).first()["ids"] == second
